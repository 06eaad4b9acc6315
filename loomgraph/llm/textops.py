"""Shared helpers: scratch tables on the shared folder, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 6_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
ALNUM_ONLY = np.ones(256, dtype=bool)
ALNUM_ONLY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case: the given one, with as many underscores before it as it takes."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df and further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one slice have about limit bytes; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls' contents, and n + 1 offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind, count=len(texts) + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(offsets(texts)[1])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a step; equal bytes give equal hashes on any machine."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(np.uint64) + _GOLD)
    left, at, live = size.copy(), starts.astype(np.int64).copy(), None
    while True:
        if live is None:
            keep = left > 0
            live = np.flatnonzero(keep) if not keep.all() else None
            if live is not None and not len(live):
                break
        pos, rest = (at, left) if live is None else (at[live], left[live])
        if not len(pos):
            break
        block = view[pos]
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        if live is None:
            h = mix((h ^ block) * _GOLD + np.uint64(1))
            at += 8
            left -= 8
            keep = left > 0
            live = np.flatnonzero(keep)
        else:
            h[live] = mix((h[live] ^ block) * _GOLD + np.uint64(1))
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        if not len(live):
            break
    return h


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of an Arrow slice, A-Z lower-cased: byte spans, document index and hashes.

    `apart` names other separating bytes instead of white space.
    """

    def __init__(self, texts: pa.Array, apart: np.ndarray = _SPACE):
        raw, off = offsets(texts)
        self.raw, self.off, self.n_docs = _LOWER[raw], off, len(off) - 1
        word = ~apart[self.raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[off] = True
        before = np.concatenate([[False], word[:-1]]) if len(raw) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(raw) else word
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off[:-1], "left")
        self.last = np.searchsorted(self.starts, off[1:], "left")
        self.hash = hash_spans(self.raw, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(self.n_docs), self.last - self.first)

    def text(self, k: int) -> str:
        return self.raw[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of width consecutive hashes; runs over a document's end are the caller's to drop."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n] + np.uint64(int(_GOLD) * width % (1 << 64)))
    for k in range(1, width):
        out = mix((out ^ h[k : k + n]) * _GOLD + np.uint64(k))
    return out


def crc_of_id(ids: list) -> np.ndarray:
    """Unsigned crc32 of each id as decimal text; 0 for a null id, which no text has."""
    return np.array([zlib.crc32(str(i).encode()) if i is not None else 0 for i in ids], dtype=np.int64)


_ODD = re.compile(r"[\s0-9<]")
_CONTROL = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes, by a tokenizer file of the tokenizers library.

    A space between two characters that are no white space always begins a new pre-token, so a text's ids
    are those of its chunks one after another. A chunk is encoded once; the table of chunks keeps at most
    `keep` of them, and others are encoded anew in each slice. With `spaced` (the space belongs to the
    next pre-token), texts with other white space beside a space are encoded whole: a chunk that begins or ends
    with white space is kept as None. Without it white space is dropped, and any of it parts chunks (but in texts
    with the four control characters that Python alone counts as white space). New chunks without
    digits go to the library several hundred at a time, with a chunk of one digit between each two.
    """

    def __init__(self, path: str, spaced: bool = True, keep: int = 700_000):
        from tokenizers import Tokenizer

        self.model, self.spaced, self.keep, self.known = Tokenizer.from_file(path), spaced, keep, {}
        self.lead = " " if spaced else ""
        between = self.model.encode(" 0", add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w and not _ODD.search(w)] if self.between is not None else []
        done = set(plain)
        rest = [w for w in words if w not in done]
        out: dict[str, bytes] = {}
        for i in range(0, len(rest), 2000):
            out.update(zip(rest[i : i + 2000], self._ids([self.lead + w for w in rest[i : i + 2000]]), strict=True))
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.array(self.model.encode_batch_fast([self.lead + " 0 ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut, data = np.flatnonzero(ids == self.between), ids.tobytes()
            starts, ends = [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(data)]
            out.update(zip(some, [data[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        flat: list[str] = []
        heads, tails, ends = [], [], []
        for t in texts:
            p = t.split(" ") if self.spaced or any(c in t for c in _CONTROL) else t.split()
            if self.spaced:  # the first chunk has no space before it, and the last may end in white space
                heads.append(p[0])
                tails.append(p.pop() if len(p) > 1 and (not p[-1] or p[-1][-1].isspace()) else None)
                flat += p[1:]
            else:
                flat += p
            ends.append(len(flat))
        got = list(map(self.known.get, flat, repeat(False)))
        holes = [i for i, v in enumerate(got) if v is False]
        if holes:
            fresh: dict[str, bytes | None] = dict.fromkeys(map(flat.__getitem__, holes))
            whole = [w for w in fresh if not self.spaced or w and not (w[0].isspace() or w[-1].isspace())]
            fresh.update(self._chunks(whole))
            for i in holes:
                got[i] = fresh[flat[i]]
            if len(self.known) + len(fresh) <= self.keep:
                self.known.update(fresh)
        if not self.spaced:
            return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        out = []
        for t, h, tail, head, a, b in zip(texts, self._ids(heads), tails, heads, [0, *ends], ends, strict=False):
            part = got[a:b]
            apart = (b > a or tail is not None) and head[-1:].isspace() or (tail is not None and tail[:1].isspace()) or None in part
            out.append(self._ids([t])[0] if apart else h + b"".join(part) + (self._ids([" " + tail])[0] if tail is not None else b""))
        return out


_CACHE: list = [None, None]


def cached(owner: tuple, make):
    """What `make` gives, kept for later tasks of this Python worker until another owner asks: one table at a time."""
    if _CACHE[0] != owner:
        release()
        _CACHE[:] = [owner, make()]
    return _CACHE[1]


def release() -> None:
    """Lets go of the table that earlier tasks left in this Python worker, and of memory that Arrow holds unused."""
    _CACHE[:] = [None, None]
    pa.default_memory_pool().release_unused()


def encoder(path: str, spaced: bool) -> Encoder:
    """One Encoder for each Python worker, so that chunks met in one task serve the next."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return cached(("encoder", path, spaced), lambda: Encoder(path, spaced))
