"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops

#: Ends every window and both dictionaries, so that a window always has a match and is never stored as it is.
FRAME = b" ~0123456789ABCDEF~QWERTYUIOP~"
LEVELS = (2, 3, 4, 5, 6, 8)
LONGEST = 24
#: No window saves so much: stands for windows that are not kept.
UNKNOWN = np.iinfo(np.int16).min
#: (words, step) of the windows that texts are scored by: every word, and every phrase of two words whole in one of three.
SHAPES = ((1, 1), (3, 2))


@dataclass(frozen=True)
class ToxicityModel:
    """The two dictionaries and the weights of the calibrated features (none: the constant score `prior`)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float
    shapes: tuple[tuple[int, int], ...] = SHAPES


def pieces(text: str) -> list[str]:
    """Words by white space, lower-cased; those of over LONGEST characters in parts of that many."""
    words, out = text.lower().split(), []
    if not words or max(map(len, words)) <= LONGEST:
        return words
    for w in words:
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def joined(p: list[str], width: int, step: int = 1) -> list[str]:
    """`width` pieces in a row, each window `step` pieces on from the last, the last one to the end; fewer are one window."""
    if width == 1 and step == 1 or len(p) < 2:
        return p
    full = list(map(" ".join, zip(*(p[k::step] for k in range(width)), strict=False)))
    return full + [" ".join(p[i : i + width]) for i in range(0, max(1, len(p) - width + step), step)[len(full) :]]


def windows(text: str, width: int, step: int = 1) -> list[str]:
    return joined(pieces(text), width, step)


def _data(window: str) -> bytes:
    return b" " + window.encode("utf-8", "replace") + b" "


def packed(some: list[str], batch: int = 20_000) -> list[Any]:
    """Windows with their ends, in batches of one buffer each."""
    import zstandard

    out, end = [], " " + FRAME.decode()
    for i in range(0, len(some), batch):
        part = some[i : i + batch]
        text = " " + f"{end} ".join(part) + end
        raw = text.encode("utf-8", "replace")
        sizes = map(len, part) if len(raw) == len(text) else (len(w.encode("utf-8", "replace")) for w in part)
        segments = np.empty((len(part), 2), dtype=np.uint64)
        segments[:, 1] = np.fromiter(sizes, np.uint64, len(part)) + np.uint64(1 + len(end))
        segments[:, 0] = np.cumsum(segments[:, 1]) - segments[:, 1]
        out.append(zstandard.BufferWithSegments(raw, segments.tobytes()))
    return out


class Compressor:
    """Lengths of windows under one dictionary, compressed in batches."""

    def __init__(self, dictionary: bytes):
        import zstandard

        content = zstandard.ZstdCompressionDict(dictionary + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(6, source_size=1000, dict_size=len(dictionary) + len(FRAME), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        content.precompute_compress(compression_params=params)  # once, else for every window; the lengths are the same
        self.compress = zstandard.ZstdCompressor(dict_data=content, compression_params=params).multi_compress_to_buffer

    def lengths(self, batches: list[Any]) -> np.ndarray:
        """Of each window of `packed` batches."""
        return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(len, self.compress(b)), np.int64, len(b)) for b in batches)])


def train(some: list[str], size: int) -> bytes:
    """A zstandard dictionary of windows; where there is too little text to train one, the text itself."""
    import zstandard

    data = [_data(w) for w in some]
    try:
        return zstandard.train_dictionary(size, data, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-size:]


def savings(ordinary: Compressor, toxic: Compressor, some: list[str]) -> np.ndarray:
    """Bytes by which the toxic dictionary makes each window shorter than the ordinary one does; equal windows are done once."""
    first: dict[str, int] = {}
    at = np.fromiter(map(first.setdefault, some, range(len(some))), np.int64, len(some))
    data, out = packed(list(first)), np.zeros(len(some), np.int64)
    out[np.fromiter(first.values(), np.int64, len(first))] = ordinary.lengths(data) - toxic.lengths(data)
    return out[at]


def features(saved: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For texts of n windows each: the largest and third largest saving, and for each level how many windows save so much, and their share."""
    out = np.zeros((len(n), 2 + 2 * len(LEVELS)))
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at, stop = (np.cumsum(n) - n)[full], np.cumsum(n)[full]
    saved = np.clip(saved, -40, 40)
    out[full, 0] = np.maximum.reduceat(saved, at) / 8
    for row, a, b in zip(full.tolist(), at.tolist(), stop.tolist(), strict=True):
        part = saved[a:b]
        out[row, 1] = (np.partition(part, -3)[-3] if len(part) > 2 else part.min()) / 8
    for k, level in enumerate(LEVELS):
        hits = np.add.reduceat((saved >= level).astype(np.int64), at)
        out[full, 2 + 2 * k] = np.log1p(hits)
        out[full, 3 + 2 * k] = np.minimum(1, 20 * hits / n[full])
    return out


class Table:
    """Savings of the windows met last by their hash of 64 bits, ten bytes each: in as many places as the power of two from `keep` on, new ones instead of older."""

    def __init__(self, keep: int):
        n = 1 << (keep - 1).bit_length()
        self.keys, self.values, self.mask = np.zeros(n, np.int64), np.full(n, UNKNOWN, np.int16), np.int64(n - 1)

    def savings(self, ordinary: Compressor, toxic: Compressor, some: list[str]) -> np.ndarray:
        """Like `savings`; windows in the table are not compressed again, nor are equal ones."""
        hashes = np.fromiter(map(hash, some), np.int64, len(some))
        at = hashes & self.mask
        out = np.where(self.keys[at] == hashes, self.values[at], UNKNOWN).astype(np.int64)
        holes = np.flatnonzero(out == UNKNOWN)
        new, first, back = np.unique(hashes[holes], return_index=True, return_inverse=True)
        data = packed(list(map(some.__getitem__, holes[first].tolist())))
        saved = ordinary.lengths(data) - toxic.lengths(data)
        out[holes] = saved[back]
        self.keys[new & self.mask], self.values[new & self.mask] = new, saved
        return out


class _Scorer:
    """Features of texts, those of each shape of windows side by side; tables of words and of phrases serve later slices and tasks."""

    def __init__(self, model: ToxicityModel, keep: int = 1 << 18):
        self.plain, self.toxic, self.shapes = Compressor(model.ordinary), Compressor(model.toxic), model.shapes
        self.tables = textops.cached(("toxicity", model.ordinary, model.toxic, model.shapes, keep), lambda: [Table(keep) for _ in model.shapes])

    def features(self, texts: list[str]) -> np.ndarray:
        parts, out = [pieces(t) for t in texts], []
        for table, (width, step) in zip(self.tables, self.shapes, strict=True):
            flat: list[str] = []
            ends = [0]
            for p in parts:
                flat += joined(p, width, step)
                ends.append(len(flat))
            out.append(features(table.savings(self.plain, self.toxic, flat), np.diff(np.array(ends, dtype=np.int64))))
        return np.hstack(out)


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.02] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _losses(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def _marked(pool: list[str], plain: list[str], ordinary: Compressor, toxic: Compressor, lift: float) -> list[str]:
    """The windows of toxic texts at the least saving that is `lift` times as frequent there as in ordinary texts."""
    a, b = savings(ordinary, toxic, pool), savings(ordinary, toxic, plain)
    for level in range(1, 41):
        if (a >= level).mean() >= lift * max((b >= level).mean(), 1 / len(b)):
            return [w for w, s in zip(pool, a.tolist(), strict=True) if s >= level]
    return []


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]], sizes: tuple[int, int], lift: float, rounds: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs (ordinary, toxic) of dictionaries, each round's.

    The toxic texts come in two halves. A dictionary trained on one half marks windows of the other that it
    shortens and that ordinary texts seldom have; the next is trained on these. What a text says by chance is
    not in the other half, so the windows that stay hold what toxic texts have in common. ordinary: windows
    that train its dictionary, and others that only tell how often ordinary text saves as much.
    """
    base = train(ordinary[0], sizes[0])
    plain, now = Compressor(base), toxic
    yield base, train([w for half in now for w in half], sizes[1])
    for _ in range(rounds):
        made = [Compressor(train(half, sizes[1])) for half in now]
        found = [_marked(toxic[1 - k], ordinary[1], plain, made[k], lift) for k in (1, 0)]
        now = [f if len(f) >= 20 else old for f, old in zip(found, now, strict=True)]
        yield base, train([w for half in now for w in half], sizes[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 2000, sample_bytes: int = 5_000_000, sizes: tuple[int, int] = (32_768, 8_192), lift: float = 12.0, rounds: int = 3, shapes: tuple[tuple[int, int], ...] = SHAPES) -> ToxicityModel:
    """Trains on at most `sample` labelled documents and sample_bytes of text of either class, by the hash of their keys.

    Three quarters of them (by another hash) train the dictionaries, of sizes[0] bytes for ordinary and
    sizes[1] for toxic text, on windows of two words that overlap; the rest calibrates the savings of windows
    of all `shapes` (words, step), which texts are scored by, and tells which round's pair of dictionaries to
    keep, at any size of the input. Of texts that are equal one is taken. Labels that are null or other than 0 and 1 are
    left out. Without documents of both classes in both parts the score is the share of toxic ones (0
    without any).
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(sample) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # 2 * sample rows at most, small enough to broadcast
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), F.octet_length(body).alias("bytes")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("text").agg(F.min(F.struct("key", "label", "bytes")).alias("r")).select("text", "r.*")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("bytes").over(so_far)).where(F.col("sum") <= sample_bytes).orderBy("key").select("key", "text", "label").collect()
    share = dict(known.groupBy("label").count().collect())
    prior = share.get(1, 0) / max(1, sum(share.values())) if rows else 0.0
    part: dict[tuple[int, int], list[str]] = {(k, p): [] for k in (0, 1) for p in range(8)}
    for r in rows:
        part[r["label"], int(textops.crc_of_id([f"part {r['key']}"])[0] % 8)].append(r["text"])
    taken = lambda k, some: [t for p in some for t in part[k, p]]
    once: dict[str, str] = {}
    flat = lambda texts: [once.setdefault(w, w) for t in texts for w in windows(t, 2)]
    rest = [(t, k) for k in (0, 1) for t in taken(k, (6, 7))]
    toxic, ordinary = [flat(taken(1, (0, 1, 2))), flat(taken(1, (3, 4, 5)))], [flat(taken(0, (0, 1, 2, 3))), flat(taken(0, (4, 5)))]
    if not all(toxic) or not all(ordinary) or len({k for _, k in rest}) < 2:
        return ToxicityModel(b"", b"", (), prior)
    y = np.array([k for _, k in rest], dtype=float)
    best: tuple[float, ToxicityModel] | None = None
    odds = lambda a, b: math.log(max(a, 0.5) / max(b, 0.5))
    for plain, marked in dictionaries(toxic, ordinary, sizes, lift, rounds):
        model = ToxicityModel(plain, marked, (), prior, shapes)
        z = _Scorer(model).features([t for t, _ in rest])
        w = _calibrate(z, y)
        loss = _losses(z, y, w)
        if best is None or loss < best[0]:
            w[0] += odds(share.get(1, 0), share.get(0, 0)) - odds(y.sum(), len(y) - y.sum())  # the sample's classes are of other sizes than the table's
            best = (loss, replace(model, weights=tuple(map(float, w))))
    return best[1]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Scores every whole text: all columns of docs, and those named in `into`: the score (0 to 1) and 1 from 0.5 on, else 0.

    Windows are those of model.shapes over the whole text, lower-cased. A null or empty text has no windows and gets the score
    of no saving. Repeated rows and null keys come back as they are; an empty table gives none. Columns
    that have the names in `into` are replaced; all others stay.
    """
    keep = docs.drop(*into)
    at = keep.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        w = np.array(model.weights)
        for part in textops.slices(batches, text):
            texts = [t or "" for t in part.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(w[0] + scorer.features(texts) @ w[1:], -30, 30))) if len(w) else np.full(len(texts), model.prior)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*part.schema.names, *into])

    return keep.mapInArrow(run, textops.with_fields(keep, f"`{into[0]}` double, `{into[1]}` int"))
