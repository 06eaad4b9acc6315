"""Token-id files as wavelet matrices: succinct bit planes with rank and select, one compressed row for each shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops

BLOCK = 512
SHARD_BYTES = 2_000_000
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class WaveletMatrix:
    """Bit planes of a sequence, the highest bit first; below each plane the zeros come before the ones, in order.

    `ranks` has, for every BLOCK bits of a plane, the ones before it.
    """

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes]):
        self.n, self.width = n, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]
        self.zeros = [n - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in self.planes]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now, planes, ranks = ids.astype(np.uint16 if width <= 16 else np.uint32), [], []
        for bit in range(width - 1, -1, -1):
            one = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(one)
            whole = np.zeros(-(-max(len(packed), 1) // (BLOCK // 8)) * (BLOCK // 64), np.uint64)
            whole.view(np.uint8)[: len(packed)] = packed
            sums = np.bitwise_count(whole).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(sums) - sums).astype("<u4").tobytes())
            now = np.concatenate([now.compress(~one), now.compress(one)])
        return cls(len(ids), planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, plane = i // BLOCK, self.planes[level]
        got = int(self.ranks[level][block]) + int(_POP[plane[block * (BLOCK // 8) : i >> 3]].sum())
        return got + (int(_POP[plane[i >> 3] >> (8 - (i & 7))]) if i & 7 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often value occurs among the first i tokens."""
        if value >> self.width:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of occurrence k (from 0) of value; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        lo, hi = k, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(value, mid + 1) > k else (mid + 1, hi)
        return lo

    def decode(self) -> np.ndarray:
        """All tokens, undoing the planes from the lowest up."""
        now = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~one)] = now[: self.zeros[level]]
            up[np.flatnonzero(one)] = now[self.zeros[level] :] | (1 << (self.width - 1 - level))
            now = up
        return now


FILE_SCHEMA = "part int, shard int, doc_keys array<long>, doc_tokens array<long>, n_tokens long, planes array<binary>, ranks array<binary>"


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending key order below path and returns the files' rows.

    A document is its ids by the tokenizers file, then end_id; null or empty texts are end_id alone. The
    documents are dealt by ranges of key (null keys first) and each task writes shards of about 2 MB of
    text: FILE_SCHEMA, with zstandard in Parquet. Repeated keys keep all rows, ordered by text; an empty
    table gives empty files; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part_id = textops.encoder(tokenizer, False), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        for shard, part in enumerate(textops.slices(batches, "text", SHARD_BYTES)):
            ids = [i + end for i in enc.encode([t or "" for t in part.column("text").to_pylist()])]
            sizes = [len(i) // 4 for i in ids]
            wm = WaveletMatrix.of(np.frombuffer(b"".join(ids), "<u4"))
            yield pa.RecordBatch.from_pylist(
                [{"part": part_id, "shard": shard, "doc_keys": part.column("key").to_pylist(), "doc_tokens": sizes, "n_tokens": wm.n, "planes": [p.tobytes() for p in wm.planes], "ranks": [r.tobytes() for r in wm.ranks]}],
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_keys", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]),
            )

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").repartitionByRange("key").sortWithinPartitions("key", "text")
    rows.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)
    return read_files(docs.sparkSession, path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_ids(files: DataFrame, key: str = "doc_id", most_broadcast: int = 200_000) -> DataFrame:
    """Documents read back from the bit planes: key, start (ids of all documents before), n_tokens, ids (binary uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                data = WaveletMatrix(r["n_tokens"], r["planes"], r["ranks"]).decode().astype("<u4").tobytes()
                sizes = np.array(r["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = [data[(e - n) * 4 : e * 4] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()), pa.array(r["doc_keys"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())],
                    ["part", "shard", "key", "within", "n_tokens", "ids"],
                )

    size = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    at = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("shard_start")).join(at, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    docs = files.mapInArrow(run, "part int, shard int, key long, within long, n_tokens long, ids binary")
    if files.count() <= most_broadcast:  # a row of 16 bytes for each shard; more of them are met by a shuffled join
        starts = F.broadcast(starts)
    return docs.join(starts, ["part", "shard"]).select(F.col("key").alias(key), (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids")
