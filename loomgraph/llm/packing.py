"""Packing of documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textops


def closest_fill(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> dict[int, int]:
    """The multiset of lengths, with the largest among them, whose sum comes closest to capacity from below.

    Subset sums are the bits of one integer, shifted once for each copy; the way back through the stored
    integers gives how many of each length were taken. order, if given, has all lengths from the longest
    down, and may have some that are used up.
    """
    order = sorted(counts, reverse=True) if order is None else order
    first = next(n for n in order if n in counts)
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for n in order:
        if n > room or n not in counts:
            continue
        for _ in range(min(counts[n] - (n == first), room // n)):
            grown = (reach | (reach << n)) & mask
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    taken, at = defaultdict(int, {first: 1}), reach.bit_length() - 1
    for n, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += 1
            at -= n
    return taken


class Packer:
    """Collects remainders of documents and hands out full sequences; a piece is (document, start, ids, total)."""

    def __init__(self, capacity: int, reserve: int):
        self.capacity, self.reserve = capacity, reserve
        self.pool: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.held = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pool[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.held += n

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.held -= n
        return self.pool[n].pop()

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Full sequences while more than the reserve is held; at the end all, of which the final one may be short."""
        order = sorted(self.counts, reverse=True)
        while self.counts and (last or self.held > self.reserve):
            while order[0] not in self.counts:
                del order[0]
            fill = closest_fill(self.counts, self.capacity, order)
            slack = self.capacity - sum(n * c for n, c in fill.items())
            times = min(self.counts[n] // c for n, c in fill.items())
            if slack:
                times = 1
            for _ in range(times):
                seq = [self.take(n) for n, c in fill.items() for _ in range(c)]
                if slack and self.counts:  # every piece left is longer than the slack
                    doc, start, ids, total = self.take(min(self.counts))
                    seq.append((doc, start, ids[: slack * 4], total))
                    self.add((doc, start + slack, ids[slack * 4 :], total))
                    order = sorted(self.counts, reverse=True)
                yield seq


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents, packed into sequences of at most capacity tokens.

    A document is its token ids by the tokenizers file, then end_id; a null or empty text is end_id alone.
    Whole sequences are cut off first; the remaining lengths are put together by minimum bin slack. Where
    no multiset of lengths fills a sequence, one piece is cut to fit, so that only the last sequence of a
    task has padding. Each task packs its own documents, without a shuffle, holding one slice of texts and
    a reserve of 64 sequences at most.

    Columns: key, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).
    sequence_id is the task's number times 2**40 and a count. Repeated rows are packed as often as they
    occur; null keys are kept; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, at = textops.encoder(tokenizer, True), Packer(capacity, 64 * capacity), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def put(seq: list[tuple]) -> None:
            nonlocal at
            offset = 0
            for doc, start, ids, total in seq:
                rows.append((doc, start, len(ids) // 4, total, at, offset, ids))
                offset += len(ids) // 4
            at += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        kind = None
        for part in textops.slices(batches, "text"):
            kind = part.schema.field("key").type
            for doc, ids in zip(part.column("key").to_pylist(), enc.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids += end
                total, step = len(ids) // 4, capacity * 4
                full = total // capacity
                for k in range(full):
                    put([(doc, k * capacity, ids[k * step : (k + 1) * step], total)])
                if total % capacity:
                    packer.add((doc, full * capacity, ids[full * step :], total))
            for seq in packer.sequences(False):
                put(seq)
            if rows:
                yield out()
        for seq in packer.sequences(True):
            put(seq)
        if rows:
            yield out()

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("key", key)
