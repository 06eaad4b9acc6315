"""Benchmark decontamination by greedy string tiling with running Karp-Rabin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

MATCH = "array<struct<item_id:bigint,n_words:bigint,n_matched:bigint,n_tiles:bigint,coverage:double>>"
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_APART = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def _words(texts: pa.Array) -> textops.Words:
    """Runs of letters, their marks and digits, lower-cased in every script; single characters in scripts without spaces."""
    texts = pc.utf8_lower(texts.fill_null(""))
    odd = pc.invert(pc.string_is_ascii(texts))
    if pc.any(odd).as_py():
        parted = pc.replace_substring_regex(texts.filter(odd), _APART, " ")
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(parted, _UNSPACED, r" \1 "))
    return textops.Words(texts, textops.ALNUM_ONLY)


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of every window of size words, modulo 2**64, by Horner's rule over the window."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(_BASE & _MASK) + words[k : k + n]
    return out


class _Rolled:
    """Karp-Rabin hashes of any window of a text and an item, from running hashes of their prefixes."""

    def __init__(self, text: np.ndarray, item: np.ndarray):
        self.text, self.item = text, item
        self.powers = np.ones(max(len(text), len(item)) + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(len(self.powers) - 1, _BASE & _MASK, np.uint64))
        self.sums = [self._prefixes(x) for x in (text, item)]

    def _prefixes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint64)
        np.add.accumulate(words * self.powers[: len(words)], out=out[1:])
        return out

    def equal(self, t: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the windows of n words at t and i have the same hash: both are brought to the same power."""
        a, b = self.sums[0][t + n] - self.sums[0][t], self.sums[1][i + n] - self.sums[1][i]
        return a * self.powers[np.maximum(i - t, 0)] == b * self.powers[np.maximum(t - i, 0)]

    def extents(self, t: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How far the text from t and the item from i are equal, by halving the search length."""
        low, high = np.zeros(len(t), np.int64), np.minimum(len(self.text) - t, len(self.item) - i)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(t, i, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _runs(text: np.ndarray, item: np.ndarray, least: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every maximal equal run (text start, item start, length) of least words or more.

    Windows of least words meet by their hashes, a block of meetings at a time; only the first window of a run is kept.
    """
    at_item, at_text = _rolling(item, least), _rolling(text, least)
    order = np.argsort(at_item, kind="stable")
    low, high = (np.searchsorted(at_item[order], at_text, side) for side in ("left", "right"))
    n = high - low
    rolled, ends, found, done = _Rolled(text, item), np.cumsum(n), [], 0
    while done < len(n):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block, "right")))
        t = np.repeat(np.arange(done, to), n[done:to])
        i = order[np.repeat(low[done:to], n[done:to]) + np.arange(len(t)) - np.repeat(np.cumsum(n[done:to]) - n[done:to], n[done:to])]
        first = (t == 0) | (i == 0) | (text[t - 1] != item[i - 1])
        t, i = t[first], i[first]
        found.append((t, i, rolled.extents(t, i)))
        done = to
    t, i, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keep = size >= least
    return t[keep], i[keep], size[keep]


def _free_parts(t: np.ndarray, i: np.ndarray, n: np.ndarray, taken_text: np.ndarray, taken_item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of least words or more of runs in which neither side is marked."""
    out = []
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) >> 22)) + 1):  # some millions of words at a time
        first = np.cumsum(n[k]) - n[k]
        run = np.repeat(np.arange(len(k)), n[k])
        at = np.arange(len(run)) - first[run]
        free = ~(taken_text[t[k][run] + at] | taken_item[i[k][run] + at])
        begins = np.flatnonzero(free & ~(np.concatenate([[False], free[:-1]]) & (at > 0)))
        stops = np.flatnonzero(free & ~(np.concatenate([free[1:], [False]]) & (at < n[k][run] - 1))) + 1
        some = stops - begins >= least
        begins, stops = begins[some], stops[some]
        out.append((t[k][run[begins]] + at[begins], i[k][run[begins]] + at[begins], stops - begins))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping equal runs (text start, item start, length) of least words or more, the longest first.

    Again and again the longest runs are marked, ties by place in the text, then in the item; a run that a mark
    cuts goes on as its unmarked parts. Words are compared before they are marked, so equal hashes alone
    never make a tile.
    """
    taken_text, taken_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    t, i, n = _runs(text, item, least) if min(len(text), len(item)) >= least else (np.zeros(0, np.int64),) * 3
    while len(n):
        size = int(n.max())
        level = n == size
        now, rest = (t[level], i[level], n[level]), (t[~level], i[~level], n[~level])
        marks_text, marks_item = np.concatenate([[0], np.cumsum(taken_text)]), np.concatenate([[0], np.cumsum(taken_item)])
        whole = (marks_text[now[0] + size] == marks_text[now[0]]) & (marks_item[now[1] + size] == marks_item[now[1]])
        for k in np.flatnonzero(whole)[np.lexsort((now[1][whole], now[0][whole]))].tolist():
            a, b = int(now[0][k]), int(now[1][k])
            if taken_text[a : a + size].any() or taken_item[b : b + size].any() or not np.array_equal(text[a : a + size], item[b : b + size]):
                continue
            taken_text[a : a + size] = taken_item[b : b + size] = True
            tiles.append((a, b, size))
        if len(item) - taken_item.sum() < least:
            break
        parts = _free_parts(*now, taken_text, taken_item, least)
        same = parts[2] == size  # only runs whose words differ under one hash are left whole
        t, i, n = (np.concatenate([x, y[~same]]) for x, y in zip(rest, parts, strict=True))
    return tiles


class Benchmark:
    """Items as word hashes, and the places of their seeds (every run of `least` words) in order of the seeds' hashes."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        words = _words(pa.array([t or "" for t in texts], pa.string()))
        self.least, self.ids, self.words, self.ends = least, ids, words.hash, words.last
        seeds = textops.chained(words.hash, least)
        item = np.searchsorted(words.last, np.arange(len(seeds)), "right")
        inside = np.flatnonzero(np.arange(len(seeds)) + least <= words.last[item]) if len(seeds) else np.zeros(0, np.int64)
        order = inside[np.argsort(seeds[inside], kind="stable")]
        self.sorted, self.first = np.unique(seeds[order], return_index=True)
        self.last = np.append(self.first[1:], len(order)).astype(np.int64)
        self.place, self.of = order.astype(np.int32), item[order].astype(np.int32)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.sorted & np.uint64((1 << 20) - 1)] = True

    def item(self, k: int) -> np.ndarray:
        return self.words[self.ends[k - 1] if k else 0 : self.ends[k]]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.sieve[grams & np.uint64((1 << 20) - 1)])
        return maybe[np.isin(grams[maybe], self.sorted)]

    def matches(self, text: np.ndarray, at: np.ndarray, grams: np.ndarray, threshold: float) -> list[dict]:
        """Tiles the text with every item that its seeds (at, with their hashes) could cover to the threshold."""
        seed = np.searchsorted(self.sorted, np.unique(grams))
        n = self.last[seed] - self.first[seed]
        post = np.repeat(self.first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        post = post[np.lexsort((self.place[post], self.of[post]))]
        of, place = self.of[post], self.place[post]
        cut = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = int(of[a])
            item = self.item(k)
            if self.least + np.minimum(np.diff(place[a:b]), self.least).sum() < threshold * len(item):
                continue
            start = self.ends[k - 1] if k else 0
            own = textops.chained(item, self.least)[place[a:b] - start]
            near = at[np.isin(grams, own)]
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, np.maximum(near - len(item), 0), 1)
            np.add.at(edge, np.minimum(near + self.least + len(item), len(text)), -1)
            places = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            gaps = np.flatnonzero(np.diff(places) > 1) + 1
            joined = np.insert(text[places], gaps, np.uint64(0))  # no word has the hash 0 in practice: a gap matches nothing
            tiles = greedy_tiles(joined, item, self.least)
            n_matched = sum(x[2] for x in tiles)
            if n_matched >= threshold * len(item):
                out.append({"item_id": self.ids[k], "n_words": len(item), "n_matched": n_matched, "n_tiles": len(tiles), "coverage": n_matched / len(item)})
        return out


def tile(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 5, threshold: float = 0.6, most_bytes: int = 8_000_000, into: str = "matches") -> DataFrame:
    """Adds to docs, as column `into`, the benchmark items of whose words the tiles in the text cover the threshold or more.

    Words are runs of letters and digits, lower-cased, and single characters in scripts without spaces. Tiles may
    stand anywhere in the text, so that passages in another order count. Items of fewer than `least` words or
    without a key, and null texts on either side, match nothing. Repeated rows are judged alike, each by itself;
    an empty table gives none. A benchmark of at most most_bytes of text goes to every task; a larger one is met
    by a join of seeds, with the same results. A column that has the name of `into` is replaced; all others stay.
    """
    spark = docs.sparkSession
    keep = docs.drop(into)
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0) <= most_bytes:
        rows = items.orderBy("item", "item_text").collect()  # most_bytes at most
        shared = spark.sparkContext.broadcast(Benchmark([r["item"] for r in rows], [r["item_text"] for r in rows], least))  # about five bytes for each byte of text
        at = keep.columns.index(text)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            textops.release()
            known = shared.value
            for part in textops.slices(batches, text):
                words = _words(part.column(at))
                grams = textops.chained(words.hash, least)
                where = known.hits(grams) if len(known.sorted) else np.zeros(0, int)
                doc = np.searchsorted(words.last, where, "right")
                inside = where + least <= words.last[doc] if len(where) else np.zeros(0, bool)
                where, doc = where[inside], doc[inside]
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d in np.unique(doc).tolist():
                    own = where[doc == d]
                    found[d] = sorted(known.matches(words.hash[words.first[d] : words.last[d]], own - words.first[d], grams[own], threshold), key=lambda m: tuple(m.values()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, into])

        return keep.mapInArrow(run, textops.with_fields(keep, f"`{into}` {MATCH}"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textops.slices(batches, "body"):
            words = _words(part.column("body"))
            grams = textops.chained(words.hash, least)
            doc = np.searchsorted(words.last, np.arange(len(grams)), "right")
            inside = np.arange(len(grams)) + least <= words.last[doc] if len(grams) else np.zeros(0, bool)
            doc = doc[inside]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(grams[inside].view(np.int64)), pa.array((words.last - words.first)[doc])], ["id", "seed", "n_words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for r in part.to_pylist():
                one = Benchmark([r["item"]], [r["item_text"]], least)
                words = _words(pa.array([r["body"]]))
                grams = textops.chained(words.hash, least)
                where = one.hits(grams)
                for m in one.matches(words.hash, where, grams[where], threshold):
                    yield pa.RecordBatch.from_pylist([{"id": r["id"], **m}])

    home, row, number = textops.shared_dir(spark), textops.unused(keep, "row"), F.monotonically_increasing_id()
    keep = textops.stored(keep.withColumn(row, number), f"{home}/docs")
    items = textops.stored(items.withColumn("number", number), f"{home}/items")
    slim = keep.select(F.col(row).alias("id"), F.col(text).alias("body")).where("body IS NOT NULL")
    spread = lambda df: df.mapInArrow(seeds, "id long, seed long, n_words long").groupBy("id", "seed").agg(F.count("*").alias("places"), F.first("n_words").alias("n_words"))
    in_items = spread(items.select(F.col("number").alias("id"), F.col("item_text").alias("body"))).withColumnRenamed("id", "number")
    # A seed that is met covers at most `least` words at each of its places: pairs that can't reach the threshold carry no text.
    met = spread(slim).select("id", "seed").join(in_items, "seed").groupBy("id", "number", "n_words").agg(F.sum("places").alias("places"))
    pairs = met.where(F.col("places") * least >= F.col("n_words") * threshold).select("id", "number")
    judged = pairs.join(slim, "id").join(items, "number").select("id", "body", "item", "item_text").mapInArrow(judge, "id long, item_id long, n_words long, n_matched long, n_tiles long, coverage double")
    lists = judged.groupBy(F.col("id").alias(row)).agg(F.sort_array(F.collect_list(F.struct("item_id", "n_words", "n_matched", "n_tiles", "coverage"))).alias(into))
    return keep.join(lists, row, "left").drop(row).withColumn(into, F.coalesce(into, F.array().cast(MATCH)))
