"""Exact n-gram Jaccard join of whole texts by prefix trees.

An n-gram's token orders all n-grams by how common they are (a sketch of fixed size over all documents, then
the hash). Texts with equal sets are one class with one representative. Two sets that link share one of their
rarest n-grams (the prefix), so prefixes propose pairs; each pair is decided on whole sets by walking a prefix
tree of the sets that one probe meets, in which sets share the overlap of their common path and are left as
soon as the words that remain cannot reach the similarity.

Proposals come in two rounds. First every representative is compared with one that shares most of its
prefix; this joins most copies. Then every pair that shares a prefix n-gram, lies in two different components
and may still link by its lengths and shared prefix is compared. Pairs inside one component need no proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components, textops

SKETCH, BLOCK = 1 << 20, 1 << 14
MEMBERS, HOT, PAIRED = 512, 10_000, 512


def doc_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; of all words, if it has fewer."""
    words = textops.Words(texts)
    grams = textops.chained(words.hash, width)
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(textops.chained(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def ordered(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tokens in global order: the commonest n-grams first, then by hash."""
    code = codes[grams & np.uint64(SKETCH - 1)]
    return np.sort((np.uint64(255) - code.astype(np.uint64)) << np.uint64(56) | grams >> np.uint64(8))


def prefix_size(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - (percent * n + 99) // 100 + 1


class Trie:
    """Ordered sets as a path-compressed prefix tree.

    Sets lie in lexicographic order; a node is a range of them that agree up to its depth, with the sizes of the
    smallest and the largest set below it.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.ids, self.sets = [ids[k] for k in order], [sets[k] for k in order]
        shared = [0] * len(order)  # how far each set agrees with the one before
        for k in range(1, len(order)):
            a, b = self.sets[k - 1], self.sets[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[k] = int(differ[0]) if len(differ) else n
        self.nodes: list[tuple] = []  # first set, depths it spans, least and most tokens, where the sets that end here stop, children
        self.roots: list[int] = []
        todo = [(0, len(order), 0, self.roots)] if order else []
        while todo:
            low, high, depth, children = todo.pop()
            cuts = [low, *(k for k in range(low + 1, high) if shared[k] <= depth), high]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                to = min(shared[i + 1 : j], default=len(self.sets[i]))
                sizes = [len(s) for s in self.sets[i:j]]
                stop = i + next((k for k, n in enumerate(sizes) if n > to), j - i)
                children.append(len(self.nodes))
                self.nodes.append((i, depth, to, min(sizes), max(sizes), stop, below := []))
                if stop < j:
                    todo.append((stop, j, to, below))

    def links(self, probe: np.ndarray, percent: int) -> Iterator[int]:
        """Ids of the sets whose overlap with the probe is percent of the union or more.

        A node's tokens are looked up once for all sets below it; it is left with all of them as soon as the
        tokens that remain, of the probe or of the largest set, can't make up what the smallest set needs.
        """
        need = lambda n: -(-percent * (n + len(probe)) // (100 + percent))
        self.visited = 0
        todo = [(k, 0, 0) for k in self.roots]  # node, overlap so far, tokens of the probe that are passed
        while todo:
            k, held, passed = todo.pop()
            first, depth, to, least, most, stop, children = self.nodes[k]
            if held + min(most - depth, len(probe) - passed) < need(least):
                continue
            self.visited += 1
            tokens = self.sets[first][depth:to]
            if len(tokens):
                at = np.searchsorted(probe, tokens)
                inside = at < len(probe)
                held += int((probe[at[inside]] == tokens[inside]).sum())
                passed = int(np.searchsorted(probe, tokens[-1], "right"))
            if held >= need(to):
                yield from self.ids[first:stop]
            todo += [(c, held, passed) for c in children]


def _sketch_and_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (id, n, s1, s2) and, with a null n, blocks of each task's n-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.release()
        counts = np.zeros(SKETCH, np.int64)
        names = ["id", "n", "s1", "s2", "block", "counts"]
        for part in textops.slices(batches, "text"):
            sets = doc_sets(part.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            s1 = np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            s2 = np.array([int(textops.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            if len(sets):
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(s1), pa.array(s2), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        for k in range(SKETCH // BLOCK):
            block = counts[k * BLOCK : (k + 1) * BLOCK]
            if block.any():
                yield pa.RecordBatch.from_pylist([{"id": None, "n": None, "s1": None, "s2": None, "block": k, "counts": np.minimum(block, 65535).astype("<u2").tobytes()}], schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())]))

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, block int, counts binary")


def _codes(blocks: DataFrame) -> np.ndarray:
    """One byte for each counter: eight times the binary logarithm of its total. SKETCH bytes come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c, "<u2").astype(np.int64)
        for k, c in total.items():
            yield pa.RecordBatch.from_pylist([{"block": k, "counts": np.minimum(255, 8 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes()}], schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    codes = np.zeros(SKETCH, np.uint8)
    for r in blocks.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        codes[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return codes


def _compatible(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _of_tokens(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the columns of stats (token, size, ...) for those tokens that stats has; size counts a token's rows.

    A token that holds more than a HOT-th of all rows, of which there are HOT at most, goes to every task instead
    of drawing its rows into one.
    """
    bound = rows.count() / HOT
    hot = stats.where(F.col("size") > bound)
    cold = rows.join(F.broadcast(hot.select("token")), "token", "left_anti").join(stats.where(F.col("size") <= bound), "token")
    return rows.join(F.broadcast(hot), "token").unionByName(cold)


def _verify(pairs: DataFrame, docs: DataFrame, codes, width: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose whole sets link. Each probe a meets its partners in blocks of about MEMBERS sets."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m"))
    salted = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / MEMBERS)).cast("int"))
    to = salted.select(F.col("b").alias("id"), F.col("a").alias("probe"), "salt", F.lit(1).alias("role")).unionByName(salted.select(F.col("a").alias("id"), F.col("a").alias("probe"), "salt", F.lit(0).alias("role")).distinct())
    rows = docs.join(to.hint("merge"), "id").select("probe", "salt", "role", "id", "text").repartition("probe", "salt").sortWithinPartitions("probe", "salt", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe = None, np.zeros(0, np.uint64)
        ids: list[int] = []
        sets: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal size
            hits = list(Trie(ids, sets).links(probe, percent))
            a = key[0] if key else None
            ids.clear()
            sets.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([a] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["a", "b"])

        for part in textops.slices(batches, "text"):
            found = doc_sets(part.column("text"), width)
            cols = [part.column(c).to_pylist() for c in ("probe", "salt", "role", "id")]
            for p, salt, role, i, s in zip(*cols, found, strict=True):
                s = ordered(s, codes.value)
                if (p, salt) != key or size > 2_000_000:
                    if ids:
                        yield done()
                    key = (p, salt)
                if role == 0:
                    probe = s
                else:
                    ids.append(i)
                    sets.append(s)
                    size += len(s)
        if ids:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """For each document: key, n_shingles (size of its set) and component_id (the smallest key that links reach).

    Words are runs without ASCII white space, A-Z lower-cased; the set is the distinct runs of `width` words,
    with fewer words all of them as one. Documents link when 100 * intersection >= percent * union. A null or
    empty text has an empty set and links with nothing. Rows with a null key come back with a null component
    and link nothing. Rows that repeat a key with the same set come back each; if their sets differ, each
    set counts under that key. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    home = textops.shared_dir(spark)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    passed = textops.stored(_sketch_and_sets(slim, width), f"{home}/sets")
    sets = passed.where("n IS NOT NULL").select("id", "n", "s1", "s2")
    codes = spark.sparkContext.broadcast(_codes(passed.where("n IS NULL AND block IS NOT NULL").select("block", "counts")))
    classes = textops.stored(sets.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), f"{home}/classes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textops.slices(batches, "text"):
            found = [ordered(s, codes.value) for s in doc_sets(part.column("text"), width)]
            heads = [(s[len(s) - prefix_size(len(s), percent) :] ^ np.uint64(1 << 63)).view(np.int64) if len(s) else s.view(np.int64) for s in found]  # signed order is that of the tokens
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array([len(s) for s in found], np.int64)), tokens], ["id", "n", "tokens"])

    heads = slim.where("id IS NOT NULL").mapInArrow(prefixes, "id long, n long, tokens array<long>")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    posts = textops.stored(heads.join(reps, "id", "left_semi").select("id", "n", F.get("tokens", F.lit(0)).alias("last"), F.explode("tokens").alias("token")), f"{home}/posts")
    met_by = textops.stored(posts.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), f"{home}/met_by")
    shared = textops.stored(_of_tokens(posts, met_by).drop("size"), f"{home}/shared")
    # An n-gram of x's prefix that no other prefix has is not in any y whose prefix reaches as far or farther, so
    # the overlap with y is at most n - own, own being the number of these.
    alone = shared.groupBy("id", "n").agg(F.count("*").alias("k")).select("id", (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - F.col("k")).alias("own"))
    shared = textops.stored(shared.join(alone, "id"), f"{home}/owned")
    # The text with the fewest n-grams of its own is likely the one that the others were made from.
    firsts = textops.stored(shared.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("own", "id", "n")).alias("first")), f"{home}/firsts")
    centre = _of_tokens(shared, firsts)

    proposals = centre.where((F.col("first.id") != F.col("id")) & _compatible(F.col("n"), F.col("first.n"), percent)).groupBy("id", F.col("first.id").alias("a")).agg(F.count("*").alias("c"))
    best = proposals.groupBy("id").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", F.col("id").alias("b"))
    near = textops.stored(_verify(textops.stored(best, f"{home}/pairs1"), slim, codes, width, percent), f"{home}/links1")
    comps = components.components(near, f"{home}/cc1")

    placed = textops.stored(shared.select("token", "id", "n", "last", "own").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), f"{home}/placed")
    apart = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", "size")
    mixed = _of_tokens(placed, textops.stored(apart, f"{home}/apart"))
    # Pairs must share `least` tokens of their prefixes; the rarest shared one then has as many behind it in both.
    own = Window.partitionBy("id")
    mixed = mixed.withColumn("rank", F.row_number().over(own.orderBy(F.desc("token")))).withColumn("k", F.count("*").over(own))
    mixed = textops.stored(mixed.select("token", "id", "n", "last", "component", (F.col("n") - F.col("own")).alias("most"), "rank", "k", F.ceil(F.col("size") / PAIRED).cast("int").alias("parts")), f"{home}/mixed")
    # One side of a token's pairs is dealt to parts of about PAIRED rows, the other goes to each of them.
    side = lambda x: mixed.select("token", F.pmod(F.hash("id"), F.col("parts")).alias("part") if x == "x" else F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "last", "component", "most", "rank", "k")])
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    rest = lambda x: F.floor((F.col(f"n_{x}") * percent + 99) / 100) - 1  # noqa: E731  what lies behind the prefix
    least = F.greatest(need - F.greatest(rest("x"), rest("y")), F.lit(1))
    early = lambda x: F.col(f"rank_{x}") <= F.col(f"k_{x}") - least + 1
    met = (
        side("x")
        .join(side("y"), ["token", "part"])
        .where((F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & _compatible(F.col("n_x"), F.col("n_y"), percent))
        .where((F.when(F.col("last_x") >= F.col("last_y"), F.col("most_x")).otherwise(F.col("most_y")) >= need) & early("x") & early("y"))
        .select("id_x", "id_y", least.alias("least"))
        .distinct()
    )
    heads = mixed.groupBy("id").agg(F.collect_list("token").alias("tokens"))
    held = lambda x: heads.select(F.col("id").alias(f"id_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    pairs = met.join(held("x"), "id_x").join(held("y"), "id_y").where(F.size(F.array_intersect("tokens_x", "tokens_y")) >= F.col("least")).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))
    far = textops.stored(_verify(textops.stored(pairs, f"{home}/pairs2"), slim, codes, width, percent), f"{home}/links2")
    comps = components.components(near.unionByName(far), f"{home}/cc2")
    ranked = classes.join(comps, F.col("rep") == F.col("id"), "left").select("s1", "s2", F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component_id"))
    ranked = ranked.withColumnsRenamed({"s1": "c1", "s2": "c2"})
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("cn"))
    out = sets.join(ranked, same, "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
