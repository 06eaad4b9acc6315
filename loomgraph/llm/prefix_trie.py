"""Trie of conversations by their turns: what conversations share, and what sharing saves.

A node is a sequence of turns, owned by its smallest member. What a conversation owns is the rest of its path from
some depth on, since fewer conversations run through a deeper node. So a conversation adds to a node's subtree the turns
of its path below the node (occurrences) less those it owns, and one leaf if it owns one; sums over the node's members
give the subtree without walking it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import skew, textops

BLOCK = 1024
LEAD = 5  # fixed value: a conversation takes at most so many turns of its base


def _digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    return F.unhex(F.substr(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(1), F.lit(32)))


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, chars) of all turns of the rebuilt conversations, depth from 1, and (conv, total) of all of them.

    Conversation c takes the first h turns of conversation c - c % 100 and its own after its first h; h is crc32 of c's
    decimals mod 6. Turns go by turn (null first), then role and text; null roles and texts are empty; repeated rows
    are turns of their own; rows with a null conversation and other columns are left out; an empty table gives no
    rows. Turns are numbered over a sorted table, so that a conversation may lie in many tasks.
    """
    home = textops.shared_dir(turns.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    placed = skew.in_order(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], f"{home}/turns", "conv", _digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("bigint").alias("chars"))
    placed = placed.withColumn("part", F.shiftright("pos", skew.PART))
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("pos").alias("start"))
    parts = textops.stored(parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), f"{home}/parts")
    convs = parts.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 6).withColumn("base", F.col("conv") - F.col("conv") % 100)
    led = convs.join(convs.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("own").alias("held")), "base", "left").withColumn("lead", F.least("h", F.coalesce("held", F.lit(0))))
    led = textops.stored(led.withColumn("total", F.col("lead") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), f"{home}/convs")
    places = parts.select("conv", "part", "start", "before").join(led.select("conv", "h", "lead"), "conv")
    own = placed.join(places, ["conv", "part"]).withColumn("place", F.col("pos") - F.col("start") + F.col("before") + 1)
    own = textops.stored(own.select("conv", "place", "digest", "chars", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), (F.col("place") > F.col("h")).alias("kept")), f"{home}/own")
    heads = own.where(f"place <= {LEAD} AND conv % 100 = 0").select(F.col("conv").alias("base"), F.col("place").alias("depth"), "digest", "chars")
    lead = led.where("lead > 0").join(heads, "base").where("depth <= lead")
    fields = ["conv", "depth", "digest", "chars"]
    return own.where("kept").select(*fields).unionByName(lead.select(*fields)), led.select("conv", "total")


_CHAINED = "conv bigint, depth bigint, block bigint, chain binary, before binary, chars bigint, done bigint"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the hash of all digests of their block so far, that of the row before, and the sum of chars so far."""
    now, state, done = None, b"", 0
    for batch in batches:
        conv, depth, block, digest, chars = (c.to_pylist() for c in batch.columns)
        chains, befores, sums = [], [], []
        for c, b, d, n in zip(conv, block, digest, chars, strict=True):
            if (c, b) != now:
                now, state, done = (c, b), b"", 0
            befores.append(state)
            state = hashlib.blake2b(state + d, digest_size=16).digest()
            done += n
            chains.append(state)
            sums.append(done)
        columns = [*batch.columns[:3], pa.array(chains, pa.binary()), pa.array(befores, pa.binary()), batch.column(4), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _CHAINED.split(", ")])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block after a conversation's first: the hash and the sum of chars of all blocks before it."""
    now, seed, done = None, b"", 0
    for batch in batches:
        out = []
        for c, b, chain, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != now:
                now, seed, done = c, b"", 0
            seed, done = _after(seed, chain), done + n
            out.append((c, b + 1, seed, done))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "block", "seed", "sum"])


def _after(seed: bytes, chain: bytes) -> bytes:
    return hashlib.sha256(seed + chain).digest()[:16] if seed else chain


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the comma-joined conversations of each prefix, taken piece by piece as they come in order."""
    now, state = None, None
    for batch in batches:
        prefixes, convs, out = batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist(), []
        for prefix, group in groupby(zip(prefixes, convs, strict=True), itemgetter(0)):
            ids = ",".join(map(itemgetter(1), group)).encode()
            if state is not None and prefix == now:
                state.update(b"," + ids)
            else:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = prefix, hashlib.sha256(ids)
        yield _pairs(out)
    if state is not None:
        yield _pairs([(now, state.hexdigest())])


def _pairs(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["prefix", "ends_sha256"])


def _paths(turns: DataFrame, convs: DataFrame, home: str, block: int) -> DataFrame:
    """(conv, depth, prefix, parent, chars, done) of every node on every path, the root included; done is the sum of chars so far.

    Paths are hashed in blocks of depths; only a block's last hash goes on to the next one.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = turns.select("conv", "depth", F.floor((F.col("depth") - 1) / block).cast("bigint").alias("block"), "digest", "chars")
    chained = textops.stored(cut.repartition(n, "conv", "block").sortWithinPartitions("conv", "block", "depth").mapInArrow(_chain, _CHAINED), f"{home}/chained")
    full = chained.where(F.col("depth") % block == 0).select("conv", "block", "chain", "done")
    seeds = full.repartition(n, "conv").sortWithinPartitions("conv", "block").mapInArrow(_seeds, "conv bigint, block bigint, seed binary, sum bigint")
    late = chained.where("block > 0").join(seeds, ["conv", "block"])
    mixed = lambda c: F.unhex(F.substr(F.sha2(F.concat("seed", c), 256), F.lit(1), F.lit(32)))
    fields = ["conv", "depth", "prefix", "parent", "chars", "done"]
    early = chained.where("block = 0").select("conv", "depth", F.col("chain").alias("prefix"), F.col("before").alias("parent"), "chars", "done")
    late = late.select("conv", "depth", mixed("chain").alias("prefix"), F.when(F.length("before") == 0, F.col("seed")).otherwise(mixed("before")).alias("parent"), "chars", (F.col("done") + F.col("sum")).alias("done"))
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv", zero.alias("depth"), F.lit(b"").alias("prefix"), F.lit(None).cast("binary").alias("parent"), zero.alias("chars"), zero.alias("done"))
    return textops.stored(early.unionByName(late).unionByName(root).select(*fields), f"{home}/paths")


def nodes(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, depth, digest, chars), depths from 1 without gaps; convs: (conv, total), also those without turns.
    Without conversations there is no root. Prefixes are known by hashes of 128 bits. Windows over parts of a prefix's
    members, then over the smallest of each part, mark the owned nodes. Rows of a conversation meet what is known of it
    by block. The hash of the conversations that end in one node is taken in order by one task, row by row.
    """
    home = textops.shared_dir(turns.sparkSession)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = _paths(turns, convs, home, block)
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("conv"))
    some = paths.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(n))).withColumn("r", least("prefix", "salt")).where("r = 1")
    owned = textops.stored(some.withColumn("r", least("prefix")).where("r = 1").select("conv", "depth", "prefix", "parent", "chars", "done"), f"{home}/owned")
    children = owned.where("depth > 0").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    owned = textops.stored(owned.join(children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{home}/nodes")

    from_ = owned.groupBy("conv").agg(F.min("depth").alias("first"), F.min(F.col("done") - F.col("chars")).alias("foreign"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    ends = paths.groupBy("conv").agg(F.max("done").alias("all"))
    of = convs.join(ends, "conv").join(from_, "conv", "left").select("conv", "total", F.coalesce("first", F.col("total") + 1).alias("first"), F.coalesce("foreign", "all").alias("foreign"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    of = of.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("total") / block))))
    occurrences = textops.stored(paths.withColumn("block", F.floor(F.col("depth") / block)).join(of, ["conv", "block"]).select("prefix", "conv", "leaf", F.when(F.col("depth") < F.col("first"), F.col("foreign") - F.col("done") + F.col("chars")).otherwise(0).alias("saved"), (F.col("depth") == F.col("total")).alias("end")), f"{home}/occurrences")
    sums = occurrences.groupBy("prefix").agg(F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = occurrences.where("end").select("prefix", "conv").repartition(n, "prefix").sortWithinPartitions("prefix", "conv").mapInArrow(_ends, "prefix binary, ends_sha256 string")

    over = owned.select(F.col("prefix").alias("parent"), F.col("conv").alias("parent_conv_id"))
    below = skew.joined(owned.where("depth > 0"), over, "parent")
    every = below.unionByName(owned.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    out = every.join(sums, "prefix").join(digests, "prefix", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("bigint").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
