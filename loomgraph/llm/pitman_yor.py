"""LM scoring by a hierarchical Pitman-Yor model of words after words, with seatings sampled dish by dish.

Every previous word is a restaurant of its own; all share one parent, the restaurant without context, over a
uniform base of the known words and one unknown. A dish (word) of a restaurant has customers c and tables t;
the tables of the children are the customers of the parent.

Entries (word, previous word) are dealt to buckets by their word, so that a word's counts at the parent are its
bucket's own. The totals of a previous word lie in many buckets: after every sweep each bucket sends the sums of
its own, by ranges of previous words, and gets the exact totals back. Between the buckets only these sums,
pre-aggregated, and at the end the probabilities that a slice of documents asked for, are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

#: The discount of both levels. At one half, the chance that a random one of c customers at t tables sits alone
#: is (t - 1) / (2c - t - 1), so that moves need no sizes of tables.
DISCOUNT = 0.5
STRENGTH = (100.0, 0.5)
END = np.uint64(0xE0D0C0B0A0908070)
BITS = 40  # of the hash of a previous word
_LOW = np.uint64((1 << BITS) - 1)
ROW = "kind string, bucket int, other long, a binary, b binary, c binary, x double, y double"
_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_NAMES = ("kind", "bucket", "other", "a", "b", "c", "x", "y")


def _table(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(_NAMES, _TYPES, strict=True))})


def _zip(a: np.ndarray, kind: str = "<u4") -> bytes:
    """An array's bytes by place, so that high zero bytes stand together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(a, kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T).tobytes())


def _unzip(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, "<u8"), dtype=np.uint64)


def move(t: np.ndarray, c: np.ndarray, fresh: np.ndarray, rng: np.random.Generator, moves: int) -> np.ndarray:
    """Gibbs moves, of which `draw` is the limit: up to `moves` times, a random customer of each dish leaves and is seated again given all others.

    Who sat alone takes the table along. A new table is taken with a chance in proportion to `fresh` (strength and
    discounted tables of the restaurant, times the dish's probability above), an old one in proportion to the
    customers left less the discount of each table. The only customer of a dish always has one table.
    """
    t = t.copy()
    for k in range(moves):
        a = np.flatnonzero(c > k + 1)
        if not len(a):
            break
        left = t[a] - (rng.random(len(a)) * (2 * c[a] - t[a] - 1) < t[a] - 1)
        f = fresh[a]
        t[a] = left + (rng.random(len(a)) * (f + c[a] - 1 - DISCOUNT * left) < f)
    return t


def draw(c: np.ndarray, fresh: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish of c customers, by their chances given all other dishes: what moves without end lead to.

    A new table beside t is taken in proportion to fresh + own * t, so that one table more is
    4 (fresh + own t) (c - t) / (t (2c - t - 1)) times as likely. From the likeliest number on, each next one takes the
    place of those before with its share of all weights so far, until weights are too small for double precision.
    """
    out = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    c, fresh, own = (np.broadcast_to(x, len(out))[many].astype(float) for x in (c, fresh, own))
    ratio = lambda i, t: 4 * (fresh[i] + own[i] * t) * (c[i] - t) / (t * (2 * c[i] - t - 1))
    b = 2 * c - 1 + 4 * fresh - 4 * own * c
    root = b * b - 16 * (1 - 4 * own) * fresh * c
    below = b + np.sqrt(np.maximum(root, 0))
    likeliest = np.where((root < 0) | (below <= 0), c, np.clip(np.floor(8 * fresh * c / np.where(below > 0, below, 1)) + 1, 1, c))
    picked, total = likeliest.copy(), np.ones(len(c))
    for up in (True, False):
        i, t, w = np.arange(len(c)), likeliest.copy(), np.ones(len(c))
        while True:
            on = t < c[i] if up else t > 1
            i, t, w = i[on], t[on] - (not up), w[on]
            w = w * ratio(i, t) if up else w / ratio(i, t)
            t = t + up
            on = w > total[i] * 1e-17
            i, t, w = i[on], t[on], w[on]
            if not len(i):
                break
            total[i] += w
            taken = rng.random(len(i)) * total[i] < w
            picked[i[taken]] = t[taken]
    out[many] = picked
    return out


def parent(c: np.ndarray, t: np.ndarray, c_all: float, t_all: float, known: float) -> np.ndarray:
    """Probabilities of words without context."""
    s = STRENGTH[0]
    return (c - DISCOUNT * t + (s + DISCOUNT * t_all) / (known + 1)) / (s + c_all)


def child(c: np.ndarray, t: np.ndarray, c_all: np.ndarray, t_all: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Probabilities of words after a previous word with c_all customers at t_all tables."""
    s = STRENGTH[1]
    return (c - DISCOUNT * t + (s + DISCOUNT * t_all) * above) / (s + c_all)


class Slice:
    """The entries of a slice of documents: distinct words in order, and for each its distinct previous words."""

    def __init__(self, part: pa.RecordBatch, folds: int, number: int):
        words = textops.Words(part.column("text"))
        self.ids, self.sizes = part.column("id"), words.last - words.first + 1
        self.held = textops.crc_of_id(self.ids.to_pylist()) % folds == 0
        word, before = np.insert(words.hash, words.last, END), np.insert(words.hash, words.first, END) >> np.uint64(64 - BITS)
        self.words, of = np.unique(word, return_inverse=True)
        keys, self.at = np.unique(of.astype(np.uint64) << np.uint64(BITS) | before, return_inverse=True)
        self.runs, self.before = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=len(self.words)), keys & _LOW
        self.counts = np.bincount(self.at[np.repeat(~self.held, self.sizes)], minlength=len(keys))
        context = TaskContext.get()
        self.number = (context.partitionId() if context else 0) << 40 | number << 24 | zlib.crc32(word.tobytes()) >> 8


def _slices(batches: Iterator[pa.RecordBatch], folds: int, size: int) -> Iterator[Slice]:
    """Slices of about `size` bytes of text, whole documents; the same for the same rows."""
    held: list[pa.RecordBatch] = []
    n = total = 0

    def done() -> Slice:
        nonlocal n, total
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        n, total = n + 1, 0
        return Slice(whole, folds, n - 1)

    for part in textops.slices(batches, "text", size):
        bytes_ = int(textops.lengths(part.column("text")).sum())
        if held and total + bytes_ > size:
            yield done()
        held.append(part)
        total += bytes_
    if held:
        yield done()


def _share(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n ranges of sorted keys of so many bits begins; the last place is the end."""
    top = (keys >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)
    return np.searchsorted(top, np.arange(n + 1, dtype=np.uint64))


def _totals(bucket: int, contexts: np.ndarray, n: int, *values: np.ndarray) -> list[tuple]:
    cut = _share(contexts, BITS, n)
    return [("totals", bucket, k, _zip_sorted(contexts[i:j]), *[_zip(v[i:j]) for v in values]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]


def gather(table: pa.Table, n: int) -> pa.Table:
    """One bucket's entries, from what all slices sent: its counts, the entries of each slice, and totals of previous words."""
    bucket = table.column("bucket")[0].as_py()
    lists = [_unzip_sorted(a) for a in table.column("a").to_pylist()]
    words = np.unique(np.concatenate(lists))
    own, keys, counts = [], [], []
    for w, b, c in zip(lists, table.column("b").to_pylist(), table.column("c").to_pylist(), strict=True):
        own.append(np.searchsorted(words, w).astype(np.uint64))
        runs, some = np.split(_unzip(b).astype(np.int64), [len(w)])
        keys.append(np.repeat(own[-1], runs) << np.uint64(BITS) | _unzip(c, "<u8"))
        counts.append(some)
    first, every = np.cumsum([0, *map(len, keys)]), np.concatenate(keys)
    keys.clear()
    entries, of = np.unique(every, return_inverse=True)
    del every
    c = np.bincount(of, np.concatenate(counts), len(entries)).astype(np.int64)
    counts.clear()
    word, (contexts, at) = (entries >> np.uint64(BITS)).astype(np.int64), np.unique(entries & _LOW, return_inverse=True)
    many, one, total = c > 1, c == 1, np.bincount(word, c, len(words)).astype(np.int64)
    of_words, of_contexts = np.bincount(word[one], minlength=len(words)), np.bincount(at[one], minlength=len(contexts))
    rows = [
        ("entries", bucket, 0, _zip(at), _zip(np.bincount(word, minlength=len(words))), _zip(c)),
        ("many", bucket, 0, _zip(at[many]), _zip(word[many]), _zip(c[many])),
        ("words", bucket, 0, _zip(of_words), _zip(total), None, float(total.sum()), float((total > 0).sum())),
        ("contexts", bucket, 0, _zip_sorted(contexts), _zip(of_contexts), None, float((c > 0).sum())),
        *_totals(bucket, contexts, n, np.bincount(at[c > 0], minlength=len(contexts)), np.bincount(at, c, len(contexts))),
    ]
    for grp, w, i, j in zip(table.column("other").to_pylist(), own, first[:-1], first[1:], strict=True):
        rows.append(("slice", bucket, grp, _zip_sorted(of[i:j]), _zip_sorted(w)))
    return _table(rows)


def add_up(table: pa.Table) -> pa.Table:
    """Totals of a range of previous words over all buckets, sent back to each in its own order."""
    lists = [_unzip_sorted(a) for a in table.column("a").to_pylist()]
    keys, of = np.unique(np.concatenate(lists), return_inverse=True)
    sums = []
    for name in ("b", "c"):
        data = table.column(name).to_pylist()
        sums.append(np.bincount(of, np.concatenate([_unzip(d) for d in data]), len(keys)).astype(np.int64)[of] if data[0] is not None else None)
    first = np.cumsum([0, *map(len, lists)])
    return _table([("sums", b, k, *[None if s is None else _zip(s[i:j], "<u8") for s in sums]) for b, k, i, j in zip(table.column("bucket").to_pylist(), table.column("other").to_pylist(), first[:-1], first[1:], strict=True)])


def _pick(table: pa.Table, kind: str) -> list[dict]:
    return sorted(table.filter(pc.equal(table.column("kind"), kind)).to_pylist(), key=lambda r: r["other"])


def sweep(table: pa.Table, n: int, turn: int, known: float, c_all: float, t_all: float) -> pa.Table:
    """One sweep over a bucket's seatings, given the totals of the last; the tables it ends with, and their sums."""
    (many,), (words,), (contexts,), sums = (_pick(table, k) for k in ("many", "words", "contexts", "sums"))
    bucket, rng = many["bucket"], np.random.default_rng((many["bucket"], turn))
    at, word, c = (_unzip(many[k]).astype(np.int64) for k in "abc")
    singles, total = (_unzip(words[k]).astype(np.int64) for k in "ab")
    names, own = _unzip_sorted(contexts["a"]), _unzip(contexts["b"])
    tables_of = np.concatenate([_unzip(s["a"], "<u8") for s in sums]).astype(float)
    before = _pick(table, "tables")
    t = _unzip(before[0]["a"]).astype(np.int64) if before else np.ones(len(c), np.int64)
    customers = singles + np.bincount(word, t, len(singles)).astype(np.int64)
    root = _unzip(before[0]["b"]).astype(np.int64) if before else (total > 0).astype(np.int64)
    root = np.clip(root, customers > 0, customers)
    root = draw(customers, (STRENGTH[0] + DISCOUNT * np.maximum(t_all - root, 0)) / (known + 1), DISCOUNT / (known + 1), rng)
    above = parent(customers, root, c_all, t_all, known)
    t = draw(c, (STRENGTH[1] + DISCOUNT * (tables_of[at] - t)) * above[word], DISCOUNT * above[word], rng)
    customers = singles + np.bincount(word, t, len(singles)).astype(np.int64)
    root = np.clip(root, customers > 0, customers)
    rows = [("tables", bucket, turn, _zip(t), _zip(root), None, float(customers.sum()), float(root.sum()))]
    return _table(rows + _totals(bucket, names, n, own + np.bincount(at, t, len(names)).astype(np.int64)))


def answer(table: pa.Table, known: float, totals: dict[int, tuple[float, float]]) -> pa.Table:
    """Predictive probabilities averaged over the sampled seatings, for the entries of each slice, and its words' counts."""
    (entries,), (words,), first = (_pick(table, k) for k in ("entries", "words", "sums"))
    at, runs, c = (_unzip(entries[k]).astype(np.int64) for k in "abc")
    singles, total = (_unzip(words[k]).astype(np.int64) for k in "ab")
    word, c_all = np.repeat(np.arange(len(runs)), runs), np.concatenate([_unzip(s["b"], "<u8") for s in first]).astype(float)
    many, p = c > 1, np.zeros(len(c))
    tables = _pick(table, "tables")
    for s in tables:
        t = np.minimum(c, 1)
        t[many] = _unzip(s["a"])
        t_all = np.concatenate([_unzip(x["a"], "<u8") for x in _pick(table, f"sums {s['other']}")]).astype(float)
        customers = singles + np.bincount(word[many], t[many], len(singles))
        p += child(c, t, c_all[at], t_all[at], parent(customers, _unzip(s["b"]), *totals[s["other"]], known)[word])
    p /= len(tables)
    return _table([("reply", r["bucket"], r["other"], p[_unzip_sorted(r["a"]).astype(np.int64)].astype("<f4").tobytes(), _zip(total[_unzip_sorted(r["b"]).astype(np.int64)])) for r in _pick(table, "slice")])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, slice_bytes: int = 5_000_000, bucket_bytes: int = 12_000_000, sweeps: int = 3, keep: int = 2) -> DataFrame:
    """Trains on the documents whose crc32(key as text) mod folds is not 0 and scores all of them.

    Columns: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Words are runs
    without ASCII white space, A-Z lower-cased, and an end for each text, which also stands before its first
    word. Words are told apart by 64 bits of a hash, previous words by 40. The score averages the probabilities
    of the last `keep` of `sweeps` sweeps. A null or empty text is one end. A null key counts as held out. Repeated rows
    train and are scored each; an empty table gives no rows; other columns are ignored. Without training
    documents every word is unknown.

    docs is read twice and must give the same rows in the same tasks, as files and written tables do; an
    error says so where it doesn't.
    """
    spark = docs.sparkSession
    home = textops.shared_dir(spark)
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_kind = slim.schema["id"].dataType.simpleString()
    n = max(1, -(-(slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // bucket_bytes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.release()
        for s in _slices(batches, folds, slice_bytes):
            cut, ends = _share(s.words, 64, n), np.concatenate([[0], np.cumsum(s.runs)])
            rows = []
            for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if j > i:
                    x, y = ends[i], ends[j]
                    rows.append(("ask", b, s.number, _zip_sorted(s.words[i:j]), _zip(np.concatenate([s.runs[i:j], s.counts[x:y]])), _zip(s.before[x:y], "<u8")))
            yield from _table(rows).to_batches()

    def structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.release()
        for s in _slices(batches, folds, slice_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([s.number]), pa.ListArray.from_arrays([0, len(s.ids)], s.ids), pa.array([s.held.tolist()]), *[pa.array([_zip(x)]) for x in (s.sizes, s.at, s.runs)]], ["other", "ids", "held", "sizes", "at", "runs"])

    per = lambda df, by, f, *more: df.groupBy(by).applyInArrow(lambda t: f(t, *more), ROW)
    model = textops.stored(per(slim.mapInArrow(ask, ROW), "bucket", gather, n), f"{home}/model")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    n_train, known = of(model, "words").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    c_all, t_all = of(model, "contexts").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0], known
    first = sums = textops.stored(per(of(model, "totals"), "other", add_up), f"{home}/sums0")
    final, totals = of(model, "entries", "words", "slice").unionByName(first), {}
    now = None
    for k in range(1, sweeps + 1):
        state = of(model, "many", "words", "contexts").unionByName(sums)
        state = state if now is None else state.unionByName(of(now, "tables"))
        now = textops.stored(per(state, "bucket", sweep, n, k, known, c_all, t_all), f"{home}/tables{k}")
        sums = textops.stored(per(of(now, "totals"), "other", add_up), f"{home}/sums{k}")
        c_all, t_all = of(now, "tables").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        if k > sweeps - keep:
            totals[k] = c_all, t_all
            final = final.unionByName(of(now, "tables")).unionByName(sums.withColumn("kind", F.lit(f"sums {k}")))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        (s,), replies = left.drop_columns(["ids"]).to_pylist(), sorted(right.select(["bucket", "a", "b"]).to_pylist(), key=lambda r: r["bucket"])
        sizes, at, runs = (_unzip(s[k]).astype(np.int64) for k in ("sizes", "at", "runs"))
        p = np.concatenate([np.frombuffer(r["a"], "<f4") for r in replies]).astype(float) if replies else np.zeros(0)
        count = np.concatenate([_unzip(r["b"]) for r in replies]).astype(float) if replies else np.zeros(0)
        if len(p) != runs.sum() or len(count) != len(runs):
            raise RuntimeError("documents came in another order when read again; write them to a table first")
        count = np.repeat(count, runs)[at]
        begin = np.cumsum(sizes) - sizes
        total = lambda x: pa.array(np.add.reduceat(x, begin))
        base = np.log10((count + 0.1) / (n_train + 0.1 * (known + 1)))
        return pa.table({"id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(s["held"], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": total((count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(sizes), int(n_train))), "base_score": total(base), "score": total(np.log10(p)[at])})

    replies = per(final, "bucket", answer, known, totals)
    made = slim.mapInArrow(structure, f"other long, ids array<{id_kind}>, held array<boolean>, sizes binary, at binary, runs binary")
    out = made.groupBy("other").cogroup(replies.groupBy("other")).applyInArrow(judge, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)
