"""The ten operators and the pipeline on small tables: brute force, round trips, and odd rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import chat, components, decontaminate, ngram_join, packing, pii, pitman_yor, token_counts, toxicity, vamana, wavelet

P = pytest.importorskip("public_tokenizers")
ODD = [(1, "The cat sat on the mat and ran away again"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 20000), (6, "word " * 3000), (7, "The cat sat on the mat and ran away again"), (7, "The cat sat on the mat and ran away again"), (None, "nobody"), (8, "é <|endoftext|> <|im_end|>\n ▁ a  b \\")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def _varied(n=60, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = out[rng.randrange(len(out))].split() if out and rng.random() < 0.6 else [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 30, 80]))]
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            base[rng.randrange(len(base))] = f"v{rng.randrange(9999)}"
        out.append(" ".join(base))
    return out


def _groups(texts, width, percent):
    sets = {i: ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w := (t or "").lower().split()) >= width else ({tuple(w)} if w else set())) for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_is_brute_force(spark, width, percent):
    texts = list(enumerate(_varied()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(texts, "doc_id long, text string"), width=width, percent=percent).collect()}
    assert got == _groups(texts, width, percent)


def test_ngram_join_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(odd).collect()]
    assert len(got) == len(ODD) and (2, 0, 2) in got and (3, 0, 3) in got and got.count((7, 7, 1)) == 2 and any(i is None and c is None for i, _, c in got)
    assert ngram_join.join(none).count() == 0


def test_trie_walk():
    rng = np.random.RandomState(1)
    for most, percent in ((40, 50), (12, 80), (200, 85)):
        base = [np.unique(rng.randint(0, most, rng.randint(0, 30))).astype(np.uint64) for _ in range(60)]
        sets = base + [np.setdiff1d(base[rng.randint(60)], rng.randint(0, most, 2).astype(np.uint64)) for _ in range(60)] + base[:5]
        trie = ngram_join.Trie(list(range(len(sets))), sets)
        for probe in [*sets[:30], np.zeros(0, np.uint64)]:
            want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))]
            assert sorted(trie.links(probe, percent)) == want


def test_trie_leaves_subtrees():
    sets = [np.array([1, 2, *range(10 + 3 * k, 28 + 3 * k)], np.uint64) for k in range(50)]
    trie = ngram_join.Trie(list(range(50)), sets)
    assert list(trie.links(np.arange(500, 520, dtype=np.uint64), 85)) == [] and trie.visited <= 1
    assert list(trie.links(sets[7], 85)) == [7] and trie.visited < 52


def test_queries_are_their_sql(spark):
    import duckdb

    from loomgraph.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, text in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        q = con.execute(text)
        names = [c[0] for c in q.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(q.fetchall())


def test_components(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components.components(links, f"file://{tmp_path}/c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_token_counts(odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, P.path("piece_bpe_32k.model")).collect())
    assert got == sorted((str(i), len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in ODD)
    assert token_counts.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


def test_decontamination(spark, odd, none):
    item = " ".join(f"b{i}" for i in range(30))
    halves = " ".join([*[f"b{i}" for i in range(15, 30)], "gap", *[f"b{i}" for i in range(15)]])
    docs = spark.createDataFrame([(1, f"x y {item.upper()} z"), (2, halves), (3, " ".join(f"b{i}" for i in range(12))), (4, None), (5, "b1 b2 b3")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "b1 b2 b3")], "item_id long, text string")
    for most in (10**6, 0):
        got = {r.doc_id: [(m.item_id, m.n_matched, m.n_tiles) for m in r.matches] for r in decontaminate.tile(docs, items, most_bytes=most).collect()}
        assert got == {1: [(7, 30, 1)], 2: [(7, 30, 2)], 3: [], 4: [], 5: []}
    assert decontaminate.tile(odd, items).count() == len(ODD) and decontaminate.tile(none, items).count() == 0


def test_decontamination_by_characters_and_rows(spark):
    item = " ".join(f"b{i}" for i in range(30))
    marked = "\u201c" + "\u00a0".join(f"b{i}" for i in range(10)) + "\u201d\u2014" + "\uff0c".join(f"b{i}" for i in range(10, 20)) + "\u2013" + "\u2026".join(f"b{i}" for i in range(20, 30))
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"
    docs = spark.createDataFrame([(1, marked), (2, "\u524d\u6587" + han[:20] + "\u3002" + han[20:] + "\u540e"), (None, item), (5, item), (5, "other text"), (5, None), (6, " ".join([hindi] * 3))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, han), (9, hindi + " " + hindi)], "item_id long, text string")
    twice = [(7, 30, 30), (7, 30, 30)]
    for most in (10**6, 0):
        got = sorted((str(r.doc_id), r.text or "", [(m.item_id, m.n_words, m.n_matched) for m in r.matches]) for r in decontaminate.tile(docs, items, most_bytes=most).collect())
        assert [(i, m) for i, _, m in got] == [("1", twice), ("2", [(8, 40, 40)]), ("5", []), ("5", twice), ("5", []), ("6", []), ("None", twice)]


def _naive_tiles(text, item, least):
    used_text, used_item, tiles = set(), set(), []
    while True:
        best = (0, 0, least - 1)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and a + n not in used_text and b + n not in used_item:
                    n += 1
                if n > best[2]:
                    best = (a, b, n)
        a, b, n = best
        if n < least:
            return tiles
        used_text |= set(range(a, a + n))
        used_item |= set(range(b, b + n))
        tiles.append(best)


def test_tiles_are_those_of_plain_tiling():
    rng = random.Random(2)
    hashed = lambda x: decontaminate.textops.mix(np.array(x, np.uint64))
    for _ in range(150):
        words, least = rng.choice([1, 2, 3, 5]), rng.choice([2, 3, 5])
        a, b = ([rng.randrange(words) for _ in range(rng.randrange(n))] for n in (60, 30))
        assert decontaminate.greedy_tiles(hashed(a), hashed(b), least) == _naive_tiles(a, b, least)


def test_tiles_of_repeated_words_take_no_time():
    began = time.time()
    for item, text in (("same " * 1000, "same " * 20000), ("buy now " * 500, "buy now " * 10000)):
        known = decontaminate.Benchmark([1], [item], 5)
        words = decontaminate._words(pa.array([text]))
        grams = decontaminate.textops.chained(words.hash, 5)
        at = known.hits(grams)
        assert [m["n_matched"] for m in known.matches(words.hash, at, grams[at], 0.6)] == [1000]
    assert time.time() - began < 10


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "b1 b2 b3 b4 b5 b6", 7, "r", "mine"), (2, "", 8, None, None)], "doc_id long, text string, __row int, id string, Matches string")
    items = spark.createDataFrame([(7, "b1 b2 b3 b4 b5 b6")], "item_id long, text string")
    for most in (10**6, 0):
        got = decontaminate.tile(docs, items, most_bytes=most, into="found").orderBy("doc_id").collect()
        assert [tuple(r)[:5] for r in got] == [(1, "b1 b2 b3 b4 b5 b6", 7, "r", "mine"), (2, "", 8, None, None)]
        assert [len(r.found) for r in got] == [1, 0]


def test_pitman_yor(spark, odd, none):
    texts = [(i, " ".join(["red", "green", "blue", "sky"][(i + k) % 4] for k in range(20))) for i in range(200)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pitman_yor.score(table, slice_bytes=2000, bucket_bytes=3000).collect()
    train = [w for i, t in texts if zlib.crc32(str(i).encode()) % 10 for w in [*t.split(), None]]
    n, v = len(train), len(set(train))
    by = {w: train.count(w) for w in set(train)}
    for r in rows:
        words = [*dict(texts)[r.doc_id].split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (21, 21, n)
        assert r.base_score == pytest.approx(sum(math.log10((by[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r.score > r.base_score / 2  # each word follows one other
    one = {r.doc_id: r.score for r in pitman_yor.score(table).collect()}
    assert sum(abs(r.score - one[r.doc_id]) for r in rows) < 0.02 * -sum(one.values())
    got = pitman_yor.score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got) and pitman_yor.score(none).count() == 0
    assert all(r.held_out for r in got if r.doc_id is None)
    assert {r.train_tokens for r in pitman_yor.score(odd.where("doc_id is null")).collect()} == {0}


def _seated(texts, sweeps, keep, seed=1):
    """A plain sampler that holds every table: the averaged probability of each (previous word, word)."""
    rng, (above, below), d = random.Random(seed), pitman_yor.STRENGTH, pitman_yor.DISCOUNT
    pairs = [p for t in texts for w in [[None, *t.split(), None]] for p in zip(w, w[1:], strict=False)]
    words = sorted({w for _, w in pairs}, key=str)
    child, root = {}, {}
    sizes = lambda r, w: r.setdefault(w, [])
    total = lambda r: (sum(map(sum, r.values())), sum(map(len, r.values())))

    def p_root(w):
        c, t = total(root)
        return (sum(sizes(root, w)) - d * len(sizes(root, w)) + (above + d * t) / (len(words) + 1)) / (above + c)

    def p_child(u, w):
        r = child.setdefault(u, {})
        c, t = total(r)
        return (sum(sizes(r, w)) - d * len(sizes(r, w)) + (below + d * t) * p_root(w)) / (below + c)

    def seat(r, w, fresh):
        weights = [n - d for n in sizes(r, w)] + [fresh]
        k = rng.choices(range(len(weights)), weights)[0]
        r[w] += [0] if k == len(r[w]) else []
        r[w][k] += 1
        return r[w][k] == 1

    def leave(r, w):
        k = rng.choices(range(len(r[w])), r[w])[0]
        r[w][k] -= 1
        if not r[w][k]:
            del r[w][k]
            return True
        return False

    def add(u, w):
        r = child.setdefault(u, {})
        if seat(r, w, (below + d * total(r)[1]) * p_root(w)):
            seat(root, w, (above + d * total(root)[1]) / (len(words) + 1))

    for u, w in pairs:
        sizes(child.setdefault(u, {}), w), sizes(root, w)
        add(u, w)
    out = {}
    for k in range(sweeps):
        for u, w in pairs:
            if leave(child[u], w):
                leave(root, w)
            add(u, w)
        if k >= sweeps - keep:
            for p in set(pairs):
                out[p] = out.get(p, 0) + p_child(*p) / keep
    return out


def test_pitman_yor_is_the_plain_sampler(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["a", "a b", "c", "a b", "d e"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(texts, "doc_id long, text string"), sweeps=8, keep=6).collect()}
    p = _seated([t for i, t in texts if not rows[i].held_out], 150, 120)
    wanted = {i: sum(math.log10(p[pair]) for w in [[None, *t.split(), None]] for pair in zip(w, w[1:], strict=False)) for i, t in texts if not rows[i].held_out}
    assert all(rows[i].score == pytest.approx(s, rel=0.05) for i, s in wanted.items())
    assert sum(rows[i].score for i in wanted) == pytest.approx(sum(wanted.values()), rel=0.01)


def test_probabilities_add_up_to_one():
    rng = np.random.RandomState(3)
    c, known = rng.randint(0, 30, 50), 50
    t = np.minimum(c, rng.randint(1, 9, 50))
    above = pitman_yor.parent(c, t, c.sum(), t.sum(), known)
    unknown = pitman_yor.parent(np.zeros(1), np.zeros(1), c.sum(), t.sum(), known)
    assert above.sum() + unknown[0] == pytest.approx(1)
    both = np.append(above, unknown)
    held = rng.randint(0, 5, 51)
    assert pitman_yor.child(held, np.minimum(held, 1), held.sum(), (held > 0).sum(), both).sum() == pytest.approx(1)


def test_moves_keep_the_share_of_tables():
    """Of three customers of one dish, where a new table is as likely as by the weights below, by counting seatings."""
    rng, n, fresh = np.random.default_rng(5), 40000, 0.7
    t = pitman_yor.move(np.ones(n, np.int64), np.full(n, 3), np.full(n, fresh), rng, 1)
    for _ in range(60):
        t = pitman_yor.move(t, np.full(n, 3), np.full(n, fresh), rng, 2)
    d = pitman_yor.DISCOUNT
    ways = np.array([(1 - d) * (2 - d), 3 * (1 - d) * fresh, fresh * fresh])  # seatings at one, two and three tables
    assert np.abs(np.bincount(t, minlength=4)[1:] / n - ways / ways.sum()).max() < 0.01


def test_tables_are_drawn_as_after_all_moves():
    """Against the chances of each number of tables, by the numbers of seatings, and against many moves."""
    rng, n, d = np.random.default_rng(6), 40000, pitman_yor.DISCOUNT
    for c, fresh, own in ((3, 0.7, 0.0), (40, 2.5, 0.0), (40, 0.3, 0.4), (7, 30.0, 0.2), (2, 1e-6, 0.0)):
        ways = {1: 1.0}
        for k in range(1, c):  # the next customer sits at one of t tables or takes a new one
            ways = {t: ways.get(t, 0) * (k - d * t) + ways.get(t - 1, 0) * (fresh + own * (t - 1)) for t in range(1, k + 2)}
        want = np.array([0, *ways.values()]) / sum(ways.values())
        got = np.bincount(pitman_yor.draw(np.full(n, c), np.full(n, fresh), np.full(n, own), rng), minlength=c + 1) / n
        assert np.abs(got - want).max() < 0.012
    t = pitman_yor.move(np.ones(n, np.int64), np.full(n, 40), np.full(n, 2.5), rng, 39)
    for _ in range(20):
        t = pitman_yor.move(t, np.full(n, 40), np.full(n, 2.5), rng, 39)
    assert abs(t.mean() - pitman_yor.draw(np.full(n, 40), np.full(n, 2.5), np.zeros(n), rng).mean()) < 0.08
    large = pitman_yor.draw(np.array([0, 1, 10**8]), np.array([1.0, 1.0, 5e4]), np.zeros(3), rng)
    assert large[:2].tolist() == [0, 1] and 9.5e4 < large[2] < 1.05e5


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "a\\s<\\|"), (1, 2, "assistant", None), (1, 3, None, "x"), (2, None, "ro\nle<|", ""), (None, 0, "assistant", "é\n"), (1, 4, "assistant", "<|im_sep|>\\")]
    chats = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], list(r.loss_texts)) for r in chat.read_chats(chats).collect()}
    assert got[1] == ([("user", turns[0][3]), ("assistant", "a\\s<\\|"), ("assistant", ""), ("", "x"), ("assistant", "<|im_sep|>\\")], ["a\\s<\\|", "", "<|im_sep|>\\"])
    assert got[2] == ([("ro\nle<|", "")], []) and got[None] == ([("assistant", "é\n")], ["é\n"])
    assert chats.where("conv_id = 1").first().formatted.count("<|im_start|>") == 4
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(odd, P.path("byte_bpe_50k.json"), capacity=64).collect()
    made = {}
    for r in rows:
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in made.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in {(i, t) for i, t in ODD}:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted({(r.start, bytes(r.ids)) for r in rows if r.doc_id == i}) if i != 7 else None
        if parts is not None:
            assert b"".join(p for _, p in parts) == ids.tobytes()
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_closest_fill_is_best():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(max(counts), 120)
        got = packing.closest_fill(counts, room)
        first, sums = max(counts), {0}
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                sums |= {s + n for s in sums}
        assert all(got[n] <= counts[n] for n in got) and sum(n * c for n, c in got.items()) == first + max(s for s in sums if first + s <= room)


def _toxic_table(spark, n=900, extra=()):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice(['', 'n', 'd', 'ing', 'er'])}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in rng.sample(range(60), 4):
                words[k] = rng.choice(["horrid", "wretch"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*docs, *extra], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (5000, None), (None, 1), (0, 1)], "doc_id long, toxic int")


def test_toxicity(spark, none):
    docs, labels = _toxic_table(spark, extra=[(None, None), (999, ""), (0, "a repeated key"), (1000, "long " * 20000)])
    model = toxicity.fit(docs.where("coalesce(doc_id, 0) < 700"), labels)
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = range(700, 900)
    right = [got[i][0].predicted == (i % 4 == 0) for i in held]
    assert sum(right) >= 190 and len(got[0]) == 2 and got[999][0].score == got[None][0].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for rows in got.values() for r in rows)
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels).weights == ()
    few = toxicity.fit(docs.where("doc_id < 3"), labels)  # no part for calibration has both classes
    assert few.weights == () and toxicity.score(docs.where("doc_id = 5"), few).first().score == few.prior


def test_toxicity_keeps_clashing_columns(spark):
    docs, labels = _toxic_table(spark, 60)
    odd = docs.selectExpr("*", "'mine' AS Score", "7 AS predicted", "'x' AS label", "1 AS key")
    got = toxicity.score(odd, toxicity.fit(odd, labels), into=("s", "p"))
    assert got.columns == [*odd.columns, "s", "p"] and {tuple(r) for r in got.select("Score", "predicted", "label", "key").collect()} == {("mine", 7, "x", 1)}


def test_windows_hold_every_phrase_whole():
    for n in range(12):
        p = [f"w{i}" for i in range(n)]
        got = toxicity.windows(" ".join(p), 3, 2)
        assert all(any(f" {x} {y} " in f" {g} " for g in got) for x, y in zip(p, p[1:]))
        assert set(" ".join(got).split()) == set(p) and toxicity.windows(" ".join(p), 1) == p
        assert len(got) <= n // 2 + 1


def test_phrases_count_where_words_do_not():
    """Both dictionaries hold all three words, only the toxic one holds them beside each other."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    apart = " ".join(x for _ in range(20) for x in ("qzvxk", word(), "wyrmp", word(), "lomtu", word())).encode()
    beside = " ".join(x for _ in range(20) for x in ("qzvxk", "wyrmp", "lomtu", word(), word(), word())).encode()
    plain, toxic = toxicity.Compressor(apart), toxicity.Compressor(beside)
    words, phrase = toxicity.savings(plain, toxic, ["qzvxk", "wyrmp", "lomtu"]), toxicity.savings(plain, toxic, ["qzvxk wyrmp lomtu"])
    assert phrase[0] > words.max() and phrase[0] > 0


def test_window_savings_are_those_of_plain_compression():
    import zstandard

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["red", "green", "blue", "Sky", "x" * 60, "\u4e00" * 30]) for _ in range(n))
    a, b = toxicity.train([text(3) for _ in range(400)], 600), toxicity.train(["tiny"], 600)
    assert b == b" tiny "
    texts = ["", "one", text(50), text(7)]
    for t, shape in ((t, k) for t in texts for k in ((1, 1), (2, 1), (3, 2), (4, 3))):
        model = toxicity.ToxicityModel(a, b, (), 0, (shape,))
        w = toxicity.windows(t, *shape)
        joined = "".join(toxicity.pieces(t))
        assert joined == t.lower().replace(" ", "") and all(len(p) <= toxicity.LONGEST for p in toxicity.pieces(t))
        plain = []
        for x in w:
            size = []
            for d in (a, b):
                kind = zstandard.ZstdCompressionDict(d + toxicity.FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(d) + len(toxicity.FRAME), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
                size.append(len(zstandard.ZstdCompressor(dict_data=kind, compression_params=params).compress(b" " + x.encode() + b" " + toxicity.FRAME)))
            plain.append(size[0] - size[1])
        want = toxicity.features(np.array(plain, np.int64), np.array([len(w)]))
        assert (toxicity._Scorer(model, keep=3).features([t]) == want).all()


def test_nearest_neighbours(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(900, 16)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vamana.search(table, table.where("vec_id % 50 = 0"), shard_rows=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert all(s == pytest.approx(d[v]) for _, v, s in got[q])
    assert set(got) == set(range(0, 900, 50)) and hit >= 171
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 111))
    assert vamana.search(table.where("false"), table).count() == 0


def test_queries_repeated_for_each_shard_are_not_sent_to_the_driver(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(400)], "vec_id long, embedding array<double>")
    found = vamana.search(table, table.where("vec_id % 20 = 0"), shard_rows=16, query_rows=4)
    assert found.count() == 200
    plan = found._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString() and "SortMergeJoin" in plan.executedPlan().toString()


def test_personal_data(spark, odd, none):
    text = "é mail a@b.co_x@d.e, ip 10.0.0.1.2 and 300.1.1.1; 4111 1111 1111 1111 call +44 20 7946 0958, 1-2"
    digits = "1" * 30000 + " a@" + "b.c" * 20000
    docs = spark.createDataFrame([(1, text), (2, None), (3, digits)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in rows[1].pii] == [("email", "a@b.co"), ("email", "_x@d.e"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+44 20 7946 0958")]
    assert rows[2].pii == [] and [s.kind for s in rows[3].pii] == ["email"]
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.detect(docs)).collect()}
    assert clean[1].startswith("é mail [EMAIL][EMAIL], ip [IP].2 and 300.1.1.1; [CARD] call [PHONE],") and clean[2] is None
    assert pii.detect(odd).count() == len(ODD) and pii.detect(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} report by zorblatt{'' if i % 2 else ''} about topic{i} contact ann@corp.com today item{i}") for i in range(8)] + [(100 + i, f"filler{i} report today about item{i}") for i in range(60)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0")
    found = {(r.doc_id, s.value) for r in got.collect() for s in r.terms}
    assert {(i, "zorblatt") for i in range(8)} <= found and not any(v in ("report", "today", "about") for _, v in found)


def test_disclosing_terms_of_any_length(spark):
    names = {"Bob": "bob@corp.com", "\u674e": "li@corp.com"}
    rows = [(k * 100 + i, f"filler{i} report by {n} about it{i} contact {mail} today item{i}") for k, (n, mail) in enumerate(names.items()) for i in range(8)] + [(900 + i, f"filler{i} report about item{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda letters: {(r.doc_id, s.value) for r in pii.detect(docs, letters=letters).collect() for s in r.terms}
    short = {(k * 100 + i, n.lower()) for k, n in enumerate(names) for i in range(8)}
    assert short <= found(1) and not short & found(pii.LETTERS)


def test_disclosing_terms_of_whole_texts(spark):
    gap = lambda i: " ".join(f"gap{'abcdefghij'[i % 10]}{'klmnopqrst'[k % 10]}{i}" for k in range(20))
    rows = [(i, f"Zorblatt {gap(i)} zorblatt {gap(i + 20)} contact ann@corp.com today, then {gap(i + 40)} ZORBLATT") for i in range(8)]
    rows += [(50, f"nobody {gap(50)} knows zorblatt"), (None, "no key but zorblatt here"), (7, "same key, zorblatt again")] + [(100 + i, f"filler{i} report today about item{i}") for i in range(60)]
    got = [(r.doc_id, r.text, [(s.start, s.end) for s in r.terms if s.value == "zorblatt"], {s.value for s in r.terms}) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    for _, text, spans, _ in got:
        assert spans == [(m.start(), m.end()) for m in re.finditer("zorblatt", text.lower())]
    assert not any("report" in v or "corp" in v for *_, v in got)


def test_disclosing_terms_count_copies_alike(spark):
    rows = [(40 * k + i, f"{'abcd'[k] * 5} report {'efgh'[k] * 5} by zorblatt contact ann@corp.com {'ijkl'[k] * 5}") for k in range(4) for i in range(40)]
    rows += [(1000 + i, f"filler{i} report today about item{i}") for i in range(1000)]
    rows += [(3000 + i, f"same report by grumpkin contact bob@corp.com here number {i}") for i in range(3)] + [(4000 + i, "one passage of wumpus with eve@corp.com in it") for i in range(40)]
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zorblatt" in got[i] for i in range(160))
    assert not any(v & {"report", "grumpkin", "wumpus"} for v in got.values())  # fewer than four contexts


def _plain_spans(text):
    """The base spans by the contract's own patterns, with Python's regular expressions."""
    luhn = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (pattern, valid) in kinds.items() for m in re.finditer(pattern, text) if valid(m[0])]


def test_base_spans_are_those_of_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "x.y+z@q-r.s.t", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+1 (017) 555-7713", " ", "é", "word", "12", "-", "%", "\U0001f600", "+", "(", "\n"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(1500)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: _plain_spans(t) for i, t in texts}


def test_disclosing_terms_are_those_of_plain_counts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rare, texts = [word() + "rare" for _ in range(8)], []
    for i in range(300):
        who = rng.randrange(5)
        about = rng.random() < 0.5
        words = [word() for _ in range(30)] + [rare[who]] * (about and rng.random() < 0.8) + [rare[5 + who % 3]] * (rng.random() < 0.3)
        rng.shuffle(words)
        texts.append((i, " ".join(words) + (f" by p{who}@corp.com" if about else "")))
    got = {(r.doc_id, s.value) for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect() for s in r.terms}
    sets = [set(re.findall(r"[a-z]{4,}", re.sub(r"p\d@corp.com", "", t))) for _, t in texts]
    people = [re.findall(r"p\d@corp.com", t) for _, t in texts]
    told = set()
    for who in {p for ps in people for p in ps}:
        with_it = [s for s, ps in zip(sets, people, strict=True) if who in ps]
        for t in set().union(*with_it):
            both, n_t, n_e, n = sum(t in s for s in with_it), sum(t in s for s in sets), len(with_it), len(texts)
            if both >= 4 and math.log2(both * n / (n_t * n_e)) / math.log2(n / n_e) >= 0.8:
                told.add(t)
    assert told and got == {(i, t) for (i, _), s in zip(texts, sets, strict=True) for t in s & told}


def test_personal_data_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", 3, "mine", "too", "r")], "doc_id long, text string, pii int, Terms string, __row string, row string")
    got = pii.detect(docs, into=("p", "t"))
    assert got.columns == [*docs.columns, "p", "t"]
    assert [tuple(r) for r in pii.sanitise(got, columns=("p", "t")).collect()] == [(1, "mail [EMAIL]", 3, "mine", "too", "r")]


def test_wavelet_matrix():
    rng = np.random.RandomState(6)
    ids = rng.randint(0, 300, 3000).astype("<u4")
    m = wavelet.WaveletMatrix.of(ids)
    assert (m.decode() == ids).all() and m.access(1234) == ids[1234]
    for v in (0, 17, int(ids[5]), 299, 5000):
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.rank(v, 777) == (ids[:777] == v).sum()
        assert [m.select(v, k) for k in range(min(3, len(at)))] == at[:3].tolist() and m.select(v, len(at)) == -1
    assert wavelet.WaveletMatrix.of(ids[:0]).n == 0


def test_wavelet_files(odd, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(wavelet.read_ids(wavelet.write_ids(odd, P.path("word_bpe_49k.json"), f"file://{tmp_path}/ids")).collect(), key=lambda r: r.start)
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), ids.tobytes())
        at += len(ids)
    assert wavelet.read_ids(wavelet.write_ids(none, P.path("word_bpe_49k.json"), f"file://{tmp_path}/none")).count() == 0


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, sf)
        if k < 4:
            assert now.columns == columns
            now.write.parquet(f"file://{tmp_path}/{name}")
            now = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name == "ngram_join":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in now.collect()} == {i for i, (_, c) in _groups([(i, t) for i, t in texts], 5, 80).items() if i == c}
    kept = spark.read.parquet(f"file://{tmp_path}/pii")
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    passage = items.where("text IS NOT NULL").first().text
    texts = [(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "one two three four five six seven eight"), (5, "mail a@b.co now"), (6, f"before {passage} after"), (7, "same key"), (7, "same key"), (None, "nobody's own words here"), (8, "long " * 5000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, pii int, terms string, Score string, predicted int, matches string, __row string, component_id long"
    rows = [(i, t, "en", "s", len(t or ""), 7, "mine", "own", 3, "m", "r", 9) for i, t in texts]
    docs = spark.createDataFrame(rows, kind)
    extras = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = {"toxicity": 10, "ngram_join": 9, "decontamination": 9, "pii": 10}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        out = got.collect()
        assert len(out) == left[name] and {tuple(r[c] for c in extras) for r in out} == {("en", "s", 7, "mine", "own", 3, "m", "r", 9)}
        assert sum(r.doc_id is None for r in out) == 1 and sum(r.doc_id == 7 for r in out) == 2
        if name == "ngram_join":
            assert {r.doc_id for r in out} == {1, 2, 3, 5, 6, 7, 8, None}
        if name == "decontamination":
            assert 6 not in {r.doc_id for r in out}
        if name == "pii":
            assert [r.text for r in out if r.doc_id == 5] == ["mail [EMAIL] now"] and [r.n_chars for r in out if r.doc_id == 5] == [16]
        assert stage(spark, docs.where("false"), sf).collect() == []
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == 9 and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0
    assert labels.count() > 0


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    from loomgraph.llm.textops import Encoder

    rng = random.Random(8)
    texts = ["".join(rng.choices([" ", " ", "a", "The", "\n", "\t", "é", "9", "<|endoftext|>", "　", "'s", "!", "́", "\x1c"], k=rng.randrange(12))) for _ in range(4000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc, tok = Encoder(P.path(name), spaced, keep=500), Tokenizer.from_file(P.path(name))
        want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert enc.encode(texts[:2000]) + enc.encode(texts[2000:]) == want
