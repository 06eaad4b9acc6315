"""Host reputation, repair of conversations and the prefix trie against plain versions of them."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import prefix_trie, queries, repair, reputation

SF = "/root/testdata/sf0.01"
EMPTY = hashlib.sha256(b"").hexdigest()
TURNS = "conv_id bigint, turn bigint, role string, text string, base string, conv string"


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


@pytest.mark.parametrize("name", ["op11_url_reputation", "op12_structure_repair", "op13_prefix_trie"])
def test_registered_queries(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in q.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(repr(tuple(r)) for r in q.fetchall())


# ---- host reputation


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block")]
PAGE = "page_id bigint, url string, host string, n bigint, low string"


def judged(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(*u, "old", 5, "z") for u in urls], PAGE)
    known = spark.createDataFrame(list(outcomes), "id bigint, bad int")
    out = reputation.judge(pages, known, RULES, **kw)
    assert out.columns.count("host") == out.columns.count("low") == out.columns.count("n") == 1
    return sorted((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())


def test_addresses(spark):
    urls = [(1, "http://A.Example.ORG/es/x?q#f"), (2, "ftp://x.org"), (3, None), (4, "no address"), (5, "s://Ä.org:80/ES/"), (6, "x://y://z/a"), (7, "http://org/?/b"), (8, "http://notorg/"), (8, "http://notorg/"), (None, "http://?x"), (9, "")]
    assert judged(spark, urls) == [
        (False, 1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (False, 2, "x.org", "", None, "allow"),
        (False, 3, "", "", None, "allow"),
        (False, 4, "", "", None, "allow"),
        (False, 5, "Ä.org:80", "/ES/", None, "allow"),
        (False, 6, "y:", "//z/a", None, "allow"),
        (False, 7, "org", "/", "org/", "allow"),
        (False, 8, "notorg", "/", None, "allow"),
        (False, 8, "notorg", "/", None, "allow"),
        (False, 9, "", "", None, "allow"),
        (True, 0, "", "", None, "allow"),
    ]
    assert judged(spark, []) == []


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.y.z.com", "com", "", "10.0.0.1:80", "u@www.q.net:8080", "q.net."]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(*reputation.domain(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("z.com", "com"), ("com", "com"), ("", ""), ("10.0.0.1", "10.0.0.1"), ("q.net", "net"), ("q.net", "net")]


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    """A host with many bad pages goes; one bad page alone says little; a new host of a bad domain takes after it."""
    urls, outcomes = [], []

    def add(host, bad, good, plain=1):
        for k in range(bad + good + plain):
            urls.append((len(urls), f"http://{host}/{k}"))
            if k < bad + good:
                outcomes.append((len(urls) - 1, int(k < bad)))

    for k in range(30):
        add(f"h{k}.fine{k % 6}.com", 1, 19)
    add("bad.mixed.com", 60, 2)
    add("one.other.com", 1, 0)
    for k in range(6):
        add(f"w{k}.spam.net", 40, 1)
    add("new.spam.net", 0, 0, 3)
    outcomes += [(0, None), (None, 1), (10**6, 1), (1, 0)]
    got = {(r[2], r[5]) for r in judged(spark, urls, outcomes)}
    blocked = {h for h, v in got if v == "block"}
    assert blocked == {"bad.mixed.com", "new.spam.net", *(f"w{k}.spam.net" for k in range(6))}
    facts = {r["host"]: r for r in reputation.fit(spark.createDataFrame([(i, u.split("/")[2]) for i, u in urls], "id bigint, host string"), spark.createDataFrame(outcomes, "id bigint, bad int")).collect()}
    assert (facts["bad.mixed.com"]["n"], facts["bad.mixed.com"]["bad"]) == (62, 60)
    assert facts["h0.fine0.com"]["low"] < facts["h0.fine0.com"]["mean"] < facts["one.other.com"]["mean"] < facts["bad.mixed.com"]["mean"] < 60 / 62


def test_hot_keys_are_joined_apart(spark):
    from loomgraph.llm import skew

    rows = spark.createDataFrame([(k if k > 400 else 0, k) for k in range(1200)], "key bigint, x bigint")
    facts = spark.createDataFrame([(k, -k) for k in range(2000)], "key bigint, y bigint")
    got = skew.joined(rows, facts, "key", most=5)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(k, -(k if k > 400 else 0)) for k in range(1200)]


# ---- repair of conversations


def plain_repair(rows):
    """The cheapest (cost, audit, lines) of all edit sequences with at most two inserts between rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    flaws, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        flaws.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None

    def go(i, cost, audit, lines, held):
        nonlocal best
        if held < 2 and (best is None or cost + 5 <= best[0]):
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*lines, f"{role}:"], held + 1)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
            return
        _, role, text = rows[i]
        go(i + 1, cost + 2, audit + "D", lines, 0)
        if flaws[i] in ("", "truncated"):
            more = 5 * (flaws[i] == "truncated")
            if role[:1] in ("s", "u", "a"):
                go(i + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
            for to in ("user", "assistant"):
                go(i + 1, cost + 1 + more, audit + "R", [*lines, f"{to}:{text}"], 0)

    go(0, 0, "", [], 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(flaws.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def some_turns(seed, convs, most):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(pick.randrange(1, most)):
            rows.append((c, pick.choice([None, 0, 1, 2, 3, 7]), pick.choice(["user", "assistant", "system", "ubot", "tool", ""]), pick.choice(["a.", "b!", "c", " \t", "", "ä?  ", "é . x"])))
    return rows


def repaired(spark, rows, **kw):
    return {r[0]: tuple(r[1:]) for r in repair.repair(turn_table(spark, rows), **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"most_rows": 3, "run": 3}, {"most_chars": 0, "run": 1}])
def test_cheapest_repair(spark, kw):
    rows = some_turns(3, 60, 6) + [(2**60 + 1, 5, "user", "x."), (None, 0, "user", "hi."), (None, 1, "assistant", "ho.")]
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = plain_repair([r[1:] for r in rows if r[0] == c])
    assert repaired(spark, rows, **kw) == want


def test_long_conversation_in_runs(spark):
    rows = [(1, k // 3, pick, f"{k % 97} {pick}{'.' if k % 5 else ''}") for k, pick in enumerate(random.Random(1).choices(["user", "assistant", "tool"], k=3000))]
    assert repaired(spark, rows) == repaired(spark, rows, most_rows=100, run=64)


def test_odd_conversations(spark):
    assert repaired(spark, []) == {}
    rows = turn_table(spark, [(1, 0, None, None), (1, 0, None, None), (2, 1, "user", "x" * 300_000), (3, 0, "user", "hi.")])
    gone = rows.withColumn("there", rows["conv_id"] != 3)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(gone, present="there").collect()}
    assert got == {1: (0, 2, 0, 0, 1, 4, "DD", EMPTY), 2: (0, 0, 0, 1, 0, 2, "D", EMPTY), 3: (0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(40) for t in (0, None)] + [(7, 9, None, None)]
    got = sorted(map(tuple, repair.damaged(turn_table(spark, rows)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "a b c" if kind == 2 and text != " " else text, kind != 0)
        want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)


# ---- prefix trie


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], set()).add(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ends = ",".join(map(str, sorted(c for c in held if paths[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(m) == len(node) + 1 for m in below), len(leaves), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 1024])
def test_trie(spark, block):
    pick = random.Random(block)
    rows = [(c, pick.choice([None, *range(12)]), pick.choice(["user", "assistant", None]), pick.choice(["a", "bb", "", None, "çç"])) for c in [0, 100, 200, *range(101, 140), *range(1, 30), 205, 311, None] for _ in range(pick.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in (12301, 12302, 12303) for t in range(9)] * 2
    got = prefix_trie.nodes(*prefix_trie.rebuilt(turn_table(spark, rows)), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.nodes(*prefix_trie.rebuilt(turn_table(spark, []))).count() == 0
    rows = [(None, 1, "user", "x"), (101, 0, "user", "y" * 200_000)]
    assert sorted(map(tuple, prefix_trie.nodes(*prefix_trie.rebuilt(turn_table(spark, rows))).collect()), key=repr) == plain_trie(rows)
