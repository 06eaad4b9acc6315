"""Personal data: exact patterns, and terms that give a protected value away by corpus co-occurrence.

Spark expressions only; every pattern is anchored to the start of a run or the end of the last match, with
possessive repeats, so that long runs cost time in proportion and no deep recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTETS = r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"
LETTERS = 4
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _word(letters: int) -> str:
    """Words of that many letters or more, without digits beside them."""
    return rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{letters},}}+(?![\p{{L}}\p{{N}}])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))
    at = lambda i: F.substr(d, i + 1, F.lit(1)).cast("int")
    twice = lambda i: F.when(at(i) * 2 > 9, at(i) * 2 - 9).otherwise(at(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(i)).otherwise(at(i))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(_OCTETS))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind: matches and the gaps between them give the places, in code points."""
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    hint = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(_HINT[kind]))
    return F.when(hint, F.aggregate(pairs, begin, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN))


def base_spans(text: str = "text") -> Column:
    """Spans (kind, start, end, value) of the base kinds in order of KINDS, then start; none for a null text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.concat(*[_kind_spans(body, k) for k in KINDS])


def _rest(text: str, spans: str = "pii") -> Column:
    """The text with its base spans blanked, so that every other character keeps its place."""
    body = F.coalesce(F.col(text), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["at"])
        fresh = F.array(F.substr(body, a["at"] + 1, start - a["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], fresh).alias("out"))

    done = F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), begin, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), F.substr(body, done["at"] + 1, F.length(body)))).otherwise(body)


def _terms(rest: Column, letters: int) -> Column:
    """The distinct words of so many letters or more, lower-cased; one empty string where there are none."""
    return F.array_distinct(F.split(F.lower(F.array_join(F.regexp_extract_all(rest, F.lit(_word(letters)), F.lit(0)), " ")), " "))


def _spots(rest: Column, wanted: Column, letters: int) -> Column:
    """Spans of all words whose lower case is wanted, by start, in one pass over words and gaps."""
    words, gaps = F.regexp_extract_all(rest, F.lit(_word(letters)), F.lit(0)), F.split(rest, _word(letters), -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start, term = a["at"] + F.length(x["gap"]), F.lower(x["word"])
        end = start + F.length(x["word"])
        span = F.array(F.struct(F.lit("term").alias("kind"), start.alias("start"), end.alias("end"), term.alias("value")))
        return F.struct(end.alias("at"), F.when(F.array_contains(wanted, term), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    pairs = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.struct(w.alias("word"), g.alias("gap")))
    return F.aggregate(pairs, begin, step, lambda a: a["spans"])


def disclosing_terms(rows: DataFrame, home: str, threshold: float = 0.8, support: int = 4, reach: int = 80, letters: int = LETTERS) -> DataFrame:
    """(entity, term) whose normalised information reaches the threshold: log2(n(t,e) N / (n(t) n(e))) / log2(N / n(e)).

    Rows have a number, the text without base spans, the text's hash and pii. Counts are over rows, copies
    included, for all four: N, those with the term, those with the entity, and those with both anywhere in
    the text. Copies of a passage count once for support: it is the number of distinct contexts, `reach`
    code points on either side of the term's first place in a text with the entity. Terms with less
    support are kept in the text.
    """
    n = rows.count()
    counts = rows.select(F.explode(_terms(F.col("rest"), letters)).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_t"))
    holders = rows.where(F.size("pii") > 0)
    # Rows of one text have the same entities and terms: the first stands for all of them.
    owners = holders.select("row", "hash", F.explode(F.array_distinct(F.transform("pii", lambda s: s["value"]))).alias("entity")).groupBy("hash", "entity").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    known = owners.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("n_texts")).where((F.col("n_texts") >= support) & (F.col("n_e") < n))
    # The threshold is n(t) <= n(t,e) (N / n(e)) ** (1 - threshold), and n(t,e) is at most n(e): other terms can't reach it.
    owners = textops.stored(owners.join(known, "entity").select("row", "entity", "copies", "n_e", (F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - threshold)) + 1e-6).alias("most")), f"{home}/owners")
    held = holders.join(owners.groupBy("row").agg(F.max("most").alias("row_most")), "row").select("row", "row_most", F.explode(_terms(F.col("rest"), letters)).alias("term"))
    near = held.join(counts.where(F.col("n_t") >= support), "term").where("n_t <= row_most").join(owners, "row").where("n_t <= most")
    near = textops.stored(near.select("row", "entity", "term", "copies", "n_e", "n_t"), f"{home}/near")
    told = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    likely = near.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("n_texts"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    likely = textops.stored(likely.where((F.col("n_texts") >= support) & (told >= threshold - 1e-9)).select("entity", "term"), f"{home}/likely")
    pairs = near.join(likely, ["entity", "term"], "left_semi").select("row", "entity", "term")
    wanted = pairs.groupBy("row").agg(F.collect_set("term").alias("wanted"))
    spots = holders.join(wanted, "row").select("row", "rest", F.explode(_spots(F.col("rest"), F.col("wanted"), letters)).alias("s"))
    low = F.greatest(F.col("s.start") - reach, F.lit(0))
    around = F.xxhash64(F.substr("rest", low + 1, F.col("s.end") + reach - low))
    firsts = spots.groupBy("row", F.col("s.value").alias("term")).agg(F.min_by(around, "s.start").alias("context"))
    contexts = pairs.join(firsts, ["row", "term"]).groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"))
    return contexts.where(F.col("contexts") >= support).select("entity", "term")


def detect(docs: DataFrame, text: str = "text", threshold: float = 0.8, support: int = 4, into: tuple[str, str] = ("pii", "terms"), letters: int = LETTERS) -> DataFrame:
    """Adds to docs, in the columns named by `into`, the base spans and the term spans (by start) of every row.

    Terms are looked for in whole texts, outside base spans, and every occurrence of a disclosing term is
    marked in every row, with or without the entity. A term is a word of `letters` letters or more; 1 takes
    all words of letters, short names too. Null and empty texts have no spans. Rows are told
    apart by a number of their own, so null and repeated keys are treated as others. An empty table gives
    none. Columns that have the names in `into` are replaced; all others stay.
    """
    home = textops.shared_dir(docs.sparkSession)
    row, told_here, body = textops.unused(docs, "row"), textops.unused(docs, "told"), F.col(text)
    found = textops.stored(docs.drop(*into).withColumn(into[0], base_spans(text)).withColumn(row, F.monotonically_increasing_id()), f"{home}/found")
    rows = found.select(F.col(row).alias("row"), F.coalesce(body, F.lit("")).alias("body"), F.xxhash64(body).alias("hash"), F.col(into[0]).alias("pii")).withColumn("rest", _rest("body")).drop("body")
    told = textops.stored(disclosing_terms(rows, home, threshold, support, letters=letters), f"{home}/told")
    held = rows.select("row", F.explode(_terms(F.col("rest"), letters)).alias("term")).join(told.select("term"), "term", "left_semi").groupBy(F.col("row").alias(row)).agg(F.collect_set("term").alias(told_here))
    held = textops.stored(held, f"{home}/held")
    terms = F.when(F.col(told_here).isNotNull(), _spots(_rest(text, into[0]), F.col(told_here), letters)).otherwise(F.array().cast(SPAN))
    return found.join(held, row, "left").withColumn(into[1], terms).drop(row, told_here)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(detected: DataFrame, text: str = "text", columns: tuple[str, str] = ("pii", "terms")) -> DataFrame:
    """Rewrites texts: base spans become [KIND], disclosing terms [TERM]; overlapping spans are one. Drops the two columns of spans."""
    spans = F.array_sort(F.transform(F.concat(*columns), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    body = F.col(text)

    def step(a: Column, s: Column) -> Column:
        end = -s["neg"]
        fresh = F.array(F.substr(body, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], fresh)).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, begin, step)
    return detected.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), F.substr(body, done["at"] + 1, F.length(body)))).otherwise(body)).drop(*columns)
