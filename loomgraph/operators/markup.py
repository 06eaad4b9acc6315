"""Trees of marked-up texts by windows over their tags: elements with parent and depth, attributes, edges, included layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import escaped, is_container

#: Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Patterns of what is no element, of contents that are no markup, and of tags.
ASIDE = r"(?s)<!--.*?-->|<\?.*?\?>|<![^>]*>"
RAW = tuple(rf"(?is)(<{e}\b[^>]*>).*?(</{e}\s*>)" for e in ("script", "style"))
TAG = r"""</?[A-Za-z_](?:[^"'>]|"[^"]*"|'[^']*')*>"""
NAME = r"^</?([^\s/>]+)"
ATTRIBUTE = r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def tags(docs: DataFrame, key: str, text: str, leaves: tuple[str, ...] = VOID) -> DataFrame:
    """(key, pos, tag, closing, single, source): the tags of each text in order; single ones have no content."""
    clean = F.regexp_replace(text, ASIDE, "")
    for pattern in RAW:
        clean = F.regexp_replace(clean, pattern, "$1$2")
    found = docs.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(TAG), F.lit(0))).alias("pos", "source"))
    named = found.withColumn("tag", F.regexp_extract("source", NAME, 1))
    return named.select(key, "pos", "tag", F.startswith("source", F.lit("</")).alias("closing"), (F.endswith("source", F.lit("/>")) | F.col("tag").isin(*leaves)).alias("single"), "source")


def tree(docs: DataFrame, key: str, text: str, leaves: tuple[str, ...] = VOID) -> DataFrame:
    """(key, ordinal, parent, depth, tag, attributes) of every element of each text, of any depth; roots have the parent -1.

    A text is parted at its tags; the depth is the number of elements open there, and the parent the last element
    one level up. `leaves` never hold others. An end tag closes the innermost element, and none where nothing is open;
    elements that are never closed are open to the end. attributes is an array of (name, value). Null texts have none.
    """
    order = Window.partitionBy(key).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("closing") & ~F.col("single"), -1).when(~F.col("closing") & ~F.col("single"), 1).otherwise(0)
    level = tags(docs, key, text, leaves).withColumn("sum", F.sum(move).over(so_far))
    level = level.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    own = level.where("NOT closing").withColumn("depth", (F.col("open") - F.when(F.col("single"), 0).otherwise(1)).cast("int")).withColumn("ordinal", F.row_number().over(order) - 1)
    sides = F.array(F.struct(F.col("depth").alias("level"), F.col("ordinal").alias("held")), F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast("int").alias("held")))
    both = own.withColumn("side", F.explode(sides)).select(key, "pos", "ordinal", "depth", "tag", "source", "side.level", "side.held")
    above = F.last("held", ignorenulls=True).over(Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    names, quoted, single = (F.regexp_extract_all("source", F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2, 3))
    attributes = F.transform(F.arrays_zip(names.alias("name"), quoted.alias("a"), single.alias("b")), lambda x: F.struct(x["name"].alias("name"), F.concat(x["a"], x["b"]).alias("value")))
    found = both.withColumn("parent", above).where("held IS NULL")
    return found.select(key, "ordinal", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "tag", attributes.alias("attributes"))


def attribute(name: str) -> Column:
    """The first value of an attribute of a tree's rows; null without it."""
    return F.get(F.filter("attributes", lambda a: a["name"] == name), F.lit(0))["value"]


def hold_edges(elements: DataFrame, key: str) -> DataFrame:
    """(key, parent, of, ordinal): each element and the one that holds it; `of` is the text that the held one lies in.

    An `include` element stands for the roots of the layout that it names (`@layout/name`), which its own parent holds; of a
    layout that is not there nothing is held.
    """
    plain = elements.where("parent >= 0 AND tag <> 'include'").select(key, "parent", F.col(key).alias("of"), "ordinal")
    named = elements.where("parent >= 0 AND tag = 'include'").select(key, "parent", F.substring_index(attribute("layout"), "/", -1).alias("of"))
    roots = elements.where("parent < 0").select(F.col(key).alias("of"), "ordinal")
    return plain.unionByName(named.join(roots, "of").select(key, "parent", "of", "ordinal"))


#: The attributes that tell what a view shows.
INTEREST = ("src", "text", "hint", "background")


def views(elements: DataFrame, key: str, id_: str = "id", interest: dict[str, str] | None = None) -> DataFrame:
    """(key, ordinal, uid, tag, is_leaf, is_container, src, text, hint, background) of a tree's elements.

    The uid is the attribute id_, else `i-` and the ordinal; interest names the attributes that the last four come from.
    """
    wanted = interest or {c: c for c in INTEREST}
    inner = F.lead("parent").over(Window.partitionBy(key).orderBy("ordinal")) == F.col("ordinal")
    shown = [(attribute(wanted[c]) if c in wanted else F.lit(None).cast("string")).alias(c) for c in INTEREST]
    return elements.select(key, "ordinal", F.coalesce(attribute(id_), F.concat(F.lit("i-"), "ordinal")).alias("uid"), "tag", ~F.coalesce(inner, F.lit(False)), is_container(F.col("tag")).alias("is_container"), *shown).toDF(key, "ordinal", "uid", "tag", "is_leaf", "is_container", *INTEREST)


def start_tags(elements: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, text): each element's start tag written anew, its values escaped."""
    written = F.transform("attributes", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escaped(a["value"]), F.lit('"')))
    return elements.select(key, "ordinal", F.concat(F.lit("<"), "tag", F.array_join(written, ""), F.lit(">")).alias("text"))
