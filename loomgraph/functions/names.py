"""Scalar functions over method names, types and resource ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL, FIND, HOLD, USE, EVENT = range(5)

#: What a node and an edge belong to, and what a handler graph is known by.
APP, KEYS = "app_id", ["app_id", "uid", "eid"]


def node_kind(name: Column) -> Column:
    """ANDROID, JAVA or METHOD by the first token of the class name."""
    first = F.substring_index(name, ".", 1)
    return F.when(first.isin("<android", "<androidx") | F.startswith(name, F.lit("<com.android.")), "ANDROID").when(first.isin("<java", "<javax") | F.startswith(name, F.lit("<com.sun.")), "JAVA").otherwise("METHOD")


def class_of(name: Column) -> Column:
    return F.substring_index(F.substr(name, F.lit(2)), ":", 1)


def native_package(cls: Column) -> Column:
    """Two tokens of a platform class; support and vendor prefixes are folded into android."""
    token = F.split(cls, r"\.")
    at = lambda i: F.get(token, F.lit(i))
    return (
        F.when(F.startswith(cls, F.lit("android.support.v")), F.concat(F.lit("android."), at(3)))
        .when(F.startswith(cls, F.lit("android.support.")), F.concat(F.lit("android."), at(2)))
        .when(F.startswith(cls, F.lit("com.android.")), F.concat(F.lit("android."), at(2)))
        .otherwise(F.concat_ws(".", at(0), at(1)))
    )


def to_hex(decimal: Column) -> Column:
    return F.lower(F.hex(decimal.cast("bigint")))


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def composite(uid: Column, xml: Column) -> Column:
    return F.concat_ws("$", uid.cast("string"), xml)


def smali_type(name: Column) -> Column:
    """Descriptor of a Java type: arrays lead with brackets, primitives are one letter, classes L...;."""
    plain = F.regexp_replace(F.regexp_replace(name, "<.*>", ""), r"\[\]", "")
    depth = ((F.length(name) - F.length(F.regexp_replace(name, r"\[\]", ""))) / 2).cast("int")
    letters = {"void": "V", "boolean": "Z", "byte": "B", "short": "S", "char": "C", "int": "I", "long": "J", "float": "F", "double": "D"}  # fixed values: type descriptors
    code = F.concat(F.lit("L"), F.replace(plain, F.lit("."), F.lit("/")), F.lit(";"))
    for word, letter in letters.items():
        code = F.when(plain == word, letter).otherwise(code)
    return F.concat(F.repeat(F.lit("["), depth), code)


def smali_method(signature: Column) -> Column:
    """`type name(args)` to `name(ARGS)TYPE`."""
    result, rest = F.substring_index(signature, " ", 1), F.substring_index(signature, " ", -1)
    args = F.regexp_extract(signature, r"\((.*)\)", 1)
    codes = F.when(args == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(args, ","), smali_type), ""))
    return F.concat(F.substring_index(rest, "(", 1), F.lit("("), codes, F.lit(")"), smali_type(result))


def is_noise(name: Column, calls: list[str] = (), classes: list[str] = ()) -> Column:
    """Names without a parameter list, and those whose method or class part holds a listed word."""
    method, cls = F.substring_index(F.substring_index(name, ":", -1), "(", 1), F.substring_index(name, ":", 1)
    out = ~F.contains(name, F.lit("("))
    for w in calls:
        out = out | F.contains(method, F.lit(w))
    for w in classes:
        out = out | F.contains(cls, F.lit(w))
    return out


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of Java: 31 times the hash so far plus the character, with the sign folded in."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(units, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def tpl_package(descriptor: Column) -> Column:
    """Lcom/x/y to com.x.y."""
    return F.translate(F.substr(descriptor, F.lit(2)), "/", ".")


def to_hex_upper(decimal: Column) -> Column:
    return F.hex(decimal.cast("bigint"))


def layout_base(file: Column) -> Column:
    return F.substring_index(file, ".xml", 1)


def signature_in(text: Column) -> Column:
    """The first method signature in a statement, from < to its >, both kept; null without one.

    The names <init> and <clinit> of constructors are parts of it.
    """
    return F.nullif(F.regexp_extract(text, "<(?:[^<>]|<(?:cl)?init>)*>", 0), F.lit(""))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def method_suffix(name: Column) -> Column:
    """From the first colon on; null without one."""
    at = F.locate(":", name)
    return F.when(at > 0, F.substr(name, at))


def sample_parts(name: Column) -> Column:
    """TIME-SHA-INDEX as a struct (time, app, index)."""
    p = F.split(name, "-")
    return F.struct(F.get(p, F.lit(0)).alias("time"), F.get(p, F.lit(1)).alias("app"), F.get(p, F.lit(2)).cast("int").alias("index"))


def flow_step(statement: Column) -> Column:
    """A data-flow statement as `<signature>==arguments`, or its signature alone without any."""
    sig, args = (F.regexp_extract(statement, r"(<.*>)\((.*).$", k) for k in (1, 2))
    return F.when(args == "", sig).otherwise(F.concat(sig, F.lit("=="), args))


def escaped(text: Column) -> Column:
    """Quotes and line breaks as entities, as in written markup."""
    for raw, code in (("&", "&amp;"), ('"', "&quot;"), ("\n", "&#10;")):  # fixed values: entities
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def printable(text: Column) -> Column:
    """Control characters and the replacement character become spaces."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f\x{fffd}]", " ")


def is_container(tag: Column) -> Column:
    return F.lower(tag).rlike("(layout|container)$")


def setter_attribute(name: Column) -> Column:
    """setText to text."""
    return F.lower(F.substr(name, F.lit(4)))


def base_name(path: Column) -> Column:
    """The file's name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


#: Class prefixes that are not an app's own, for events and for texts in code.
NOT_APP_EVENTS = ("androidx.", "android.support.", "com.google.")
NOT_APP_TEXTS = ("java.", "javax.", "android.", "androidx.")


def is_app_class(cls: Column, skipped: tuple[str, ...] = NOT_APP_EVENTS) -> Column:
    out = F.lit(True)
    for p in skipped:
        out = out & ~F.startswith(cls, F.lit(p))
    return out


def first_tokens(name: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(name, " "), 1, n), " ")
