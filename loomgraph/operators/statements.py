"""Ordered scans of statement lists: latest definitions, forward stores, case blocks, registrations, values behind variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import setter_attribute
from .closure import closure
from .scratch import stored

#: Calls that register a listener, and the handler that each calls.
LISTENERS = {"setOnClickListener": "onClick", "setOnLongClickListener": "onLongClick", "setOnTouchListener": "onTouch", "setOnKeyListener": "onKey", "setOnItemClickListener": "onItemClick", "setOnItemSelectedListener": "onItemSelected"}


def latest_definition(stmts: DataFrame, scope: list[str], pos: str, is_definition: str, value: str) -> DataFrame:
    """Adds `defined`: the value of the last definition before each row of its scope, null if there is none."""
    w = Window.partitionBy(*scope).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return stmts.withColumn("defined", F.last(F.when(F.expr(is_definition), F.col(value)), ignorenulls=True).over(w))


def forward_store(stmts: DataFrame, scope: list[str], pos: str, is_store: str, value: str) -> DataFrame:
    """Adds `stored`: the value of the first store after each row of its scope."""
    w = Window.partitionBy(*scope).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    return stmts.withColumn("stored", F.first(F.when(F.expr(is_store), F.col(value)), ignorenulls=True).over(w))


def case_blocks(stmts: DataFrame, scope: list[str], pos: str, is_target: str) -> DataFrame:
    """Adds `block`: the position of the case target whose block (up to the next target) holds the row."""
    w = Window.partitionBy(*scope).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return stmts.withColumn("block", F.last(F.when(F.expr(is_target), F.col(pos)), ignorenulls=True).over(w)).where("block IS NOT NULL")


def registrations(calls: DataFrame, callee: str, listener: str) -> DataFrame:
    """Calls that register a listener, with `handler`: the listener's class and the method that is called."""
    known = F.create_map(*[F.lit(x) for kv in LISTENERS.items() for x in kv])
    return calls.withColumn("method", known[F.col(callee)]).where(F.col("method").isNotNull() & F.col(listener).isNotNull()).withColumn("handler", F.concat_ws(".", listener, "method")).drop("method")


def superclasses(parents: DataFrame) -> DataFrame:
    """(class, ancestor) over a table of (class, parent) of any depth; on a cycle a class is its own ancestor.

    With one parent a class, the ancestors known of each are those of the one as many steps above it added, so that rounds
    grow with the logarithm of the depth; with several parents the general closure is taken.
    """
    every = stored(parents.select("class", "parent").distinct())
    step = every.where("class <> parent")
    if not step.groupBy("class").count().where("count > 1").isEmpty():
        up = closure(step.select(F.col("class").alias("src"), F.col("parent").alias("dst")), step.select(F.col("parent").alias("seed")))
        led = step.join(up, F.col("parent") == F.col("seed")).select("class", F.col("node").alias("ancestor"))
        return led.unionByName(every.where("class = parent").withColumnRenamed("parent", "ancestor")).distinct()
    far, known = step, stored(step.withColumnRenamed("parent", "ancestor"))
    size = known.count()
    while True:
        more = far.join(known.select(F.col("class").alias("parent"), "ancestor"), "parent").select("class", "ancestor")
        known = stored(known.unionByName(more).distinct())
        before, size = size, known.count()
        if size == before:
            return known.unionByName(every.where("class = parent").withColumnRenamed("parent", "ancestor")).distinct()
        far = stored(far.join(far.select(F.col("class").alias("parent"), F.col("parent").alias("next")), "parent").select("class", F.col("next").alias("parent")))


def follow_back(steps: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pos, value, origin, site): what each statement's variable holds, followed back through assignments.

    A step has scope, pos, lhs (the variable it assigns, or null), want (the variable it takes over, or null), value
    (what it holds itself, if want is null) and site (true where the position is to be kept). The latest earlier
    assignment of `want` is found for all steps by one window; these links are then doubled, so rounds grow with the
    logarithm of the longest chain. origin is where the chain ends, site the kept position nearest to that end;
    value is null where a variable is never assigned. Positions are distinct in a scope.
    """
    sets = steps.where("lhs IS NOT NULL").select(*scope, F.col("lhs").alias("var"), "pos", F.col("pos").alias("set"))
    wants = steps.where("want IS NOT NULL").select(*scope, F.col("want").alias("var"), "pos", F.lit(None).cast(steps.schema["pos"].dataType).alias("set"))
    before = Window.partitionBy(*scope, "var").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    found = sets.unionByName(wants).withColumn("up", F.last("set", ignorenulls=True).over(before)).where("set IS NULL").select(*scope, "pos", "up")
    kept = F.when(F.col("site"), F.col("pos"))
    now = steps.join(found, [*scope, "pos"], "left").select(*scope, "pos", F.when(F.col("want").isNull(), F.col("value")).alias("value"), F.col("pos").alias("origin"), kept.alias("site"), "up")
    now = stored(now)
    while True:
        if now.where("up IS NOT NULL").isEmpty():
            return now.drop("up")
        to = now.select(*scope, F.col("pos").alias("up"), F.col("value").alias("v"), F.col("origin").alias("o"), F.col("site").alias("s"), F.col("up").alias("next"))
        moved = now.where("up IS NOT NULL").join(to, [*scope, "up"]).select(*scope, "pos", F.col("v").alias("value"), F.col("o").alias("origin"), F.coalesce("s", "site").alias("site"), F.col("next").alias("up"))
        now = stored(now.where("up IS NULL").unionByName(moved))


def _literal(text: Column) -> Column:
    """The contents of a quoted argument; null for a variable or number."""
    return F.when(text.startswith('"'), F.substr(text, F.lit(2), F.length(text) - 2))


def string_behind(stmts: DataFrame, scope: list[str]) -> DataFrame:
    """The text behind the first argument of every statement, through copies, wrapping calls and preferences.

    stmts: scope, pos, lhs, rhs, rhs_kind (string, local, invoke or other), callee, args. Quoted arguments are texts and
    names are variables. A call of getString with two arguments gives `[p] key default`; other calls pass their first
    argument on, and one with neither a text nor a variable there is passed over. Other right sides end the chain.
    """
    first = F.get("args", F.lit(0))
    stored_text = (F.col("rhs_kind") == "invoke") & F.contains(F.col("callee"), F.lit("getString")) & (F.size("args") == 2)
    named = F.when(first.rlike("^[A-Za-z_$]"), first)
    assigns = stmts.where("lhs IS NOT NULL AND rhs_kind IS NOT NULL")
    calls = F.col("rhs_kind") == "invoke"
    want = F.when(F.col("rhs_kind") == "local", F.col("rhs")).when(calls & ~stored_text, named)
    value = F.when(F.col("rhs_kind") == "string", F.col("rhs")).when(stored_text, F.concat(F.lit("[p] "), first, F.lit(" "), F.get("args", F.lit(1)))).when(calls, _literal(first))
    sets = assigns.select(*scope, "pos", "lhs", want.alias("want"), value.alias("value"), (~calls).alias("ends")).where("ends OR want IS NOT NULL OR value IS NOT NULL").drop("ends")
    uses = stmts.where("lhs IS NULL").select(*scope, "pos", F.lit(None).cast("string").alias("lhs"), named.alias("want"), _literal(first).alias("value"))
    return follow_back(sets.unionByName(uses).withColumn("site", F.lit(False)), scope).drop("site")


def widget_behind(stmts: DataFrame, scope: list[str], fields: DataFrame) -> DataFrame:
    """(scope, pos, value, origin, site): the widget id behind the receiver of every call, and the look-up it came from.

    Casts and copies are followed back to a number, a field with a known id (fields: class, field, id; the scope has
    `class`) or the argument of findViewById, whose position is `site`. A field without an id is passed over; another
    call ends the chain without a value.
    """
    first = F.get("args", F.lit(0))
    number = lambda c: F.when(c.rlike("^-?[0-9]+$"), c)
    known = fields.groupBy("class", F.col("field").alias("rhs")).agg(F.min("id").cast("string").alias("field_id"), F.lit("field").alias("rhs_kind"))
    assigns = stmts.where("lhs IS NOT NULL AND rhs_kind IS NOT NULL").join(known, ["class", "rhs", "rhs_kind"], "left")
    find = (F.col("rhs_kind") == "invoke") & (F.col("callee") == "findViewById")
    want = F.when(F.col("rhs_kind").isin("local", "cast"), F.col("rhs")).when(find & number(first).isNull(), first)
    value = F.when(F.col("rhs_kind") == "int", F.col("rhs")).when(find, number(first)).when(F.col("rhs_kind") == "field", F.col("field_id"))
    sets = assigns.where("rhs_kind <> 'field' OR field_id IS NOT NULL").select(*scope, "pos", "lhs", want.alias("want"), value.alias("value"), find.alias("site"))
    uses = stmts.where("lhs IS NULL").select(*scope, "pos", F.lit(None).cast("string").alias("lhs"), F.col("receiver").alias("want"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("site"))
    return follow_back(sets.unionByName(uses), scope)


def content_views(stmts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, layout): the layout number that the first setContentView of a class sets."""
    arg = F.get("args", F.lit(0))
    sets = stmts.where((F.col("callee") == "setContentView") & arg.rlike("^[0-9]+$"))
    return sets.groupBy(*scope).agg(F.min_by(arg.cast("bigint"), "pos").alias("layout"))


def widget_layouts(widgets: DataFrame, inflated: DataFrame, contents: DataFrame, scope: list[str]) -> DataFrame:
    """Adds `layout` to widgets (scope, pos): that which their receiver was inflated from (scope, pos, layout), else their class's."""
    own = inflated.groupBy(*scope, "pos").agg(F.min("layout").alias("own"))
    both = widgets.join(own, [*scope, "pos"], "left").join(contents.withColumnRenamed("layout", "of_class"), scope, "left")
    return both.select(*widgets.columns, F.coalesce("own", "of_class").alias("layout"))


def switch_edges(stmts: DataFrame, scope: list[str], caller: str, condition: str, cases: DataFrame) -> DataFrame:
    """(key, caller, callee): the calls in the block of each wanted case.

    stmts: scope, pos, kind (case, invoke or other), the named columns caller and condition (of a case, what its test
    compares with), callee; cases: condition and key. A block ends at the next case of its scope.
    """
    blocks = case_blocks(stmts, scope, "pos", "kind = 'case'")
    tested = stmts.where("kind = 'case'").select(*scope, F.col("pos").alias("block"), F.col(condition).alias("condition"))
    return blocks.where("kind = 'invoke'").join(tested, [*scope, "block"]).join(cases, "condition").select("key", F.col(caller).alias("caller"), "callee").distinct()


def field_uses(stmts: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, method): the methods whose statements name a widget's field of their class.

    stmts: class, method, text; fields: class, field, id.
    """
    return stmts.join(fields, "class").where(F.contains("text", F.concat(F.lit(" "), "field", F.lit(">")))).select("id", "method").distinct()


def thread_starts(stmts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pos, method): the run method behind every start call, by the class that its receiver was made of.

    stmts: scope, pos, lhs, rhs, rhs_kind (new with the class as rhs, local, invoke or other), callee, receiver, args. A
    thread made with a first argument runs what that variable was made of.
    """
    runs = F.get("args", F.lit(0))
    made = (F.col("rhs_kind") == "new") & runs.isNull()
    sets = stmts.where("lhs IS NOT NULL AND rhs_kind IN ('new', 'local')").select(*scope, "pos", "lhs", F.when(F.col("rhs_kind") == "local", F.col("rhs")).when(~made, runs).alias("want"), F.when(made, F.col("rhs")).alias("value"))
    uses = stmts.where("callee = 'start' AND lhs IS NULL").select(*scope, "pos", F.lit(None).cast("string").alias("lhs"), F.col("receiver").alias("want"), F.lit(None).cast("string").alias("value"))
    found = follow_back(sets.unionByName(uses).withColumn("site", F.lit(False)), scope).join(uses.select(*scope, "pos"), [*scope, "pos"], "left_semi")
    return found.where("value IS NOT NULL").select(*scope, "pos", F.concat(F.lit("<"), "value", F.lit(": void run()>")).alias("method"))


def code_texts(texts: DataFrame, widgets: DataFrame, setters: DataFrame, strings: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pos, id, type, value): what code shows on widgets.

    texts and widgets: what string_behind and widget_behind give; setters: scope, pos, callee (setText, setHint or
    setTitle), and arg_type, the type of the first parameter; strings: id and value, for a text that is a resource's
    number. An int is a resource's number and shows that resource or nothing; strings and characters are shown as
    they are, even if they look like a number; other types show nothing. Without arg_type, or where it is null, a
    resource's number stands for the resource and anything else for itself. Rows without a value are left out.
    """
    known = F.col("arg_type") if "arg_type" in setters.columns else F.lit(None).cast("string")
    wanted = setters.where(F.col("callee").isin("setText", "setHint", "setTitle")).select(*scope, "pos", "callee", known.alias("arg_type"))
    both = wanted.join(texts.select(*scope, "pos", F.col("value").alias("said")), [*scope, "pos"]).join(widgets.select(*scope, "pos", F.col("value").alias("id")), [*scope, "pos"], "left")
    named = strings.groupBy(F.col("id").cast("string").alias("said")).agg(F.min("value").alias("resource"))
    kind = setter_attribute(F.col("callee")).alias("type")
    given = F.col("arg_type").contains("String") | F.col("arg_type").contains("Char")
    value = F.when(F.col("arg_type").isNull(), F.coalesce("resource", "said")).when(F.col("arg_type") == "int", F.col("resource")).when(given, F.col("said"))
    return both.join(named, "said", "left").select(*scope, "pos", "id", kind, value.alias("value")).where("value IS NOT NULL")
