"""From written names to node ids, and from call sites to methods, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import arity
from graphloom.sources.storage import bucketed, stored

NOT_TYPES = ("LIBRARY", "SHELL_COMMAND", "METHOD")


def _unique(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the value of the keys that have one value only."""
    return df.groupBy(*keys).agg(F.min(value).alias(out), F.countDistinct(value).alias("_n")).where("_n = 1").drop("_n")


def inherited_members(asked: DataFrame, supers: DataFrame, ids: DataFrame) -> DataFrame:
    """(type, name, member) of the distinct (type, name) whose nearest supertypes with a member type of that name settle it.

    All names walk up at once, a level of supertypes at a time. A level with one such member settles the name; with several
    the name is ambiguous, and ``member`` is null; with none the walk goes on to the next level. A name visits a type once, so that cycles end too.
    A name that finds nothing up to the top has no row. ``supers``: source_id, target_id; ``ids``: id of all types.
    """
    up = supers.where("source_id <> target_id").select(F.col("source_id").alias("at"), F.col("target_id").alias("_up")).distinct()
    level = asked.select("type", "name").distinct().withColumn("at", F.col("type"))
    been, out = level, []
    while True:
        above = level.join(up, "at").select("type", "name", F.col("_up").alias("at")).distinct()
        level = stored(above.join(been, ["type", "name", "at"], "left_anti"), "types-above")
        if level.isEmpty():
            break
        been = been.unionAll(level)
        hits = level.withColumn("id", F.concat("at", F.lit("."), "name")).join(ids.select("id").distinct(), "id", "left_semi")
        settled = stored(hits.groupBy("type", "name").agg(F.when(F.count_distinct("id") == 1, F.min("id")).alias("member")), "inherited")
        out.append(settled)
        level = level.join(settled.select("type", "name"), ["type", "name"], "left_anti")
    return reduce(DataFrame.unionAll, out) if out else level.select("type", "name", F.lit(None).cast("string").alias("member"))


def type_names(refs: DataFrame, types: DataFrame, imports: DataFrame, wildcards: DataFrame, packages: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """(file_path, owner, target, resolved) of the distinct names (file_path, owner, target) that resolve.

    The first rule that gives one type wins: a member type of the enclosing type, or (with ``supers``: source_id, target_id) one that it
    inherits, or of the types outwards in the same way, where an ambiguous inheritance ends the search; a unique type of the same file; an explicit import (which, if it is not
    indexed, ends the search); the same package; a globally unique simple name; a
    unique wildcard import; a unique Java type. Dotted names match an id, or resolve
    their first part and add the rest.
    """
    asked = refs.select("file_path", "owner", "target").where("target IS NOT NULL AND target <> ''").distinct()
    known = types.where(~F.col("type").isin(*NOT_TYPES)).select("id", "name", "file_path").distinct()
    ids = known.select("id").distinct()
    head = F.substring_index("target", ".", 1)
    q = asked.withColumn("_head", head).withColumn("_rest", F.expr("substring(target, length(_head) + 1)"))
    steps = F.split("owner", r"\.")
    outer = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
    scopes = q.select("file_path", "owner", "target", "_head", F.posexplode(outer).alias("_level", "type"))
    keys = ["file_path", "owner", "target"]
    member = scopes.withColumn("id", F.concat("type", F.lit("."), "_head")).join(ids, "id", "left_semi").select(*keys, (2 * F.col("_level")).alias("_at"), "id")
    if supers is not None:
        derived = supers.select(F.col("source_id").alias("type")).distinct()
        asked_up = scopes.join(derived, "type", "left_semi").select("type", F.col("_head").alias("name"))
        above = inherited_members(asked_up, supers, ids).withColumnRenamed("name", "_head")
        member = member.unionAll(scopes.join(above, ["type", "_head"]).select(*keys, (2 * F.col("_level") + 1).alias("_at"), F.col("member").alias("id")))
    r1 = member.groupBy(*keys).agg(F.min(F.struct("_at", "id")).alias("_m")).select(*keys, F.col("_m.id").alias("_r1"), F.col("_m.id").isNull().alias("_ambiguous"))
    r2 = _unique(known, ["file_path", "name"], "id", "_r2").withColumnRenamed("name", "_head")
    r3 = imports.select("file_path", F.col("name").alias("_head"), F.col("target").alias("_imported")).groupBy("file_path", "_head").agg(F.min("_imported").alias("_imported"))
    r3 = r3.join(ids.select(F.col("id").alias("_imported"), F.lit(True).alias("_known")), "_imported", "left")
    r4 = packages.select("file_path", F.col("name").alias("_package")).dropDuplicates(["file_path"])
    everywhere = _unique(known, ["name"], "id", "_r5").withColumnRenamed("name", "_head")
    wild = wildcards.select("file_path", F.col("target").alias("_base"))
    hits = q.select("file_path", "_head").distinct().join(wild, "file_path").withColumn("id", F.concat_ws(".", "_base", "_head")).join(ids, "id", "left_semi")
    r6 = _unique(hits, ["file_path", "_head"], "id", "_r6")
    java = _unique(known.where(F.col("file_path").endswith(".java")), ["name"], "id", "_r7").withColumnRenamed("name", "_head")
    exact = ids.select(F.col("id").alias("target"), F.col("id").alias("_r0"))
    joined = (
        q.join(r1, ["file_path", "owner", "target"], "left").join(r2, ["file_path", "_head"], "left").join(r3, ["file_path", "_head"], "left").join(r4, "file_path", "left")
        .withColumn("_in_package", F.concat_ws(".", F.when(F.col("_package") != "", F.col("_package")), "_head"))
        .join(ids.select(F.col("id").alias("_in_package"), F.col("id").alias("_r4")), "_in_package", "left")
        .join(everywhere, "_head", "left").join(r6, ["file_path", "_head"], "left").join(java, "_head", "left").join(exact, "target", "left")
    )
    later = F.coalesce("_r4", "_r5", "_r6", "_r7")
    first = F.coalesce("_r1", "_r2", F.when(F.col("_imported").isNotNull(), F.when(F.col("_known"), F.col("_imported"))).otherwise(later))
    dotted = F.instr("target", ".") > 0
    first = F.when(~F.coalesce("_ambiguous", F.lit(False)), first)
    found = joined.withColumn("_whole", F.when(dotted, F.coalesce("_r0", F.concat(first, F.col("_rest")))).otherwise(first))
    return found.join(ids.select(F.col("id").alias("_whole")), "_whole", "left_semi").select("file_path", "owner", "target", F.col("_whole").alias("resolved"))


def _overloads(methods: DataFrame) -> DataFrame:
    """(receiver, name, method, _arity, _alike): each method with the number of those of its name in its type."""
    sized = methods.select(F.col("owner").alias("receiver"), "name", F.col("id").alias("method"), arity("id").alias("_arity"))
    return sized.withColumn("_alike", F.count("*").over(Window.partitionBy("receiver", "name")))


#: What a call asks for; calls that ask for the same bind the same methods.
_ASKED = ["receiver", "name", "n"]


def _fits() -> Column:
    return (F.col("_alike") == 1) | (F.col("n") == F.col("_arity"))


def bind(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, method): the methods of the receiver with the call's name: the only one, or all with its number of arguments.

    ``calls``: call, receiver, name, n (-1 if unknown); ``methods``: id, owner, name.
    """
    return calls.join(_overloads(methods), ["receiver", "name"]).where(_fits()).select("call", "method")


def _above(types: DataFrame, up: DataFrame) -> DataFrame:
    """(receiver, at, d): the distinct types of ``types`` (receiver) at 0, and each supertype at its least number of steps; cycles end too."""
    level = stored(types.select("receiver", F.col("receiver").alias("at")).distinct(), "types-above")
    been = level.withColumn("d", F.lit(0))
    d = 0
    while not level.isEmpty():
        d += 1
        further = level.join(up, "at").select("receiver", F.col("_up").alias("at")).distinct()
        level = stored(further.join(been, ["receiver", "at"], "left_anti"), "types-above")
        been = been.unionAll(level.withColumn("d", F.lit(d)))
    return been


def _bind_asked(asked: DataFrame, overloads: DataFrame, up: DataFrame, above: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """((receiver, name, n, method), above): what the distinct rows of ``asked`` bind, going up where the receiver binds nothing.

    Only types with something unbound are walked up, and none that is in ``above`` from before. The supertypes met go with their distance, so
    that all levels are one join with the methods.
    """
    direct = stored(asked.join(overloads, ["receiver", "name"]).where(_fits()).select(*_ASKED, "method").distinct(), "bound-directly")
    rest = stored(asked.join(direct.select(*_ASKED).distinct(), _ASKED, "left_anti"), "unbound")
    if rest.isEmpty():
        return direct, above
    new = rest if above is None else rest.join(above.where("d = 0"), "receiver", "left_anti")
    walked = _above(new, up)
    above = walked if above is None else above.unionAll(walked)
    there = overloads.withColumnRenamed("receiver", "at")
    far = rest.join(above.where("d > 0"), "receiver").join(there, ["at", "name"]).where(_fits())
    nearest = far.withColumn("_k", F.rank().over(Window.partitionBy(*_ASKED).orderBy("d"))).where("_k = 1")
    return stored(direct.unionAll(nearest.select(*_ASKED, "method").distinct()), "bound-asked"), above


def _calls(calls: DataFrame) -> DataFrame:
    """A null number of arguments is an unknown one, so that equal calls compare as equal."""
    return calls.withColumn("n", F.coalesce("n", F.lit(-1)))


def bind_through_supertypes(calls: DataFrame, methods: DataFrame, supers: DataFrame) -> DataFrame:
    """(call, method): as ``bind``, going up from the receiver a level at a time until one binds or nothing is above.

    ``calls`` has a row a call. Bound are the distinct receivers, names and numbers of arguments, and then the calls by them. A type is visited once from
    each receiver, so that cycles end too.
    """
    calls = _calls(calls)
    known, up = stored(_overloads(methods), "overloads"), _up(supers)
    bound, _ = _bind_asked(stored(calls.select(*_ASKED).distinct(), "asked"), known, up, None)
    return calls.join(bound, _ASKED).select("call", "method").distinct()


def _up(supers: DataFrame) -> DataFrame:
    return stored(supers.select(F.col("source_id").alias("at"), F.col("target_id").alias("_up")).distinct(), "supertypes")


def bind_chains(calls: DataFrame, methods: DataFrame, supers: DataFrame, returns: DataFrame) -> DataFrame:
    """(call, method) of single and chained calls: ``calls`` (call, parent, receiver, name, n), ``returns`` (method_id, class_id).

    A call without a parent has a receiver. A call on the result of another, its parent, has the return class of the method that the
    parent binds as receiver, if the parent binds exactly one. So the links of all chains are bound
    a depth at a time, until no link is left whose parent gave a class. Each call has one row and one parent, so that it is bound once.

    Methods, supertypes and return classes are stored once, and links are dealt once by their parent. A depth binds what its calls ask for,
    each receiver, name and number of arguments once, so that calls meet methods in one join whatever the height of the types.
    """
    calls = stored(_calls(calls.select("call", "parent", "receiver", "name", "n")), "calls")
    known, up = stored(_overloads(methods), "overloads"), _up(supers)
    given = stored(returns.select(F.col("method_id").alias("method"), "class_id").dropDuplicates(["method"]), "return-classes")
    level, out, above = calls.where("parent IS NULL AND receiver IS NOT NULL").select("call", *_ASKED), [], None
    with bucketed(calls.where("parent IS NOT NULL").select("call", "parent", "name", "n"), "links", "parent") as links:
        while True:
            asked, above = _bind_asked(stored(level.select(*_ASKED).distinct(), "asked"), known, up, above)
            out.append(stored(level.join(asked, _ASKED).select("call", "method").distinct(), "links-bound"))
            one = asked.groupBy(*_ASKED).agg(F.min("method").alias("method"), F.count("*").alias("_n")).where("_n = 1")
            classes = stored(one.join(given, "method").select(*_ASKED, "class_id"), "classes-given")
            parents = level.join(classes, _ASKED).select(F.col("call").alias("parent"), F.col("class_id").alias("receiver"))
            level = stored(links.join(parents, "parent").select("call", "receiver", "name", "n"), "next-links")
            if level.isEmpty():
                return reduce(DataFrame.unionAll, out)


def overrides(methods: DataFrame, supers: DataFrame) -> DataFrame:
    """OVERRIDES edges: each method to the smallest id of its name and arity in each direct supertype; constructors have none."""
    sized = methods.where("name <> '<init>'").select("id", "owner", "name", arity("id").alias("k"))
    above = sized.select(F.col("id").alias("target_id"), F.col("owner").alias("target_owner"), "name", "k")
    pairs = sized.join(supers.select(F.col("source_id").alias("owner"), F.col("target_id").alias("target_owner")).distinct(), "owner").join(above, ["target_owner", "name", "k"])
    return pairs.groupBy(F.col("id").alias("source_id"), "target_owner").agg(F.min("target_id").alias("target_id")).select(F.lit("OVERRIDES").alias("type"), "source_id", "target_id")


def libraries(imports: DataFrame, dependencies: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(LIBRARY nodes, USES_LIBRARY edges): an import belongs to the first declared dependency whose group begins it.

    Imports whose full or simple name is a node of the project are left out. Each import is
    met by all the dotted names that it begins with, so that the prefix join is one on equal names.
    """
    own = nodes.where("type <> 'LIBRARY'")
    foreign = imports.join(own.select(F.col("id").alias("target")).distinct(), "target", "left_anti").join(own.select("name").distinct(), "name", "left_anti")
    steps = F.split("target", r"\.")
    begun = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
    each = foreign.where(F.instr("target", ".") > 0).select("source_id", "target", "name", F.explode(begun).alias("group_id"))
    hit = each.join(dependencies.select("ord", "group_id", "artifact"), "group_id")
    best = hit.groupBy("source_id", "target", "name").agg(F.min(F.struct("ord", "group_id", "artifact")).alias("d"))
    made = best.select(F.col("target").alias("id"), F.lit("LIBRARY").alias("type"), "name", F.col("target").alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("line_number"), F.concat_ws(":", "d.group_id", "d.artifact").alias("code_snippet"), F.lit(0).cast("bigint").alias("last_modified")).dropDuplicates(["id"])
    return made, best.select(F.lit("USES_LIBRARY").alias("type"), "source_id", F.col("target").alias("target_id"))


def resolution_rate(calls: DataFrame, bound: DataFrame, methods: DataFrame) -> DataFrame:
    """(seen, resolved, accessor_misses, rate) of the calls into types of the project."""
    inside = calls.where("receiver IS NOT NULL").join(methods.select(F.col("owner").alias("receiver")).distinct(), "receiver", "left_semi")
    marked = inside.join(bound.select("call").distinct().withColumn("_hit", F.lit(True)), "call", "left")
    accessor = F.col("name").rlike("^(get|set|is)[A-Z]|^(builder|toBuilder|build)$") & F.col("_hit").isNull()
    sums = marked.agg(F.count("*").alias("seen"), F.count("_hit").alias("resolved"), F.count(F.when(accessor, 1)).alias("accessor_misses"))
    return sums.withColumn("rate", F.when(F.col("seen") > F.col("accessor_misses"), F.round(F.col("resolved") / (F.col("seen") - F.col("accessor_misses")), 4)))


def top_unresolved(calls: DataFrame, bound: DataFrame, limit: int = 10) -> DataFrame:
    return calls.join(bound.select("call").distinct(), "call", "left_anti").groupBy("receiver", "name", "n").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "receiver", "name", "n").limit(limit)
