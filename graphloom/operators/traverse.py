"""Reachability: directional search with free containment hops, and components.

A search goes level by level. DECLARES_METHOD costs nothing and is crossed in both
directions; every other edge costs one. Within a level the costed arrivals settle
first, then the free closure; the first settling counts, which makes the result a
function of the graph alone. In a directional search an owner reached from its
method is context: it is shown (outgoing) or not (incoming), and never expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import CodeGraph
from graphloom.sources.storage import dropped, stored

UNBOUNDED_ABOVE = 20


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id"))


def search(g: CodeGraph, starts: DataFrame, depth: int, direction: str, library_leaf: bool = False, allowed_types: list[str] | None = None) -> DataFrame:
    """(id, depth) of the nodes within ``depth`` of ``starts`` (a column id), themselves left out; direction ``in``, ``out`` or ``both``."""
    return _search(g, starts.select(F.lit(0).alias("start"), "id"), depth, direction, library_leaf, allowed_types, one=True).select("id", "depth")


def search_many(g: CodeGraph, starts: DataFrame, depth: int, direction: str, library_leaf: bool = False, allowed_types: list[str] | None = None) -> DataFrame:
    """(start, id, depth): a search from each group of ``starts`` (start, id), all in one run; the rows of a start are those of ``search`` from its ids.

    A place of the frontier is a start and a node, and settles once a start. So a level is the same few joins whatever the number of
    starts. Only edges of ``allowed_types`` are followed, if they are given; DECLARES_METHOD is among them or not followed either.
    """
    return _search(g, starts, depth, direction, library_leaf, allowed_types, one=False)


def _search(g: CodeGraph, starts: DataFrame, depth: int, direction: str, library_leaf: bool, allowed_types: list[str] | None, one: bool) -> DataFrame:
    """``search_many``; with ``one`` the start is 0 in all rows, and a level is met by semi-joins, which go down into the tables that edges may be a view of."""
    edges = g.edges.where("source_id <> target_id")
    if allowed_types is not None:
        edges = edges.where(F.col("type").isin(*allowed_types))
    declares = edges.where("type = 'DECLARES_METHOD'").select(F.col("source_id").alias("o"), F.col("target_id").alias("m"))
    other = edges.where("type <> 'DECLARES_METHOD'")
    forward = other.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    backward = other.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    costed = {"out": forward, "in": backward, "both": forward.unionAll(backward)}[direction]
    libraries = g.nodes.where("type = 'LIBRARY'").select("id").distinct() if library_leaf else None

    def expandable(df: DataFrame) -> DataFrame:
        """Places but for libraries; starts are never among them."""
        return df if libraries is None else df.join(libraries, "id", "left_anti").select("start", "id")

    def step(front: DataFrame, links: DataFrame, here: str, there: str, seen: DataFrame) -> DataFrame:
        if one:
            found = links.join(front.select(F.col("id").alias(here)), here, "left_semi").select(F.lit(0).alias("start"), F.col(there).alias("id")).distinct()
        else:
            found = links.join(front.select("start", F.col("id").alias(here)), here).select("start", F.col(there).alias("id")).distinct()
        return found.join(seen, ["start", "id"], "left_anti")

    starts = stored(starts.select("start", "id").distinct(), "starts")
    seen, shown = starts, []
    previous = None
    for d in range(depth + 1):
        if d == 0:
            arrived = front = starts
        else:
            arrived = stored(step(previous, costed, "a", "b", seen), "level")
            seen = seen.unionAll(arrived)
            shown.append(arrived.withColumn("depth", F.lit(d)))
            if arrived.isEmpty():
                break
            front = expandable(arrived)
        level = front
        while True:
            down = step(front, declares, "o", "m", seen)
            up = step(front, declares, "m", "o", seen)
            free = down.withColumn("_down", F.lit(True)).unionAll(up.withColumn("_down", F.lit(False))).groupBy("start", "id").agg(F.max("_down").alias("_down"))
            free = stored(free, "free")
            if free.isEmpty():
                break
            seen = seen.unionAll(free.select("start", "id"))
            shown.append((free if direction != "in" else free.where("_down")).select("start", "id").withColumn("depth", F.lit(d)))
            front = expandable(free.select("start", "id") if direction == "both" else free.where("_down").select("start", "id"))
            level = level.unionAll(front)
        previous = level
    out = starts.limit(0).withColumn("depth", F.lit(0))
    for s in shown:
        out = out.unionByName(s)
    known = g.nodes.select("id").join(out.select("id"), "id", "left_semi")  # what is found is often little, and then the nodes are not moved
    return out.join(known, "id", "left_semi").select("start", "id", "depth")


def _one(g: CodeGraph, node_id: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(node_id,)], "id string")


def callers(g: CodeGraph, node_id: str, depth: int) -> DataFrame:
    return search(g, _one(g, node_id), depth, "in")


def callees(g: CodeGraph, node_id: str, depth: int) -> DataFrame:
    return search(g, _one(g, node_id), depth, "out")


def impact(g: CodeGraph, node_id: str, depth: int) -> DataFrame:
    return search(g, _one(g, node_id), depth, "both")


def related(g: CodeGraph, node_id: str, depth: int) -> DataFrame:
    """As ``impact`` with libraries as leaves; beyond twenty levels the whole component."""
    if depth > UNBOUNDED_ABOVE:
        whole = components(g)
        root = whole.where(F.col("id") == node_id).select("root")
        return whole.join(root, "root", "left_semi").where(F.col("id") != node_id).select("id", F.lit(depth).alias("depth"))
    return search(g, _one(g, node_id), depth, "both", library_leaf=True)


#: Bits of a node's number when nodes are ordered: 29 and 28 of them are scrambled; six more hold the size of a degree.
_LOW, _NUMBER = 28, 57


def _half(c: Column, k: int, bits: int) -> Column:
    return F.xxhash64(c, F.lit(k)).bitwiseAND((1 << bits) - 1)


def _scrambled(n: Column, k: int) -> Column:
    """A number of 57 bits as another one, each hit once; ``_unscrambled`` is the way back."""
    high, low = F.shiftright(n, _LOW), n.bitwiseAND((1 << _LOW) - 1)
    high = high.bitwiseXOR(_half(low, k, _NUMBER - _LOW))
    return F.shiftleft(high, _LOW).bitwiseOR(low.bitwiseXOR(_half(high, k, _LOW)))


def _unscrambled(n: Column, k: int) -> Column:
    high, low = F.shiftright(n, _LOW), n.bitwiseAND((1 << _LOW) - 1)
    low = low.bitwiseXOR(_half(high, k, _LOW))
    return F.shiftleft(high.bitwiseXOR(_half(low, k, _NUMBER - _LOW)), _LOW).bitwiseOR(low)


def _priority(n: Column, degree: Column | None, k: int) -> Column:
    scrambled = _scrambled(n, k)
    return scrambled if degree is None else F.shiftleft(F.floor(F.log2(degree)).cast("bigint"), _NUMBER).bitwiseOR(scrambled)


def components(g: CodeGraph) -> DataFrame:
    """(id, root) for every node: the smallest id connected with it by edges of any kind, also over ids without a node.

    Nodes are numbered, and the graph is contracted: in a round each node goes into the first of its neighbours and itself, in an order that is
    new in each round. Two rounds of three put nodes of large degree first, so that what lies round a hub is gone at once; the third is by chance alone and
    leaves a constant share of any graph. The first node of a component always takes its neighbours in, so that the rounds end; their
    number grows with the logarithm of the graph, and what a round reads shrinks.
    """
    ends = g.edges.where("source_id <> target_id").select("source_id", "target_id")
    numbers = stored(_ids(ends, "source_id").unionAll(_ids(ends, "target_id")).distinct().withColumn("n", F.monotonically_increasing_id()), "component-numbers")
    first = ends.join(numbers.select(F.col("id").alias("source_id"), F.col("n").alias("s")), "source_id").select("s", "target_id")
    both = first.join(numbers.select(F.col("id").alias("target_id"), F.col("n").alias("t")), "target_id")
    links = stored(both.select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).distinct(), "links")
    moves: list[DataFrame] = []
    while not links.isEmpty():
        k, near = len(moves), links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if k % 3 < 2:
            degrees = stored(near.groupBy("u").agg(F.count("*").alias("d")), "degrees")
            near = near.join(degrees.select(F.col("u").alias("v"), "d"), "v")
            best = near.groupBy("u").agg(F.max(_priority(F.col("v"), F.col("d"), k)).alias("b"), F.count("*").alias("d"))
            best = best.select("u", F.greatest("b", _priority(F.col("u"), F.col("d"), k)).alias("b"))
        else:
            best = near.groupBy("u").agg(F.max(_priority(F.col("v"), None, k)).alias("b")).select("u", F.greatest("b", _priority(F.col("u"), None, k)).alias("b"))
        to = stored(best.select("u", _unscrambled(F.col("b").bitwiseAND((1 << _NUMBER) - 1), k).alias("to")), "moves")
        moved = links.join(to, "u").select(F.col("to").alias("s"), "v").join(to.withColumnRenamed("u", "v"), "v").where("s <> to")
        before, links = links, stored(moved.select(F.least("s", "to").alias("u"), F.greatest("s", "to").alias("v")).distinct(), "links")
        dropped(before)
        if k % 3 < 2:
            dropped(degrees)
        moves.append(to)
    if not moves:
        return g.nodes.select("id", F.col("id").alias("root"))
    last = moves.pop()
    while moves:  # a node that a round leaves alone is not in the next one
        to = moves.pop()
        further = stored(to.join(last.select(F.col("u").alias("to"), F.col("to").alias("_far")), "to", "left").select("u", F.coalesce("_far", "to").alias("to")), "moves")
        dropped(to)
        dropped(last)
        last = further
    placed = stored(numbers.join(last, F.col("n") == F.col("u")).select("id", "to"), "components")
    roots = stored(placed.groupBy("to").agg(F.min("id").alias("root")), "roots")
    return g.nodes.select("id").join(placed.join(roots, "to").select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def trace_chain(g: CodeGraph, node_id: str) -> DataFrame:
    """All nodes of a node's component, itself included."""
    whole = components(g)
    return whole.join(whole.where(F.col("id") == node_id).select("root"), "root", "left_semi").select("id")


def roots_with_reach(g: CodeGraph, ddd: bool = True) -> DataFrame:
    """Production aggregates (or, without any, controllers) with the size of their component, and whether most share that size."""
    from graphloom.functions.paths import is_under_test_dir

    own = g.nodes.where(~is_under_test_dir("file_path"))
    roots = own.where("type = 'AGGREGATE'") if ddd else own.where("type = 'CONTROLLER'")
    if ddd and roots.isEmpty():
        roots = own.where("type = 'CONTROLLER'")
    whole = stored(components(g), "components")
    sizes = whole.groupBy("root").agg(F.count("*").alias("reach"))
    return roots.select("id", "type").join(whole, "id").join(sizes, "root").select("id", "type", "reach")


def common_reach(roots: DataFrame) -> DataFrame:
    """The reach that over half of the roots, and two at least, share."""
    total = roots.agg(F.count("*").alias("_all"))
    return roots.groupBy("reach").agg(F.count("*").alias("n")).crossJoin(total).where((F.col("n") * 2 > F.col("_all")) & (F.col("n") >= 2)).select("reach", "n")  # one row on the other side


def by_granularity(found: DataFrame, nodes: DataFrame, granularity: str, start_type: str | None = None) -> DataFrame:
    """``class`` drops methods, ``method`` and ``all`` keep them, ``auto`` keeps them if the start is one."""
    keep = granularity in ("method", "all") or (granularity == "auto" and start_type == "METHOD")
    return found if keep else found.join(nodes.where("type <> 'METHOD'").select("id"), "id", "left_semi")


def without_library_flood(g: CodeGraph, found: DataFrame, start: str, start_type: str, keep_own: bool) -> DataFrame:
    """Libraries go, unless the start is one, or they are next to it and asked for."""
    if start_type == "LIBRARY":
        return found
    libraries = g.nodes.where("type = 'LIBRARY'").select("id")
    if keep_own:
        near = _ids(g.edges_from(start), "target_id").unionAll(_ids(g.edges_to(start), "source_id")).distinct()
        libraries = libraries.join(near, "id", "left_anti")
    return found.join(libraries, "id", "left_anti")
