"""Queries of node views, replies, upkeep and call statistics over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import declarations, ids
from graphloom.operators import cochange, impact, resolve, search, store, traverse
from graphloom.plans import oracle as O
from graphloom.plans.joins import _name, call_tables
from graphloom.plans.queries import ORDER, _pairs_sql, commits, graph, query
from graphloom.sources.storage import table

# --- declarations --------------------------------------------------------------------------------------------------------------


def _snippets(spark, d):
    """Made declarations: every part a class with comments, annotations, a generic base, interfaces and a body."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("/* old\n { */\n// gone {\n\n@Route(path = {\""), F.col("p_name"), F.lit("{;\"}, ends = ';')\nclass P"), key, F.lit("<T extends Low<A, "), key, F.lit(">>"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("  extends Base<X, "), key, F.lit(">"))), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("\n  implements I"), F.col("p_partkey") % 7, F.lit("<K, V>,  J"))), F.lit(" {\n  int x; // implements Z\n}"),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("snippet"), F.when(F.col("p_partkey") % 5 == 0, "a.py").otherwise("a.java").alias("path"))


_HEAD = """'@Route(path = {"' || p_name || '{;"}, ends = '';'')' || chr(10) || 'class P' || p_partkey || '<T extends Low<A, ' || p_partkey || '>>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '  extends Base<X, ' || p_partkey || '>' END
 || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE chr(10) || '  implements I' || (p_partkey % 7) || '<K, V>,  J' END"""


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '/* old' || chr(10) || ' {{ */' || chr(10) || '// gone {{' || chr(10) || chr(10) || {_HEAD} || ' {{' || chr(10) || '  int x; // implements Z' || chr(10) || '}}' ELSE {_HEAD} END AS declaration,
CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN '' ELSE 'Base<X, ' || p_partkey || '>' END AS bases, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 0 THEN '' ELSE 'I' || (p_partkey % 7) || '<K, V>|J' END AS interfaces FROM part"""
)
def declarations_of_snippets(spark, d):
    s, p = F.col("snippet"), F.col("path")
    clause = lambda word: F.array_join(declarations.supertype_clause(s, p, word), "|")
    return _snippets(spark, d).select("p_partkey", declarations.declaration(s, p).alias("declaration"), clause("extends").alias("bases"), clause("implements").alias("interfaces"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS snippet, CAST(length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) + 1 AS INTEGER) AS line FROM documents")
def first_lines_of_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.first_lines("text").alias("snippet"), ids.line_at("text", 100).alias("line"))


@query("SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'))) AS snake FROM documents WHERE text IS NOT NULL")
def snake_case_texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(ids.snake_case("text"), 256).alias("snake"))


@query(
    O.with_graph(
        """SELECT DISTINCT source_id, target_id, array_to_string(a[1:n], '.') AS prefix FROM (SELECT source_id, target_id, a, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i] = b[i], false)), false) - 1, len(a)) AS n
FROM (SELECT source_id, target_id, string_split(source_id, '.') AS a, string_split(target_id, '.') AS b FROM edges))"""
    )
)
def shared_prefixes(spark, d):
    e = graph(spark, d).edges.select("source_id", "target_id").distinct()
    return e.select("source_id", "target_id", ids.shared_prefix("source_id", "target_id").alias("prefix"))


# --- replies ---------------------------------------------------------------------------------------------------------------------


@query(
    O.with_graph(
        """SELECT type, id, n, CAST(rank AS INTEGER) AS rank, greatest(total - 5, 0) AS more FROM (SELECT type, id, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, id) AS rank, count(*) OVER (PARTITION BY type) AS total
FROM (SELECT n.type, n.id, count(*) AS n FROM nodes n JOIN edges e ON e.target_id = n.id GROUP BY 1, 2)) WHERE rank <= 5"""
    )
)
def first_nodes_and_more(spark, d):
    g = graph(spark, d)
    fan = g.edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).join(g.nodes.select("id", "type"), "id")
    return search.first_and_more(fan, ["type"], [F.desc("n"), "id"], 5).select("type", "id", "n", "rank", "more")


@query(O.with_graph("SELECT id FROM nodes WHERE id IN (SELECT id FROM reached) AND type NOT IN ('METHOD', 'LIBRARY')", *O.search_sql(f"SELECT '{ORDER}' AS id", 2, "both")))
def related_types(spark, d):
    """What is near an order, without methods and without libraries."""
    g = graph(spark, d)
    found = traverse.by_granularity(traverse.impact(g, ORDER, 2), g.nodes, "auto", "AGGREGATE")
    return traverse.without_library_flood(g, found, ORDER, "AGGREGATE", False).select("id")


_NEAR_ORDERS = "SELECT id, type, CASE WHEN " + O.GUARD_TEST + " THEN 'test' WHEN type IN ('AGGREGATE', 'DOMAIN_EVENT', 'COMMAND', 'COMMAND_HANDLER', 'PROJECTION_HANDLER') THEN 'significant' ELSE 'other' END AS part FROM nodes WHERE id IN (SELECT id FROM reached)"


@query(
    O.with_graph(
        f"""SELECT part, CAST(rank AS INTEGER) AS rank, id AS label, CAST(1 AS BIGINT) AS n, greatest(total - 12, 0) AS more FROM (SELECT part, id, row_number() OVER (ORDER BY id) AS rank, count(*) OVER () AS total FROM ({_NEAR_ORDERS}) WHERE part = 'significant') WHERE rank <= 12
UNION ALL SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY n DESC, label) AS INTEGER), label, n, 0 FROM (SELECT part, CASE WHEN part = 'other' THEN type ELSE '' END AS label, count(*) AS n FROM ({_NEAR_ORDERS}) WHERE part <> 'significant' GROUP BY 1, 2)""",
        *O.search_sql("SELECT id FROM nodes WHERE type = 'SERVICE'", 1, "both"),
    )
)
def guard_rollup_of_services(spark, d):
    """What lies next to the services, rolled up as a report on a change."""
    g = graph(spark, d)
    near = traverse.search(g, g.nodes.where("type = 'SERVICE'").select("id"), 1, "both")
    return impact.guard_rollup(g, near.select("id"))


@query(f"WITH {_pairs_sql(50)}, files AS (SELECT DISTINCT file AS file_path FROM commits) SELECT file_path, coalesce(count, 0) AS co_changes FROM files LEFT JOIN (SELECT CASE WHEN file_a = 5 THEN file_b ELSE file_a END AS other, count FROM pairs WHERE file_a = 5 OR file_b = 5) ON other = file_path")
def impact_with_coupling(spark, d):
    every = commits(spark, d)
    return cochange.with_coupling(every.select(F.col("file").alias("file_path")).distinct(), cochange.pairs(cochange.recent(every)), 5)


@query("SELECT o_orderkey AS id, 'new' AS state FROM (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)) UNION ALL SELECT l_orderkey, 'removed' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def new_and_removed_ids(spark, d):
    indexed = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    new, removed = impact.new_and_removed(indexed, table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))
    return new.withColumn("state", F.lit("new")).unionAll(removed.withColumn("state", F.lit("removed")))


# --- upkeep ----------------------------------------------------------------------------------------------------------------------

_TEST_FILES = "file_path LIKE 'src/test/%'"


@query(O.with_graph(f"SELECT e.* FROM edges e ANTI JOIN (SELECT id FROM nodes WHERE {_TEST_FILES}) a ON e.source_id = a.id ANTI JOIN (SELECT id FROM nodes WHERE {_TEST_FILES}) b ON e.target_id = b.id"))
def edges_after_deleted_files(spark, d):
    """The nodes of all test files go, and their edges both ways."""
    g = graph(spark, d)
    gone = g.nodes.where(_TEST_FILES).select("file_path").distinct()
    return store.delete_files({"nodes": g.nodes, "edges": g.edges}, gone)["edges"]


@query(O.with_graph(f"SELECT e.* FROM edges e ANTI JOIN (SELECT id FROM nodes WHERE {_TEST_FILES}) a ON e.source_id = a.id"))
def edges_after_changed_files(spark, d):
    """Edges that start in test files go; those that end there stay."""
    g = graph(spark, d)
    return store.delete_edges_owned_by(g.nodes, g.edges, g.nodes.where(_TEST_FILES).select("file_path").distinct())


@query(O.with_graph("SELECT type, source_id, target_id FROM edges UNION SELECT 'USES', 'sales.C' || o_custkey, 'sales.orders.O' || o_orderkey FROM orders"))
def saved_edges(spark, d):
    more = table(spark, d, "orders").select(F.lit("USES").alias("type"), _name("sales.C", F.col("o_custkey")).alias("source_id"), _name("sales.orders.O", F.col("o_orderkey")).alias("target_id"))
    g = graph(spark, d)
    return store.save_edges(g.edges, more.unionAll(more).unionByName(g.edges.where("type = 'INJECTS'")))


@query(O.with_graph("SELECT id AS node_id FROM nodes WHERE type = 'CONTROLLER' AND file_path LIKE 'src/main/%'"))
def entry_points_of_files(spark, d):
    n = graph(spark, d).nodes
    return store.entry_points_in(n, n.where("type IN ('CONTROLLER')").select(F.col("id").alias("node_id")), n.where("file_path LIKE 'src/main/%'").select("file_path").distinct())


# --- call statistics -----------------------------------------------------------------------------------------------------------------


def _own_calls(spark, d):
    """Each line as a call on its own part; names m3 and getM have no method."""
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    name = F.when(F.col("s") % 5 == 4, "getM").otherwise(_name("m", F.col("s") % 5))
    return one.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("call"), _name("P", F.col("p")).alias("receiver"), name.alias("name"), (F.col("p") % 2).cast("int").alias("n"))


_OWN_CALLS = """lines AS (SELECT l_orderkey AS o, l_linenumber AS l, min(l_suppkey) % 5 AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
methods AS (SELECT DISTINCT l_partkey AS owner, l_suppkey % 3 AS name, l_linenumber % 2 AS k FROM lineitem), alike AS (SELECT owner, name, count(*) AS c FROM methods GROUP BY 1, 2),
marked AS (SELECT *, EXISTS (SELECT 1 FROM methods m JOIN alike a ON a.owner = m.owner AND a.name = m.name WHERE m.owner = lines.p AND m.name = lines.s AND (c = 1 OR k = lines.p % 2)) AS hit FROM lines)"""


@query(f"WITH {_OWN_CALLS} SELECT *, round(resolved / (seen - accessor_misses), 4) AS rate FROM (SELECT count(*) AS seen, count(*) FILTER (WHERE hit) AS resolved, count(*) FILTER (WHERE s = 4) AS accessor_misses FROM marked)")
def call_resolution(spark, d):
    calls, methods = _own_calls(spark, d), call_tables(spark, d)[1]
    return resolve.resolution_rate(calls, resolve.bind(calls, methods), methods)


@query(f"WITH {_OWN_CALLS} SELECT 'P' || p AS receiver, CASE WHEN s = 4 THEN 'getM' ELSE 'm' || s END AS name, CAST(p % 2 AS INTEGER) AS n, count(*) AS calls FROM marked WHERE NOT hit GROUP BY 1, 2, 3 ORDER BY calls DESC, receiver, name, n LIMIT 10")
def unresolved_calls(spark, d):
    calls = _own_calls(spark, d)
    return resolve.top_unresolved(calls, resolve.bind(calls, call_tables(spark, d)[1]))


# --- components of the whole graph ----------------------------------------------------------------------------------------------------

_WHOLE = [
    "both_ways AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)",
    "large(id) AS (SELECT min(id) FROM nodes WHERE type = 'SERVICE' UNION SELECT b FROM large JOIN both_ways ON id = a)",
    "rest AS MATERIALIZED (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM large))",
    "walked(id, root) AS (SELECT id, id FROM rest UNION SELECT b, root FROM walked JOIN both_ways ON walked.id = a)",
    "comp AS MATERIALIZED (SELECT id, min(root) AS root FROM walked WHERE id IN (SELECT id FROM rest) GROUP BY id UNION ALL SELECT id, (SELECT min(id) FROM large) FROM nodes WHERE id IN (SELECT id FROM large))",
]


@query(O.with_graph("SELECT root, count(*) AS size FROM comp GROUP BY root", *_WHOLE))
def component_sizes_whole(spark, d):
    """All nodes and edges: one component holds most nodes."""
    return traverse.components(graph(spark, d)).groupBy("root").agg(F.count("*").alias("size"))


@query(O.with_graph("SELECT reach, count(*) AS n FROM (SELECT size AS reach FROM comp JOIN (SELECT root, count(*) AS size FROM comp GROUP BY root) USING (root) JOIN nodes USING (id) WHERE type = 'AGGREGATE' AND NOT " + O.UNDER_TEST + ") GROUP BY reach HAVING count(*) >= 2 AND count(*) * 2 > (SELECT count(*) FROM nodes WHERE type = 'AGGREGATE' AND NOT " + O.UNDER_TEST + ")", *_WHOLE))
def common_reach_of_roots(spark, d):
    return traverse.common_reach(traverse.roots_with_reach(graph(spark, d)))
