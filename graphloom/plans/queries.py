"""The engine's operators as named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids, paths
from graphloom.functions import text as T
from graphloom.operators import cochange, dead, degree, export, impact, incremental, packages, rank, search, traverse
from graphloom.operators.graph import CodeGraph
from graphloom.plans import oracle as O
from graphloom.sources import star
from graphloom.sources.storage import stored, table
from graphloom.streaming.sync import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed points of the star graph that exist at every scale.
ORDER, CUSTOMER = "sales.orders.O8", "sales.C3"
SUPPLIER = "type = 'SERVICE' AND name = 'S0'"


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def graph(spark: SparkSession, d: str) -> CodeGraph:
    return CodeGraph(*star.graph(spark, d))


def view(spark: SparkSession, d: str) -> CodeGraph:
    """The graph for searches, its ids as numbers."""
    return CodeGraph(*star.view(spark, d))


def starts(g: CodeGraph, condition: str) -> DataFrame:
    """The nodes of a ``view`` that meet a condition, in which ``id`` is the text."""
    return g.nodes.withColumns({"_code": F.col("id"), "id": F.col("qualified_name")}).where(condition).select(F.col("_code").alias("id"))


def named(g: CodeGraph, found: DataFrame) -> DataFrame:
    """What was found in a ``view``, by the ids as texts; the semi-join comes first, so that only what was found gets them."""
    found = stored(found, "found")
    kept = g.nodes.select("id", "qualified_name").join(found.select("id"), "id", "left_semi").distinct()
    return kept.join(found, "id").drop("id").withColumnRenamed("qualified_name", "id")


def sales(spark: SparkSession, d: str) -> CodeGraph:
    return CodeGraph(*star.sales(spark, d))


# --- scans, counts and degrees -------------------------------------------------


@query(O.with_graph("SELECT count(*) AS node_count, count(DISTINCT CASE WHEN file_path <> '' THEN file_path END) AS file_count, (SELECT count(*) FROM edges) AS edge_count FROM nodes"))
def graph_counts(spark, d):
    return graph(spark, d).counts()


@query(O.with_graph("SELECT type, count(*) AS n FROM nodes GROUP BY type"))
def node_type_histogram(spark, d):
    return graph(spark, d).type_histogram()


@query(O.with_graph("SELECT id, type, name, file_path FROM nodes WHERE type = 'SERVICE'"))
def nodes_by_type(spark, d):
    return graph(spark, d).nodes_where(type="SERVICE").select("id", "type", "name", "file_path")


@query(O.with_graph(f"SELECT type, source_id, target_id FROM edges WHERE target_id = '{CUSTOMER}' OR source_id = '{CUSTOMER}'"))
def edges_of_node(spark, d):
    g = graph(spark, d)
    return g.edges_to(CUSTOMER).unionByName(g.edges_from(CUSTOMER))


def _fan_sql(end: str, where: str = "", limit: str = "LIMIT 10") -> str:
    return O.with_graph(f"SELECT n.id, n.type, count(*) AS n FROM nodes n JOIN edges e ON e.{end} = n.id WHERE n.type <> 'LIBRARY' {where} GROUP BY n.id, n.type ORDER BY n DESC, n.id {limit}")


@query(_fan_sql("target_id"))
def hotspots_fan_in(spark, d):
    return degree.fan(graph(spark, d), "in")


@query(_fan_sql("source_id"))
def hotspots_fan_out(spark, d):
    return degree.fan(graph(spark, d), "out")


@query(_fan_sql("source_id", "AND n.type <> 'METHOD'"))
def hotspots_fan_out_types(spark, d):
    return degree.fan(graph(spark, d), "out", types_only=True)


@query(_fan_sql("target_id", "AND starts_with(lower(n.qualified_name), 'catalog.brand4.')"))
def hotspots_in_package(spark, d):
    return degree.fan(graph(spark, d), "in", package="catalog.Brand4")


@query(_fan_sql("target_id", limit=""))
def fan_in_all(spark, d):
    return degree.fan(graph(spark, d), "in", limit=None)


@query(
    O.with_graph(
        f"""SELECT edge_type, sum(n) AS total, sum(t) AS in_tests, array_to_string(list_sort(list(label || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END))[1:8], ', ') AS labels FROM (
  SELECT e.type AS edge_type, CASE WHEN contains(e.source_id, '#') THEN regexp_extract(e.source_id, '([^.]*)$', 1) ELSE regexp_extract(e.source_id, '([^.]*)$', 1) END AS label, count(*) AS n, sum(CASE WHEN {O.UNDER_TEST} THEN 1 ELSE 0 END) AS t
  FROM edges e LEFT JOIN nodes n ON e.source_id = n.id WHERE e.target_id = '{CUSTOMER}' GROUP BY 1, 2) GROUP BY edge_type"""
    )
)
def neighbour_summary_in(spark, d):
    return degree.neighbour_summary(graph(spark, d), CUSTOMER, "in")


DEPENDENCIES = [(0, "catalog", "small ring", "1.0"), (1, "catalog", "red widget", "2.1"), (2, "absent", "nothing", "0")]
_DEPS = ", ".join(f"({o}, '{g}', '{a}', '{v}')" for o, g, a, v in DEPENDENCIES)


@query(
    O.with_graph(
        f"""SELECT d.ord, g || ':' || a AS coordinate, v AS version, coalesce(n, 0) AS used_types FROM (VALUES {_DEPS}) d(ord, g, a, v)
LEFT JOIN (SELECT 'catalog:' || p_name AS c, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY 1) u ON u.c = g || ':' || a"""
    )
)
def deps_usage(spark, d):
    g = graph(spark, d)
    named = g.nodes.withColumn("code_snippet", F.concat(F.lit("catalog:"), F.regexp_extract("code_snippet", "^(.*) Brand#", 1)))
    declared = spark.createDataFrame(DEPENDENCIES, "ord int, group_id string, artifact string, version string")
    return degree.library_usage(CodeGraph(named, g.edges), declared)


# --- dead code -----------------------------------------------------------------


@query(O.with_graph("SELECT id, type FROM bare WHERE type NOT IN ('CONFIGURATION', 'ENTITY', 'ENUM', 'RECORD', 'FE_MODEL')", O.BARE))
def dead_nodes(spark, d):
    return dead.unreferenced(graph(spark, d))


@query(O.with_graph("SELECT id, type FROM tested", O.TESTED))
def used_only_by_tests(spark, d):
    return dead.used_only_by_tests(graph(spark, d)).select("id", "type")


@query(O.with_graph("SELECT DISTINCT id FROM live", O.LIVE))
def live_supertypes(spark, d):
    return dead.live_subtypes(graph(spark, d)).distinct()


@query(O.with_graph("SELECT id, type, tier FROM candidates", O.CANDIDATES))
def dead_candidates(spark, d):
    return dead.candidates(graph(spark, d))


@query(O.with_graph("SELECT CAST(list_position(['HIGH', 'MEDIUM', 'LOW', 'USED_ONLY_BY_TESTS', 'TEST_SOURCE'], tier) AS INTEGER) AS tier_order, tier, type, count(*) AS n FROM candidates GROUP BY tier, type", O.CANDIDATES))
def dead_tier_summary(spark, d):
    return dead.tier_summary(dead.candidates(graph(spark, d)))


# --- packages ------------------------------------------------------------------


@query(O.with_graph("SELECT source_package, target_package, n FROM pedges", O.PACKAGES))
def package_edges(spark, d):
    g = graph(spark, d)
    return packages.package_edges(g, packages.with_package(g))


@query(
    O.with_graph(
        """SELECT s.package, s.nodes, coalesce(o.k, 0) AS out_packages, coalesce(o.n, 0) AS out_edges, coalesce(i.k, 0) AS in_packages, coalesce(i.n, 0) AS in_edges
FROM (SELECT package, count(*) AS nodes FROM packages GROUP BY 1) s LEFT JOIN (SELECT source_package AS package, count(*) AS k, sum(n) AS n FROM pedges GROUP BY 1) o ON s.package = o.package
LEFT JOIN (SELECT target_package AS package, count(*) AS k, sum(n) AS n FROM pedges GROUP BY 1) i ON s.package = i.package""",
        O.PACKAGES,
    )
)
def package_summary(spark, d):
    g = graph(spark, d)
    p = packages.with_package(g)
    return packages.package_summary(p, packages.package_edges(g, p))


@query(O.with_graph("SELECT a.source_package AS lo, a.target_package AS hi, a.n AS forward, b.n AS backward FROM pedges a JOIN pedges b ON a.source_package = b.target_package AND a.target_package = b.source_package WHERE a.source_package < a.target_package", O.PACKAGES))
def package_cycles(spark, d):
    g = graph(spark, d)
    return packages.two_cycles(packages.package_edges(g, packages.with_package(g)))


@query(
    O.with_graph(
        f"""SELECT id, type, n FROM (SELECT n.id, n.type, n.file_path, count(*) AS n FROM nodes n JOIN edges e ON e.source_id = n.id WHERE n.type NOT IN ('LIBRARY', 'METHOD') AND starts_with(lower(n.qualified_name), 'sales.orders.')
GROUP BY n.id, n.type, n.file_path ORDER BY n DESC, n.id LIMIT 40) WHERE NOT {O.TEST_P1} ORDER BY n DESC, id LIMIT 3"""
    )
)
def top_types_in_package(spark, d):
    return packages.top_types(graph(spark, d), "sales.orders")


# --- co-change -----------------------------------------------------------------

_COMMITS = "commits AS (SELECT l_orderkey AS commit, o_orderdate AS seq, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_NEWEST = "newest AS (SELECT DISTINCT commit, seq FROM commits ORDER BY seq DESC, commit DESC LIMIT 500)"


def _pairs_sql(most: int, newest: bool = True) -> str:
    kept = "WHERE commit IN (SELECT commit FROM newest)" if newest else ""
    return f"""{_COMMITS}, {_NEWEST}, f AS (SELECT DISTINCT commit, file FROM commits {kept}), sized AS (SELECT commit FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND {most}), k AS (SELECT * FROM f WHERE commit IN (SELECT commit FROM sized)),
pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM k a JOIN k b ON a.commit = b.commit AND a.file < b.file GROUP BY 1, 2)"""


def commits(spark, d) -> DataFrame:
    line, order = table(spark, d, "lineitem"), table(spark, d, "orders")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("commit"), F.col("o_orderdate").alias("seq"), F.col("l_partkey").alias("file"))


@query(f"WITH {_pairs_sql(50)} SELECT * FROM pairs")
def co_change_pairs(spark, d):
    return cochange.pairs(cochange.recent(commits(spark, d)))


@query(f"WITH {_pairs_sql(4, False)} SELECT * FROM pairs")
def co_change_pairs_low_cap(spark, d):
    return cochange.pairs(commits(spark, d), most_files=4)


@query(f"WITH {_COMMITS} SELECT count(*) AS skipped FROM (SELECT commit FROM commits GROUP BY 1 HAVING count(DISTINCT file) > 4)")
def co_change_skipped(spark, d):
    return cochange.skipped_bulk_commits(commits(spark, d), 4)


@query(
    f"WITH {_pairs_sql(50)}, both_ways AS (SELECT file_a AS file, file_b AS other_file, count FROM pairs UNION ALL SELECT file_b, file_a, count FROM pairs) SELECT file, other_file, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY count DESC, other_file) AS INTEGER) AS rank FROM both_ways) WHERE rank <= 3"
)
def top_coupled(spark, d):
    return cochange.top_coupled_each(cochange.pairs(cochange.recent(commits(spark, d))), 3)


@query(f"WITH {_pairs_sql(50)} SELECT CASE WHEN file_a = 5 THEN file_b ELSE file_a END AS other_file, count FROM pairs WHERE file_a = 5 OR file_b = 5 ORDER BY count DESC, other_file LIMIT 10")
def top_coupled_of_file(spark, d):
    return cochange.top_coupled(cochange.pairs(cochange.recent(commits(spark, d))), 5)


# --- traversal -----------------------------------------------------------------


def _reach(name: str, start: str, depth: int, direction: str, leaf: bool = False):
    sql = O.with_graph("SELECT id, depth FROM reached", *O.search_sql(f"SELECT id FROM nodes WHERE {start}", depth, direction, leaf))

    @query(sql, name)
    def run(spark, d):
        g = view(spark, d)
        found = traverse.search(g, starts(g, start), depth, direction, leaf)
        return named(g, found).select("id", "depth")

    return run


for _d in (1, 2, 3):
    _reach(f"callers_d{_d}", SUPPLIER, _d, "in")
    _reach(f"callees_d{_d}", f"id = '{ORDER}'", _d, "out")
for _d in (0, 1, 2):
    _reach(f"impact_d{_d}", f"id = '{ORDER}'", _d, "both")
_reach("related_libleaf", f"id = '{ORDER}'", 2, "both", True)


@query(
    O.with_graph(
        "SELECT root, count(*) AS size FROM comp GROUP BY root",
        """se AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges WHERE type IN ('DECLARES_METHOD', 'INJECTS') AND starts_with(source_id, 'sales.orders.')),
sn AS MATERIALIZED (SELECT id FROM nodes WHERE type IN ('AGGREGATE', 'METHOD', 'CONTROLLER')), sb AS MATERIALIZED (SELECT a, b FROM se UNION SELECT b, a FROM se),
walked(id, root) AS (SELECT id, id FROM sn UNION SELECT b, root FROM walked JOIN sb ON walked.id = a), comp AS (SELECT id, min(root) AS root FROM walked GROUP BY id)""",
    )
)
def component_sizes(spark, d):
    return traverse.components(sales(spark, d)).groupBy("root").agg(F.count("*").alias("size"))


@query(
    O.with_graph(
        f"SELECT id FROM walked",
        f"""se AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges WHERE type IN ('DECLARES_METHOD', 'INJECTS') AND starts_with(source_id, 'sales.orders.')),
sb AS MATERIALIZED (SELECT a, b FROM se UNION SELECT b, a FROM se), walked(id) AS (SELECT '{ORDER}' UNION SELECT b FROM walked JOIN sb ON walked.id = a)""",
    )
)
def trace_chain(spark, d):
    return traverse.trace_chain(sales(spark, d), ORDER)


@query(
    O.with_graph(
        "SELECT type, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)",
        *O.search_sql(f"SELECT '{ORDER}' AS id", 1, "both"), f"kept AS (SELECT id FROM reached UNION SELECT '{ORDER}')",
    )
)
def induced_edges(spark, d):
    g = graph(spark, d)
    found = traverse.impact(g, ORDER, 1).select("id").unionAll(spark.createDataFrame([(ORDER,)], "id string"))
    return g.induced_edges(found)


@query(
    O.with_graph(
        f"SELECT id FROM nodes WHERE id IN (SELECT id FROM reached) AND id <> '{CUSTOMER}' AND type <> 'METHOD'",
        *O.search_sql(f"SELECT '{CUSTOMER}' AS id", 2, "in"),
    )
)
def guard_dependents(spark, d):
    return impact.dependents(graph(spark, d), CUSTOMER, 2)


@query(
    O.with_graph(
        f"SELECT CASE WHEN {O.GUARD_TEST} THEN 'test' ELSE 'production' END AS side, type, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM reached) AND type <> 'METHOD' GROUP BY 1, 2",
        *O.search_sql(f"SELECT '{CUSTOMER}' AS id", 2, "in"),
    )
)
def guard_summary(spark, d):
    g = graph(spark, d)
    return impact.guard_summary(g, impact.dependents(g, CUSTOMER, 2))


_CHANGED = "SELECT id FROM nodes WHERE type = 'SERVICE'"


@query(
    O.with_graph(
        "SELECT id FROM reached UNION SELECT id FROM nodes WHERE id IN (SELECT split_part(id, '#', 1) FROM reached WHERE contains(id, '#')) AND id NOT IN (SELECT id FROM starts)",
        *O.search_sql(_CHANGED, 1, "in"),
    )
)
def dependents_of_change(spark, d):
    g = graph(spark, d)
    return impact.dependents_of_change(g, g.nodes.where("type = 'SERVICE'").select("id"), 1)


@query(
    O.with_graph(
        """SELECT id, type, degree, array_to_string(others, ',') AS others, n > 5 AS more FROM (
  SELECT list(id ORDER BY k)[1] AS id, list(type ORDER BY k)[1] AS type, list(degree ORDER BY k)[1] AS degree, list(id ORDER BY k)[2:5] AS others, count(*) AS n FROM (
  SELECT n.id, n.type, coalesce(g.n, 0) AS degree, row_number() OVER (ORDER BY n.type = 'METHOD', coalesce(g.n, 0) DESC, n.id) AS k FROM nodes n
  LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) g ON n.id = g.id
  WHERE lower(n.name) = 's1' OR lower(n.qualified_name) = 's1' OR lower(n.id) = 's1' OR ends_with(lower(n.id), '.s1')))"""
    )
)
def resolve_symbol(spark, d):
    return graph(spark, d).resolve("s1")


@query(O.with_graph("SELECT id, type, name, file_path FROM nodes WHERE type = 'METHOD' AND name = 'L1' AND starts_with(id, 'sales.orders.O24#')"))
def resolve_method(spark, d):
    return graph(spark, d).resolve_method("O24", "l1", "")


# --- export --------------------------------------------------------------------

def _export_graph(spark, d):
    g = graph(spark, d)
    return packages.with_package(g, "name"), g.edges


_M = "regexp_replace({c}, '[^a-zA-Z0-9]', '_', 'g')"
_KEPT = "kept AS (SELECT * FROM nodes), inner_edges AS (SELECT e.* FROM edges e SEMI JOIN nodes s ON e.source_id = s.id SEMI JOIN nodes t ON e.target_id = t.id)"


@query(
    O.with_graph(
        """SELECT 'node' AS part, '{"id":"' || id || '","type":"' || type || '","name":"' || name || '","qualifiedName":"' || qualified_name || '","filePath":"' || file_path || '"}' AS line FROM nodes
UNION ALL SELECT 'edge', '{"type":"' || type || '","source":"' || source_id || '","target":"' || target_id || '"}' FROM edges"""
    )
)
def export_json_rows(spark, d):
    g = graph(spark, d)
    return export.json_rows(g.nodes, g.edges)


@query(
    O.with_graph(
        f"""SELECT 1 AS section, package, '    ' || {_M.format(c='k.id')} || '["' || k.name || '<br/>' || k.type || '"]' AS line FROM kept k JOIN packages p ON k.id = p.id
UNION ALL SELECT 2, '', '  ' || {_M.format(c='source_id')} || ' -->|' || type || '| ' || {_M.format(c='target_id')} FROM inner_edges
UNION ALL SELECT 3, '', '  class ' || {_M.format(c='id')} || ' ' || CASE type WHEN 'CONTROLLER' THEN 'controller' WHEN 'SERVICE' THEN 'service' WHEN 'REPOSITORY' THEN 'data' WHEN 'AGGREGATE' THEN 'domain' ELSE 'other' END FROM kept""",
        O.PACKAGES, _KEPT,
    )
)
def mermaid_rows(spark, d):
    return export.mermaid_rows(*_export_graph(spark, d))


@query(
    O.with_graph(
        f"""SELECT 1 AS section, package, '  [' || k.name || '] as ' || {_M.format(c='k.id')} || ' <<' || k.type || '>>' AS line FROM kept k JOIN packages p ON k.id = p.id
UNION ALL SELECT 2, '', {_M.format(c='source_id')} || ' --> ' || {_M.format(c='target_id')} || ' : ' || type FROM inner_edges""",
        O.PACKAGES, _KEPT,
    )
)
def plantuml_rows(spark, d):
    return export.plantuml_rows(*_export_graph(spark, d))


@query(O.with_graph("SELECT id FROM (SELECT id, sum(length(id) + 1) OVER (ORDER BY id) AS used FROM (SELECT id FROM nodes ORDER BY id)) WHERE used <= 6000"))
def reply_within_budget(spark, d):
    return export.fitting(graph(spark, d).nodes.select("id"), ["id"], "id")


# --- search --------------------------------------------------------------------

_SEARCHED = ["name", "qualified_name", "code_snippet"]


def _fts(name: str, text: str):
    @query(O.with_graph(f"SELECT id FROM nodes WHERE {O.fts_sql(_SEARCHED, text)}"), name)
    def run(spark, d):
        return star.text_index(spark, d).search(text)


_fts("fts_prefix", "wid")
_fts("fts_and", "brand promo")
_fts("fts_phrase", "red-widget brand")


@query(f"SELECT DISTINCT doc_id AS id FROM documents WHERE {O.fts_sql(['text'], 'FÜR fur-der')} ")
def fts_accents(spark, d):
    """Words with and without accents are one."""
    return star.document_index(spark, d).search("FÜR fur-der")


@query(f"SELECT DISTINCT doc_id AS id FROM documents WHERE {O.fts_sql(['text'], 'the-and in')}")
def fts_phrase_documents(spark, d):
    return star.document_index(spark, d).search("the-and in")


@query(
    O.with_graph(
        f"""SELECT id FROM (SELECT id, name, qualified_name, CASE WHEN type = 'SERVICE' THEN 'Größe ' || code_snippet ELSE code_snippet END AS code_snippet FROM nodes WHERE type <> 'AGGREGATE')
WHERE {O.fts_sql(_SEARCHED, 'grosse')} OR {O.fts_sql(_SEARCHED, 'große')} OR {O.fts_sql(_SEARCHED, 'supplier')} OR {O.fts_sql(_SEARCHED, 'o1')}"""
    )
)
def fts_after_changes(spark, d):
    """The index after an upsert of all services and the deletion of all orders."""
    nodes = graph(spark, d).nodes
    services = nodes.where("type = 'SERVICE'").withColumn("code_snippet", F.concat(F.lit("Größe "), "code_snippet"))
    index = star.text_index(spark, d).upsert(services).delete(nodes.where("type = 'AGGREGATE'").select("id"))
    return index.search("grosse").unionAll(index.search("große")).unionAll(index.search("supplier")).unionAll(index.search("o1")).distinct()


@query(f"SELECT doc_id FROM documents WHERE {O.fts_sql(['text'], 'the anan')}")
def fts_documents(spark, d):
    return search.full_text(table(spark, d, "documents"), "the anan", ("text",)).select("doc_id")


@query(O.with_graph("SELECT id FROM nodes WHERE name ILIKE '%s1_%' OR qualified_name ILIKE '%s1_%'"))
def like_search(spark, d):
    return search.like(graph(spark, d).nodes, "s1_").select("id")


@query(
    O.with_graph(
        f"""SELECT CAST(row_number() OVER (ORDER BY lower(name) <> 's1', NOT fts, id) AS INTEGER) AS rank, id, type, name FROM (SELECT *, ({O.fts_sql(_SEARCHED, 's1')}) AS fts FROM nodes
WHERE ({O.fts_sql(_SEARCHED, 's1')}) OR name ILIKE '%s1%' OR qualified_name ILIKE '%s1%') ORDER BY rank LIMIT 10"""
    )
)
def union_search(spark, d):
    return search.symbols(graph(spark, d).nodes, "s1")


@query(O.with_graph("SELECT file_path, count(*) AS symbols FROM nodes WHERE file_path <> '' AND contains(lower(file_path), 'supply/s1') GROUP BY 1 ORDER BY 1 LIMIT 10"))
def file_search(spark, d):
    return search.files(graph(spark, d).nodes, "Supply/S1")


@query(f"WITH {O.KEYWORDS} SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word FROM kw GROUP BY doc_id")
def keywords(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(T.keywords("text")).alias("word"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


@query(f"WITH {O.KEYWORDS}, w AS (SELECT DISTINCT word FROM kw), s AS (SELECT word, {O.stem_sql('word')} AS s FROM w) SELECT word, {O.undoubled_sql('s', 'word')} AS stem FROM s")
def stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.keywords("text")).alias("word")).distinct()
    return words.select("word", T.stem("word").alias("stem"))


TASK = "Fix the red widgets and gadgets of building customers"
_TASK_WORDS = [("red", "red"), ("widgets", "widget"), ("gadgets", "gadget"), ("building", "build"), ("customers", "custom")]


def _hits(terms: list[str]) -> str:
    every = " || ' ' || ".join(f"' ' || array_to_string({O.tokens_sql(c)}, ' ')" for c in _SEARCHED)
    return " + ".join(f"CAST((contains({every}, ' {t}') OR name ILIKE '%{t}%' OR qualified_name ILIKE '%{t}%') AS INTEGER)" for t in terms)


_SEEDS = f"SELECT id, type, file_path, {_hits([s for _, s in _TASK_WORDS])} AS keywords_matched, {_hits([w for w, _ in _TASK_WORDS])} AS typed_matched FROM nodes"


@query(O.with_graph(f"SELECT id, keywords_matched, typed_matched FROM ({_SEEDS}) WHERE keywords_matched > 0"))
def seed_counts(spark, d):
    return star.text_index(spark, d).seeds(TASK)


@query(O.with_graph("SELECT n.id, round(coalesce(r.r, 0), 6) AS score FROM nodes n LEFT JOIN r20 r ON n.id = r.id", f"walk AS (SELECT * FROM edges), seeds AS (SELECT id, CAST(1 AS DOUBLE) AS mass FROM nodes WHERE id IN ('{ORDER}', '{CUSTOMER}'))", *O.ppr_sql()))
def ppr_20(spark, d):
    walk = star.walk(spark, d)
    g = CodeGraph(*walk) if walk else graph(spark, d)
    seeds = (starts(g, f"id IN ('{ORDER}', '{CUSTOMER}')") if walk else g.nodes.where(F.col("id").isin(ORDER, CUSTOMER)).select("id")).withColumn("mass", F.lit(1.0))
    scores = rank.pagerank(g.nodes, g.edges, seeds, near=star.LINES)
    return (star.with_ids(spark, d, scores) if walk else scores).select("id", F.round("score", 6).alias("score"))


@query(
    O.with_graph(
        """SELECT id, type, file_path, keywords_matched, typed_matched, score FROM ordered WHERE file_path IN (SELECT file_path FROM (SELECT file_path, min(k) AS k FROM ordered GROUP BY 1 ORDER BY k LIMIT 10))""",
        f"own AS MATERIALIZED (SELECT *, CASE WHEN type = 'METHOD' THEN split_part(id, '#', 1) ELSE id END AS owner FROM ({_SEEDS}) WHERE type <> 'LIBRARY' AND NOT {O.UNDER_TEST})",
        "walk AS MATERIALIZED (SELECT a.owner AS source_id, b.owner AS target_id FROM edges e JOIN own a ON e.source_id = a.id JOIN own b ON e.target_id = b.id)",
        "seeds AS (SELECT owner AS id, CAST(sum(keywords_matched) AS DOUBLE) AS mass FROM own WHERE keywords_matched > 0 GROUP BY 1)",
        *O.ppr_sql(),
        """scored AS (SELECT own.id, type, file_path, keywords_matched, typed_matched, round(coalesce(r, 0), 6) AS score FROM own LEFT JOIN r20 ON owner = r20.id),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY keywords_matched DESC, typed_matched DESC, score DESC, id) AS k FROM scored WHERE keywords_matched > 0 OR (type <> 'METHOD' AND score > 0))""",
    )
)
def context_files(spark, d):
    walk = star.walk(spark, d)
    if walk is None:
        return search.context(graph(spark, d), TASK)
    return search.context(CodeGraph(*walk), TASK, owner_of=star.order_of, calls="CALLS_METHOD", shown="qualified_name", near=star.LINES)


@query(
    """SELECT page_id, url, directory, coalesce(directory IS DISTINCT FROM lag(directory) OVER w, true) AS starts_run FROM (SELECT page_id, url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, page_id % 7 AS part FROM pages) WINDOW w AS (PARTITION BY part ORDER BY page_id)"""
)
def directory_runs(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 7).alias("part"))
    return search.directory_runs(pages, "page_id", "url", "part").select("page_id", "url", "directory", "starts_run")


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations) WHERE k = 1")
def first_turn_per_role(spark, d):
    return search.first_per_key(table(spark, d, "conversations"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", "text")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


# --- freshness, cost, spans ----------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS file_path, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def file_checksums(spark, d):
    return incremental.checksums(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content")))


def _scan(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("doc_id").alias("k"), "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    tracked = docs.where("k % 5 <> 0").select("file_path", F.lit(0).cast("bigint").alias("last_modified"), "checksum")
    now = docs.where("k % 7 <> 0").select("file_path", F.when(F.col("k") % 3 == 0, 1).otherwise(0).cast("bigint").alias("last_modified"), F.when(F.col("k") % 9 == 0, "changed").otherwise(F.col("checksum")).alias("checksum"))
    return now, tracked


@query(
    """SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'same' END AS state
FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file_path FROM documents) WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0"""
)
def changed_files_classify(spark, d):
    return incremental.classify(*_scan(spark, d))


@query("SELECT lang, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents GROUP BY lang")
def token_cost(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(T.token_estimate("text")).alias("tokens"))


@query("SELECT source, sum(length(text)) AS without_tool, sum(length(left(text, 200))) AS with_tool, round((1 - sum(length(left(text, 200))) / CAST(sum(length(text)) AS DOUBLE)) * 1000) / 10 AS saved FROM documents GROUP BY source")
def savings_pct(spark, d):
    sums = table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("without_tool"), F.sum(F.length(F.left("text", F.lit(200)))).alias("with_tool"))
    return sums.withColumn("saved", T.saved_percent(F.col("without_tool"), F.col("with_tool").cast("double")))


def _spans(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), (F.col("l_linenumber") * 10).alias("begin"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 25).cast("int").alias("end")).distinct()
    hunks = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 50).cast("int").alias("begin_b"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 4).cast("int").alias("end_b"))
    return hunks, line


_SPANS = "spans AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, l_orderkey || '#' || l_linenumber || '#' || l_partkey AS id, l_linenumber * 10 AS b, CAST(l_linenumber * 10 + l_partkey % 25 AS INTEGER) AS e FROM lineitem)"


@query(
    f"""WITH {_SPANS}, hunks AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 50 AS x, o_orderkey % 50 + o_custkey % 4 AS y FROM orders)
SELECT DISTINCT id, hunks.path FROM hunks JOIN spans ON hunks.path = spans.path WHERE (y > x AND x + 1 <= e AND y >= b) OR (y = x AND x >= b AND x + 1 <= e)"""
)
def hunks_to_spans(spark, d):
    return impact.changed_spans(*_spans(spark, d))


@query(
    f"""WITH {_SPANS}, lines AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_orderkey % 80 AS INTEGER) AS line FROM orders)
SELECT path, line, id FROM (SELECT lines.path, line, id, row_number() OVER (PARTITION BY lines.path, line ORDER BY e - b, b DESC, id) AS k FROM lines JOIN spans ON lines.path = spans.path AND line BETWEEN b AND e) WHERE k = 1"""
)
def innermost_span(spark, d):
    lines = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 80).cast("int").alias("line"))
    return impact.innermost(lines, _spans(spark, d)[1])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- identities ----------------------------------------------------------------


@query(
    O.with_graph(
        """SELECT id, split_part(id, '#', 1) AS owner, regexp_extract(id, '#([^(]*)', 1) AS method, CAST(CASE WHEN contains(id, '(') THEN CASE WHEN regexp_extract(id, '\\((.*)\\)', 1) = '' THEN 0 ELSE 1 END ELSE -1 END AS INTEGER) AS arity,
regexp_replace(id, '[^a-zA-Z0-9]', '_', 'g') AS mermaid, regexp_extract(id, '([^.]*)$', 1) AS label FROM nodes"""
    )
)
def identities(spark, d):
    n = graph(spark, d).nodes
    return n.select("id", ids.declaring_class("id").alias("owner"), ids.method_name("id").alias("method"), ids.arity("id").alias("arity"), ids.mermaid_id("id").alias("mermaid"), ids.short_label("id").alias("label"))


@query(
    O.with_graph(
        f"SELECT id, {O.TEST_P1} AS p1, NOT {O.PRODUCTION} AS p2, {O.UNDER_TEST} AS p3, {O.GUARD_TEST} AS p4 FROM nodes"
    )
)
def test_sources(spark, d):
    p = "file_path"
    return graph(spark, d).nodes.select("id", paths.is_test_source(p).alias("p1"), (~paths.is_production_sql(p)).alias("p2"), paths.is_under_test_dir(p).alias("p3"), paths.is_guard_test(p).alias("p4"))
