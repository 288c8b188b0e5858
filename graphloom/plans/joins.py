"""Queries of name and call resolution, many-start search, contains joins and covers, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import contains, impact, resolve, traverse
from graphloom.plans import oracle as O
from graphloom.plans.queries import _SPANS, _spans, graph, query
from graphloom.sources.storage import stored, table

# --- chained calls: the lines of an order are a chain, each on the result of the one before ------------------------------------


def _name(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def call_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(calls, methods, supers, returns): parts are classes, the pairs of a part and a supplier their methods."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    first = F.col("l_linenumber") == 1
    at = lambda n: F.concat_ws("/", "l_orderkey", n)
    calls = one.select(at("l_linenumber").alias("call"), F.when(~first, at(F.col("l_linenumber") - 1)).alias("parent"), F.when(first, _name("P", F.col("p"))).alias("receiver"), _name("m", F.col("s") % 3).alias("name"), (F.col("p") % 2).cast("int").alias("n"))
    odd = F.coalesce(F.col("l_linenumber") % 2 == 1, F.lit(False))
    made = line.groupBy("l_partkey", (F.col("l_suppkey") % 3).alias("s"), odd.alias("odd")).agg(F.min("l_orderkey").alias("k"))
    each = made.select(_name("P", F.col("l_partkey")).alias("owner"), _name("m", F.col("s")).alias("name"), F.when(F.col("odd"), "(int)").otherwise("()").alias("_params"), "k")
    each = each.withColumn("id", F.concat("owner", F.lit("#"), "name", "_params"))
    each = stored(each, "methods")  # methods and what they return are read from one aggregation of the lines
    supers = part.where("p_partkey % 2 = 0 AND p_partkey > 0").select(_name("P", F.col("p_partkey")).alias("source_id"), _name("P", (F.col("p_partkey") / 2).cast("bigint")).alias("target_id"))
    return calls, each.select("id", "owner", "name"), supers, each.select(F.col("id").alias("method_id"), _name("P", F.col("k") % 199 + 1).alias("class_id"))


@query(
    """WITH RECURSIVE lines AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS l, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
methods AS MATERIALIZED (SELECT l_partkey AS owner, l_suppkey % 3 AS name, l_linenumber % 2 AS k, min(l_orderkey) % 199 + 1 AS class FROM lineitem GROUP BY 1, 2, 3),
alike AS MATERIALIZED (SELECT owner, name, count(*) AS c FROM methods GROUP BY 1, 2),
hits AS MATERIALIZED (SELECT m.owner, m.name, n, m.k, class FROM methods m JOIN alike USING (owner, name), (VALUES (0), (1)) v(n) WHERE c = 1 OR n = k),
types AS (SELECT p_partkey AS p FROM part UNION SELECT l_partkey FROM lineitem UNION SELECT class FROM methods),
up(p, w, d) AS (SELECT p, p, 0 FROM types UNION ALL SELECT up.p, w // 2, d + 1 FROM up JOIN part ON w = p_partkey WHERE w % 2 = 0 AND w > 0),
near AS MATERIALIZED (SELECT up.p, name, n, min(d) AS d FROM up JOIN hits ON w = owner GROUP BY 1, 2, 3),
bound AS MATERIALIZED (SELECT near.p, near.name, near.n, 'P' || owner || '#m' || hits.name || CASE k WHEN 1 THEN '(int)' ELSE '()' END AS method, class, count(*) OVER (PARTITION BY near.p, near.name, near.n) AS c
  FROM near JOIN up ON near.p = up.p AND near.d = up.d JOIN hits ON hits.owner = w AND hits.name = near.name AND hits.n = near.n),
chain(o, l, recv) AS (SELECT o, l, p FROM lines WHERE l = 1
  UNION ALL SELECT c.o, y.l, b.class FROM chain c JOIN lines x ON x.o = c.o AND x.l = c.l JOIN bound b ON b.p = recv AND b.name = x.s % 3 AND b.n = x.p % 2 AND b.c = 1 JOIN lines y ON y.o = c.o AND y.l = c.l + 1)
SELECT c.o || '/' || c.l AS call, method FROM chain c JOIN lines x ON x.o = c.o AND x.l = c.l JOIN bound b ON b.p = recv AND b.name = x.s % 3 AND b.n = x.p % 2"""
)
def chained_calls(spark, d):
    return resolve.bind_chains(*call_tables(spark, d))


@query(
    """WITH RECURSIVE lines AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS l, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
methods AS MATERIALIZED (SELECT l_partkey AS owner, l_suppkey % 3 AS name, l_linenumber % 2 AS k FROM lineitem GROUP BY 1, 2, 3),
alike AS (SELECT owner, name, count(*) AS c FROM methods GROUP BY 1, 2),
up(p, w, d) AS (SELECT p, p, 0 FROM (SELECT DISTINCT p FROM lines) UNION ALL SELECT up.p, w // 2, d + 1 FROM up JOIN part ON w = p_partkey WHERE w % 2 = 0 AND w > 0),
found AS (SELECT o, l, m.owner, m.name, m.k, d, min(d) OVER (PARTITION BY o, l) AS least FROM lines JOIN up USING (p) JOIN methods m ON w = m.owner AND m.name = s % 3 JOIN alike a ON a.owner = m.owner AND a.name = m.name WHERE c = 1 OR lines.p % 2 = m.k)
SELECT o || '/' || l AS call, 'P' || owner || '#m' || name || CASE k WHEN 1 THEN '(int)' ELSE '()' END AS method FROM found WHERE d = least"""
)
def calls_through_supertypes(spark, d):
    """Each line as a call on its own part."""
    _, methods, supers, _ = call_tables(spark, d)
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    calls = one.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("call"), _name("P", F.col("p")).alias("receiver"), _name("m", F.col("s") % 3).alias("name"), (F.col("p") % 2).cast("int").alias("n"))
    return resolve.bind_through_supertypes(calls, methods, supers)


@query(
    """WITH methods AS (SELECT DISTINCT l_partkey AS owner, l_suppkey % 3 AS name, l_linenumber % 2 AS k FROM lineitem)
SELECT 'OVERRIDES' AS type, 'P' || a.owner || '#m' || a.name || CASE a.k WHEN 1 THEN '(int)' ELSE '()' END AS source_id, 'P' || b.owner || '#m' || b.name || CASE b.k WHEN 1 THEN '(int)' ELSE '()' END AS target_id
FROM methods a JOIN part ON p_partkey = a.owner JOIN methods b ON b.owner = a.owner // 2 AND b.name = a.name AND b.k = a.k WHERE a.owner % 2 = 0 AND a.owner > 0"""
)
def method_overrides(spark, d):
    _, methods, supers, _ = call_tables(spark, d)
    return resolve.overrides(methods, supers)


# --- inherited member types: customers have two nations as supertypes, nations their region ------------------------------------


@query(
    """WITH member AS (SELECT DISTINCT 'geo.N' || s_nationkey || '.M' || (s_suppkey % 9) AS id FROM supplier UNION SELECT DISTINCT 'geo.R' || n_regionkey || '.M' || (c_custkey % 11) FROM customer JOIN nation ON c_nationkey = n_nationkey),
asked AS (SELECT DISTINCT o_custkey AS c, 'M' || (o_orderkey % 12) AS name FROM orders),
up1 AS (SELECT DISTINCT c, name, n FROM (SELECT c, name, unnest([c_nationkey, (c_nationkey + c_custkey) % 25]) AS n FROM asked JOIN customer ON c = c_custkey)),
hit1 AS (SELECT c, name, min(id) AS member, count(DISTINCT id) AS k FROM up1 JOIN member ON id = 'geo.N' || n || '.' || name GROUP BY 1, 2),
up2 AS (SELECT DISTINCT c, name, n_regionkey AS r FROM up1 JOIN nation ON n = n_nationkey WHERE (c, name) NOT IN (SELECT (c, name) FROM hit1)),
hit2 AS (SELECT c, name, min(id) AS member, count(DISTINCT id) AS k FROM up2 JOIN member ON id = 'geo.R' || r || '.' || name GROUP BY 1, 2)
SELECT 'sales.C' || c AS type, name, CASE WHEN k = 1 THEN member END AS member FROM (SELECT * FROM hit1 UNION ALL SELECT * FROM hit2)"""
)
def inherited_types(spark, d):
    """A null member is an ambiguous name."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    by_nation = table(spark, d, "supplier").select(F.concat(F.lit("geo.N"), "s_nationkey", F.lit(".M"), F.col("s_suppkey") % 9).alias("id"))
    by_region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("geo.R"), "n_regionkey", F.lit(".M"), F.col("c_custkey") % 11).alias("id"))
    nations = F.explode(F.array(F.col("c_nationkey").cast("bigint"), (F.col("c_nationkey") + F.col("c_custkey")) % 25))
    supers = customer.select(_name("sales.C", F.col("c_custkey")).alias("source_id"), nations.alias("n")).select("source_id", _name("geo.N", F.col("n")).alias("target_id"))
    supers = supers.unionAll(nation.select(_name("geo.N", F.col("n_nationkey")), _name("geo.R", F.col("n_regionkey"))))
    asked = table(spark, d, "orders").select(_name("sales.C", F.col("o_custkey")).alias("type"), _name("M", F.col("o_orderkey") % 12).alias("name"))
    return resolve.inherited_members(asked, supers, by_nation.unionAll(by_region))


# --- one search from many starts -------------------------------------------------------------------------------------------------


@query(
    O.with_graph(
        """SELECT start, id, 1 AS depth FROM (SELECT DISTINCT e.target_id AS start, e.source_id AS id FROM edges e JOIN nodes s ON e.target_id = s.id AND s.type = 'SERVICE' JOIN nodes n ON n.id = e.source_id WHERE e.type IN ('CALLS_METHOD', 'RETURNS_TYPE'))"""
    )
)
def callers_of_each_service(spark, d):
    """All services at once; only calls and returned types are followed, so that no method leads to its class."""
    g = graph(spark, d)
    services = g.nodes.where("type = 'SERVICE'").select(F.col("id").alias("start"), "id")
    return traverse.search_many(g, services, 1, "in", allowed_types=["CALLS_METHOD", "RETURNS_TYPE"])


@query(
    O.with_graph(
        """SELECT start, id, min(depth) AS depth FROM (
  SELECT e.source_id AS start, e.target_id AS id, 1 AS depth FROM edges e JOIN nodes s ON e.source_id = s.id WHERE s.type = 'CONTROLLER' AND e.type IN ('IMPLEMENTS', 'EXTENDS')
  UNION ALL SELECT a.source_id, b.target_id, 2 FROM edges a JOIN nodes s ON a.source_id = s.id JOIN edges b ON a.target_id = b.source_id WHERE s.type = 'CONTROLLER' AND a.type IN ('IMPLEMENTS', 'EXTENDS') AND b.type IN ('IMPLEMENTS', 'EXTENDS')) GROUP BY 1, 2"""
    )
)
def supertypes_of_each_controller(spark, d):
    g = graph(spark, d)
    return traverse.search_many(g, g.nodes.where("type = 'CONTROLLER'").select(F.col("id").alias("start"), "id"), 3, "out", allowed_types=["IMPLEMENTS", "EXTENDS"])


@query(
    O.with_graph(
        """SELECT DISTINCT start, id FROM (
  SELECT e.target_id AS start, e.source_id AS id FROM edges e JOIN nodes s ON e.target_id = s.id AND s.type = 'CONTROLLER' JOIN nodes n ON n.id = e.source_id AND n.type <> 'METHOD' WHERE e.type <> 'DECLARES_METHOD')"""
    )
)
def dependents_of_each_controller(spark, d):
    """Types that use a controller; controllers declare no methods here."""
    g = graph(spark, d)
    return impact.dependents_each(g, g.nodes.where("type = 'CONTROLLER'").select("id"), 1)


# --- contains joins ----------------------------------------------------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _passages(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))


@query("SELECT DISTINCT doc_id AS text_id, item_id AS needle_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages_in_documents(spark, d):
    return contains.containing(_documents(spark, d), _passages(spark, d))


@query("SELECT doc_id AS text_id, min(item_id) AS needle_id FROM documents d JOIN benchmark b ON contains(d.text, left(b.text, 9)) GROUP BY 1")
def least_opening_in_documents(spark, d):
    """The openings of passages, which are in many documents."""
    return contains.least_contained(_documents(spark, d), _passages(spark, d).withColumn("needle", F.left("needle", F.lit(9))))


@query("SELECT DISTINCT page_id AS text_id, item_id AS needle_id FROM pages JOIN (SELECT item_id, regexp_extract(text, '^[A-Za-z]+') AS name FROM benchmark) ON contains(html, '/' || lower(name))")
def api_calls_of_pages(spark, d):
    """Pages as services, and the first words of passages as the names of controllers."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code_snippet"))
    controllers = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit("Controller")).alias("name"))
    return contains.api_calls(pages, controllers)


# --- hunks against the union of spans ----------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SPANS}, hunks AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_orderkey % 50 AS INTEGER) AS x, CAST(o_orderkey % 50 + o_custkey % 4 AS INTEGER) AS y FROM orders),
lines AS (SELECT path, x, y, unnest(range(x + 1, y + 1)) AS line FROM hunks WHERE y > x),
bare AS (SELECT DISTINCT path, x, y FROM lines l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = l.path AND l.line BETWEEN b AND e)),
gaps AS (SELECT DISTINCT h.path, x, y FROM hunks h JOIN spans s ON s.path = h.path AND x = y AND x >= b AND x + 1 <= e)
SELECT h.path, h.x AS begin_b, h.y AS end_b, CASE WHEN h.y > h.x THEN b.path IS NULL ELSE g.path IS NOT NULL END AS covered
FROM hunks h LEFT JOIN bare b ON h.path = b.path AND h.x = b.x AND h.y = b.y LEFT JOIN gaps g ON h.path = g.path AND h.x = g.x AND h.y = g.y"""
)
def hunks_covered(spark, d):
    return impact.covered_hunks(*_spans(spark, d))
