"""The named queries in DuckDB SQL."""

from __future__ import annotations

from graphloom.functions.text import STOP_WORDS, SUFFIXES

GRAPH = """
least AS (SELECT min(c_mktsegment) AS m FROM customer),
nodes AS MATERIALIZED (
  SELECT id, type, name, id AS qualified_name, file_path, 1 AS line_number, code_snippet, CAST(0 AS BIGINT) AS last_modified FROM (
  SELECT 'geo.R' || r_regionkey AS id, 'INTERFACE' AS type, 'R' || r_regionkey AS name, 'src/main/geo/R' || r_regionkey || '.java' AS file_path, r_name AS code_snippet FROM region
  UNION ALL SELECT 'geo.N' || n_nationkey, 'CLASS', 'N' || n_nationkey, 'src/main/geo/N' || n_nationkey || '.java', n_name FROM nation
  UNION ALL SELECT 'sales.C' || c_custkey, 'CONTROLLER', 'C' || c_custkey, CASE WHEN c_mktsegment = m THEN 'src/test/sales/C' ELSE 'src/main/sales/C' END || c_custkey || '.java', concat_ws(' ', c_name, c_mktsegment) FROM customer, least
  UNION ALL SELECT 'supply.N' || s_nationkey || '.S' || s_suppkey, 'SERVICE', 'S' || s_suppkey, 'src/main/supply/S' || s_suppkey || '.java', s_name FROM supplier
  UNION ALL SELECT 'catalog.' || replace(p_brand, '#', '') || '.P' || p_partkey, CASE WHEN p_type = 'PROMO' THEN 'LIBRARY' ELSE 'REPOSITORY' END, 'P' || p_partkey, CASE WHEN p_type = 'PROMO' THEN '' ELSE 'src/main/catalog/P' || p_partkey || '.java' END, concat_ws(' ', p_name, p_brand, p_type) FROM part
  UNION ALL SELECT 'sales.orders.O' || o_orderkey, 'AGGREGATE', 'O' || o_orderkey, CASE WHEN starts_with(o_orderpriority, '5') THEN 'src/test/sales/orders/O' ELSE 'src/main/sales/orders/O' END || o_orderkey || '.java', concat_ws(' ', o_orderstatus, o_orderpriority) FROM orders
  UNION ALL SELECT DISTINCT 'sales.orders.O' || l_orderkey || '#L' || l_linenumber || '()', 'METHOD', 'L' || l_linenumber, 'src/main/sales/orders/O' || l_orderkey || '.java', '' FROM lineitem)),
pid AS (SELECT p_partkey, 'catalog.' || replace(p_brand, '#', '') || '.P' || p_partkey AS id FROM part),
sid AS (SELECT s_suppkey, s_nationkey, 'supply.N' || s_nationkey || '.S' || s_suppkey AS id FROM supplier),
line AS (SELECT 'sales.orders.O' || l_orderkey AS o, 'sales.orders.O' || l_orderkey || '#L' || l_linenumber || '()' AS m, l_partkey, l_suppkey, l_quantity FROM lineitem),
edges AS MATERIALIZED (
  SELECT DISTINCT type, source_id, target_id FROM (
  SELECT 'EXTENDS' AS type, 'geo.N' || n_nationkey AS source_id, 'geo.R' || n_regionkey AS target_id FROM nation
  UNION ALL SELECT 'IMPLEMENTS', 'sales.C' || c_custkey, 'geo.N' || c_nationkey FROM customer
  UNION ALL SELECT 'INJECTS', id, 'geo.N' || s_nationkey FROM sid WHERE s_nationkey % 2 = 0
  UNION ALL SELECT 'RETURNS_TYPE', sid.id, pid.id FROM (SELECT l_suppkey, min(l_partkey) AS p FROM line GROUP BY l_suppkey) JOIN sid ON l_suppkey = s_suppkey JOIN pid ON p = p_partkey
  UNION ALL SELECT 'RETURNS_TYPE', pid.id, sid.id FROM (SELECT l_partkey, min(l_suppkey) AS s FROM line GROUP BY l_partkey) JOIN pid ON l_partkey = p_partkey JOIN sid ON s = s_suppkey
  UNION ALL SELECT 'INJECTS', 'sales.orders.O' || o_orderkey, 'sales.C' || o_custkey FROM orders WHERE o_orderkey % 8 = 0
  UNION ALL SELECT 'DECLARES_METHOD', o, m FROM line
  UNION ALL SELECT 'CALLS_METHOD', m, pid.id FROM line JOIN pid ON l_partkey = p_partkey WHERE l_quantity >= 49
  UNION ALL SELECT 'CALLS_METHOD', m, sid.id FROM line JOIN sid ON l_suppkey = s_suppkey))"""

PRODUCTION = "(lower(file_path) NOT LIKE '%src/test/%' AND lower(file_path) NOT LIKE '%test.java' AND lower(file_path) NOT LIKE '%tests.java' AND lower(file_path) NOT LIKE '%.spec.ts')"
TEST_P1 = "(file_path LIKE '%src/test/%' OR file_path LIKE '%Test.java' OR file_path LIKE '%Tests.java' OR file_path LIKE '%.spec.ts')"
UNDER_TEST = "(starts_with(file_path, 'src/test/') OR contains(file_path, '/src/test/'))"
GUARD_TEST = f"({UNDER_TEST} OR ends_with(file_path, 'Test.java') OR ends_with(file_path, '.spec.ts') OR starts_with(file_path, 'e2e/') OR contains(file_path, '/e2e/'))"

PACKAGES = """
javat AS (SELECT id FROM nodes WHERE type <> 'METHOD' AND ends_with(file_path, '.java')),
packed AS (SELECT id, type, qualified_name, file_path, CASE WHEN regexp_extract(qualified_name, '(?s)^(.+)\\.[^.]*$', 1) = '' THEN qualified_name ELSE regexp_extract(qualified_name, '(?s)^(.+)\\.[^.]*$', 1) END AS p0 FROM nodes),
packages AS MATERIALIZED (SELECT packed.id, type, qualified_name, file_path, CASE WHEN j.id IS NULL THEN p0 ELSE regexp_extract(p0, '(?s)^(.+)\\.[^.]*$', 1) END AS package FROM packed LEFT JOIN javat j ON packed.p0 = j.id),
pedges AS MATERIALIZED (SELECT a.package AS source_package, b.package AS target_package, count(*) AS n FROM edges e JOIN packages a ON e.source_id = a.id JOIN packages b ON e.target_id = b.id WHERE a.package <> b.package GROUP BY 1, 2)"""

LIVE = """
ups AS (SELECT source_id AS sub, target_id AS sup FROM edges WHERE type IN ('IMPLEMENTS', 'EXTENDS')),
live AS (WITH RECURSIVE l(id) AS (SELECT sub FROM ups WHERE sup IN (SELECT target_id FROM edges WHERE type NOT IN ('IMPLEMENTS', 'EXTENDS')) UNION SELECT ups.sub FROM ups JOIN l ON ups.sup = l.id) SELECT id FROM l)"""

BARE = "bare AS (SELECT n.* FROM nodes n ANTI JOIN edges e ON e.target_id = n.id)"
TESTED = f"""by_production AS MATERIALIZED (SELECT DISTINCT e.target_id FROM edges e JOIN (SELECT id FROM nodes WHERE {PRODUCTION}) s ON e.source_id = s.id),
tested AS (SELECT n.* FROM nodes n SEMI JOIN edges e ON e.target_id = n.id ANTI JOIN by_production p ON p.target_id = n.id)"""

CANDIDATES = f"""{LIVE}, {BARE}, {TESTED},
candidates AS (
  SELECT * FROM (SELECT id, type, CASE WHEN {TEST_P1} THEN 'TEST_SOURCE' WHEN id IN (SELECT id FROM live) THEN NULL
    WHEN type IN ('CONTROLLER', 'EVENT_LISTENER', 'PROJECTION_HANDLER', 'EVENT_APPLIER', 'COMMAND_HANDLER', 'QUERY_HANDLER', 'SQL_TABLE', 'SQL_VIEW', 'SQL_ROUTINE') THEN 'LOW'
    WHEN type IN ('CLASS', 'SERVICE', 'REPOSITORY', 'MAPPER', 'VIEW', 'EVENT_PUBLISHER', 'AGGREGATE', 'FE_SERVICE', 'FE_CLASS', 'FE_CONSTANT') THEN 'HIGH' ELSE 'MEDIUM' END AS tier
    FROM bare WHERE type NOT IN ('CONFIGURATION', 'SHELL_SCRIPT', 'SHELL_COMMAND', 'PY_MODULE')) WHERE tier IS NOT NULL
  UNION ALL SELECT id, type, 'USED_ONLY_BY_TESTS' FROM tested WHERE type NOT IN ('CONFIGURATION', 'SHELL_SCRIPT', 'SHELL_COMMAND', 'PY_MODULE', 'LIBRARY'))"""


def with_graph(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join([GRAPH, *parts]) + "\n" + body


def search_sql(starts: str, depth: int, direction: str, library_leaf: bool = False, sales: bool = False) -> list[str]:
    """Common table expressions whose last, ``reached`` (id, depth), is a level search written out."""
    edge = "(SELECT * FROM edges WHERE type IN ('DECLARES_METHOD', 'INJECTS') AND starts_with(source_id, 'sales.orders.'))" if sales else "edges"
    forward = f"SELECT source_id AS a, target_id AS b FROM {edge} WHERE type <> 'DECLARES_METHOD' AND source_id <> target_id"
    backward = f"SELECT target_id AS a, source_id AS b FROM {edge} WHERE type <> 'DECLARES_METHOD' AND source_id <> target_id"
    costed = {"out": forward, "in": backward, "both": f"{forward} UNION ALL {backward}"}[direction]
    leaf = f"SELECT id FROM nodes WHERE type = 'LIBRARY' AND id NOT IN ({starts})" if library_leaf else "SELECT id FROM nodes WHERE false"
    out = [
        f"costed AS MATERIALIZED ({costed})", f"leaf AS MATERIALIZED ({leaf})", f"starts AS MATERIALIZED ({starts})",
        f"decl AS MATERIALIZED (SELECT source_id AS o, target_id AS m FROM {edge} WHERE type = 'DECLARES_METHOD')",
    ]
    seen, shown, level = [], [], []
    for d in range(depth + 1):
        if d == 0:
            out.append("real_0 AS MATERIALIZED (SELECT id FROM starts)")
        else:
            prev = " UNION ALL ".join(f"SELECT id FROM {x}" for x in level)
            out.append(f"real_{d} AS MATERIALIZED (SELECT DISTINCT b AS id FROM costed WHERE a IN (SELECT id FROM ({prev}) EXCEPT SELECT id FROM leaf) EXCEPT ({' UNION ALL '.join(f'SELECT id FROM {x}' for x in seen)}))")
            shown.append((f"real_{d}", d))
        seen.append(f"real_{d}")
        level = [f"real_{d}"]
        front = f"real_{d}"
        for k in range(3):
            past = " UNION ALL ".join(f"SELECT id FROM {x}" for x in seen)
            out.append(f"down_{d}_{k} AS MATERIALIZED (SELECT m AS id FROM decl WHERE o IN (SELECT id FROM {front} EXCEPT SELECT id FROM leaf) EXCEPT ({past}))")
            out.append(f"up_{d}_{k} AS MATERIALIZED (SELECT o AS id FROM decl WHERE m IN (SELECT id FROM {front} EXCEPT SELECT id FROM leaf) EXCEPT ({past} UNION ALL SELECT id FROM down_{d}_{k}))")
            seen += [f"down_{d}_{k}", f"up_{d}_{k}"]
            shown.append((f"down_{d}_{k}", d))
            if direction != "in":
                shown.append((f"up_{d}_{k}", d))
            body = f"SELECT id FROM down_{d}_{k}" + (f" UNION ALL SELECT id FROM up_{d}_{k}" if direction == "both" else "")
            out.append(f"front_{d}_{k} AS ({body})")
            front = f"front_{d}_{k}"
            level.append(front)
    every = " UNION ALL ".join(f"SELECT id, {d} AS depth FROM {x}" for x, d in shown) or "SELECT '' AS id, 0 AS depth WHERE false"
    out.append(f"reached AS MATERIALIZED (SELECT id, depth FROM ({every}) WHERE id IN (SELECT id FROM nodes) AND id NOT IN (SELECT id FROM starts))")
    return out


def stem_sql(w: str) -> str:
    cases = []
    for s in SUFFIXES:
        guard = f" AND NOT (ends_with({w}, 'ss') OR ends_with({w}, 'us') OR ends_with({w}, 'is'))" if s == "s" else ""
        cases.append(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 4{guard} THEN left({w}, length({w}) - {len(s)})")
    return "CASE " + " ".join(cases) + " END"


def undoubled_sql(s: str, w: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN {w} WHEN length({s}) >= 5 AND right({s}, 1) = substr({s}, -2, 1) AND regexp_matches(right({s}, 1), '[a-z]') AND right({s}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 's') THEN left({s}, length({s}) - 1) ELSE {s} END"


KEYWORDS = f"""
words AS (SELECT doc_id, list_distinct_in_order AS l FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
  lambda w: length(w) > 2 AND NOT list_contains([{', '.join(f"'{s}'" for s in STOP_WORDS)}], w)) AS list_distinct_in_order FROM documents)),
kw AS (SELECT DISTINCT doc_id, unnest(l) AS word FROM words)"""

TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def tokens_sql(c: str) -> str:
    return TOKENS.format(c=c)


def phrase_sql(cols: list[str], words: list[str], prefix: bool) -> str:
    tail = "" if prefix else " "
    needle = " " + " ".join(words) + tail
    return "(" + " OR ".join(f"contains(' ' || array_to_string({tokens_sql(c)}, ' ') || ' ', '{needle}')" for c in cols) + ")"


def fts_sql(cols: list[str], query: str) -> str:
    from graphloom.functions.text import fts_terms

    return " AND ".join(phrase_sql(cols, w, p) for w, p in fts_terms(query))


def ppr_sql(rounds: int = 20) -> list[str]:
    out = [
        "pairs AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM walk WHERE source_id <> target_id GROUP BY 1, 2)",
        "ws AS (SELECT lo AS a, hi AS b, w FROM pairs UNION ALL SELECT hi, lo, w FROM pairs)",
        "share AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM ws)",
        "p AS MATERIALIZED (SELECT id, mass / (SELECT sum(mass) FROM seeds) AS p FROM seeds)",
        "lone AS MATERIALIZED (SELECT id FROM p WHERE id NOT IN (SELECT a FROM share))",
        "r0 AS MATERIALIZED (SELECT id, p AS r FROM p)",
    ]
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} AS MATERIALIZED (SELECT id, sum(r) AS r FROM (SELECT id, p * (0.15 + 0.85 * coalesce((SELECT sum(r) FROM r{k - 1} WHERE id IN (SELECT id FROM lone)), 0)) AS r FROM p UNION ALL SELECT b, 0.85 * r * share FROM r{k - 1} JOIN share ON id = a) GROUP BY id)"
        )
    return out
