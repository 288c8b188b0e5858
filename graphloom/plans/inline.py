"""Queries of the scanners and the project index over sources that are made from the driver's rows: a file a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.extract import index
from graphloom.operators import resolve
from graphloom.plans.queries import query
from graphloom.sources.files import dependencies
from graphloom.sources.storage import table

# A part p whose number ends in another digit than 0 belongs to q, the number that ends in 0; q must be a part too.
_OWNED = "p AS (SELECT DISTINCT p_partkey AS p FROM part), owned AS (SELECT p, p - p % 10 AS q FROM p WHERE p % 10 <> 0 AND p - p % 10 IN (SELECT p FROM p))"


def owned(spark, d) -> DataFrame:
    """(p, q): q is null for parts that belong to none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p")).distinct()
    tens = p.where("p % 10 = 0").select(F.col("p").alias("q"))
    return p.withColumn("_ten", F.when(F.col("p") % 10 != 0, F.col("p") - F.col("p") % 10)).join(tens, F.col("_ten") == F.col("q"), "left").select("p", "q")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _sources(rows: DataFrame, language: str, path: Column, content: Column) -> DataFrame:
    return rows.select(path.alias("file_path"), F.lit(language).alias("language"), content.alias("content"), F.lit(0).cast("bigint").alias("last_modified"))


def java_files(spark, d) -> DataFrame:
    """A class a part; those that belong to another extend it, hold one of it and call it."""
    p, q = F.col("p"), F.col("q")
    plain = _text("package catalog.b", p % 7, ";\npublic class P", p, " {\n  void m() { }\n}\n")
    more = _text("package catalog.b", p % 7, ";\nimport catalog.b", q % 7, ".P", q, ";\npublic class P", p, " extends P", q, " {\n  private P", q, " next;\n  void m() { next.m(); }\n}\n")
    return _sources(owned(spark, d), "java", _text("src/P", p, ".java"), F.when(q.isNull(), plain).otherwise(more))


@query(
    f"""WITH {_OWNED}, t AS (SELECT p, 'catalog.b' || (p % 7) || '.P' || p AS id FROM p), o AS (SELECT a.id AS a, b.id AS b FROM owned JOIN t a ON a.p = owned.p JOIN t b ON b.p = owned.q)
SELECT 'DECLARES_METHOD' AS type, id AS source_id, id || '#m()' AS target_id FROM t UNION ALL SELECT 'EXTENDS', a, b FROM o UNION ALL SELECT 'CALLS_METHOD', a, b FROM o
UNION ALL SELECT 'CALLS', a || '#m()', b || '#m()' FROM o UNION ALL SELECT 'OVERRIDES', a || '#m()', b || '#m()' FROM o"""
)
def project_edges(spark, d):
    return index.build(java_files(spark, d))["edges"]


@query(
    f"""WITH {_OWNED}, t AS (SELECT p, 'catalog.b' || (p % 7) || '.P' || p AS id FROM p), o AS (SELECT owned.p, a.id AS a, b.id AS b FROM owned JOIN t a ON a.p = owned.p JOIN t b ON b.p = owned.q)
SELECT 'DECLARES_METHOD' AS type, id AS source_id, id || '#m()' AS target_id FROM t UNION ALL SELECT 'EXTENDS', a, b FROM o UNION ALL SELECT 'CALLS_METHOD', a, b FROM o WHERE p % 13 <> 0
UNION ALL SELECT 'CALLS', a || '#m()', b || '#m()' FROM o WHERE p % 13 <> 0 UNION ALL SELECT 'OVERRIDES', a || '#m()', b || '#m()' FROM o"""
)
def project_edges_after_sync(spark, d):
    """The index of the project, and then a fast sync of the files whose calls are gone."""
    files = java_files(spark, d)
    changed = files.where(F.regexp_extract("file_path", "([0-9]+)", 1).cast("bigint") % 13 == 0).withColumn("content", F.replace("content", F.lit("next.m();"), F.lit("")))
    return index.sync_fast(index.build(files), changed, "GENERIC")["edges"]


@query(
    f"""WITH {_OWNED}, kept AS (SELECT p FROM p WHERE NOT (p % 10 <> 0 AND p % 7 = 3))
SELECT 'node' AS kind, 'sql:t' || p AS id, 'SQL_TABLE' AS type, 'db/V' || p || '__t.sql' AS file_path FROM kept
UNION ALL SELECT 'edge', 'sql:t' || p || '>sql:t' || q, 'REFERENCES_FK', 'db/V' || p || '__t.sql' FROM owned WHERE p % 7 <> 3"""
)
def sql_schema_fold(spark, d):
    """A migration a part: its table, which may refer to that of another, and may go again."""
    p, q = F.col("p"), F.col("q")
    made = F.concat(_text("create table t", p, " (id int"), F.coalesce(_text(", c int references t", q, "(id)"), F.lit("")), F.lit("); -- drop table t0;\n"), F.when((p % 10 != 0) & (p % 7 == 3), _text("drop table t", p, ";")).otherwise(""))
    rows = index.extract_rows(_sources(owned(spark, d), "sql", _text("db/V", p, "__t.sql"), made), "GENERIC")
    return rows.select("kind", F.coalesce("id", F.concat_ws(">", "source_id", "target")).alias("id"), "type", "file_path")


@query(
    """WITH imports AS (SELECT DISTINCT 'sales.O' || l_orderkey AS source_id, 'catalog.' || replace(p_brand, '#', '') || '.P' || p_partkey AS target, p_partkey AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
declared AS (SELECT 'catalog.' || replace(p_brand, '#', '') AS g FROM part GROUP BY p_brand HAVING p_brand <> (SELECT max(p_brand) FROM part))
SELECT 'USES_LIBRARY' AS type, source_id, target AS target_id FROM imports WHERE p % 10 <> 0 AND EXISTS (SELECT 1 FROM declared WHERE starts_with(target, g || '.'))"""
)
def import_owner(spark, d):
    """Orders import the parts of their lines; brands but for the last are declared, and every tenth part is a class of the project."""
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    brand = F.concat(F.lit("catalog."), F.replace("p_brand", F.lit("#"), F.lit("")))
    full, name = F.concat(brand, F.lit(".P"), F.col("p_partkey").cast("string")), _text("P", F.col("p_partkey"))
    imports = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(_text("sales.O", F.col("l_orderkey")).alias("source_id"), full.alias("target"), name.alias("name")).distinct()
    last = part.agg(F.max("p_brand").alias("_last"))
    groups = part.select("p_brand", brand.alias("group_id")).distinct().join(last, F.col("p_brand") != F.col("_last")).select(F.col("p_brand").alias("ord"), "group_id", F.lit("parts").alias("artifact"))  # one row on the other side
    nodes = part.where("p_partkey % 10 = 0").select(full.alias("id"), F.lit("CLASS").alias("type"), name.alias("name"))
    return resolve.libraries(imports, groups, nodes)[1]


@query(
    """SELECT DISTINCT p_partkey, g, a, v FROM (SELECT p_partkey, 'com.' || replace(p_brand, '#', '.') AS g, replace(p_name, ' ', '-') AS a, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS v FROM part
UNION ALL SELECT p_partkey, 'org.maven', 'm' || p_partkey, '3' FROM part UNION ALL SELECT p_partkey, 'org.map', 'k' || (p_partkey % 5), '1.0' FROM part)"""
)
def build_dependencies(spark, d):
    """A build file a part, with an entry that is no dependency and one that is given twice."""
    key = F.col("p_partkey")
    entry = F.concat(F.lit("com."), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(key % 2 == 0, _text(":", F.col("p_size"))).otherwise(""))
    text = F.concat(
        F.lit("plugins 'not.a:dependency:1'\nimplementation '"), entry, F.lit("'\napi(\""), entry, F.lit("\")\ncompileOnly group: 'org.map', name: 'k"), (key % 5).cast("string"),
        F.lit("', version: '1.0'\n<dependency><groupId>org.maven</groupId><artifactId>m"), key.cast("string"), F.lit("</artifactId>\n<version>3</version></dependency>"),
    )
    return table(spark, d, "part").select("p_partkey", F.inline(dependencies(text))).distinct()
