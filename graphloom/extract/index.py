"""A whole index: files in, the graph's tables out.

Each file is scanned once, for all kinds of rows at the same time; what needs names
from other files is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.extract import java, scripts, sql
from graphloom.extract.scan import FIELDS, ROWS
from graphloom.functions.ids import declaring_class, method_name
from graphloom.operators import contains, resolve, traverse
from graphloom.operators.graph import CodeGraph
from graphloom.operators.incremental import shape_hash
from graphloom.operators.store import by_path_order
from graphloom.sources.storage import stored

SCANNERS = {"typescript": scripts.typescript, "dart": scripts.dart, "groovy": scripts.groovy, "python": scripts.python, "shell": scripts.shell}


def project_tier(files: DataFrame) -> str:
    """DDD, CRUD or GENERIC by the markers in the Java files."""
    ddd, crud = F.col("content").rlike(java.DDD_MARKERS), F.col("content").rlike(java.SPRING_MARKERS)
    most = files.where("language = 'java'").agg(F.max(F.when(ddd, 2).when(crud, 1).otherwise(0))).first()[0]
    return ("GENERIC", "CRUD", "DDD")[most or 0]


def extract_rows(files: DataFrame, tier: str) -> DataFrame:
    """All rows of all files (file_path, language, content); migrations are folded in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in zip(b["file_path"], b["language"], b["content"]):
                found = java.extract(path, text or "", tier) if language == "java" else SCANNERS[language](path, text or "")
                for r in found:
                    r.update(language=language, file_path=path)
                if language == "java":
                    out += [r | {"kind": "shape", "snippet": line} for line in java.shape_lines(found) for r in [dict.fromkeys(FIELDS) | {"language": language, "file_path": path}]]
                out += found
            yield pd.DataFrame(out, columns=FIELDS).astype(object).where(lambda x: x.notna(), None)

    code = files.where(F.col("language").isin("java", *SCANNERS)).select("file_path", "language", "content").mapInPandas(run, ROWS)
    migrations = files.where("language = 'sql'")
    return code if migrations.isEmpty() else code.unionByName(schema_rows(migrations))


def schema_rows(files: DataFrame) -> DataFrame:
    """The rows of ``sql.fold`` over all files (file_path, content), whose order counts for each name alone.

    The files are read apart. Their changes are then dealt by name, names that a renaming joins together, and sorted by version, so that a task
    holds the changes of one such group at a time, as a stream. What is referred to is met by its name at last in a join.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["_late", "_version", "file_path", "_at", "op", "name", "other", "type", "line", "snippet", "refs"]
        for b in batches:
            found = [(*sql.sort_key(path), n, *change) for path, text in zip(b["file_path"], b["content"]) for n, change in enumerate(sql.changes(text or ""))]
            yield pd.DataFrame(found, columns=columns)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, schema, out = None, sql.Schema(), []
        for b in batches:
            for key, *change in zip(*(b[c] for c in ("_group", "file_path", "op", "name", "other", "type", "line", "snippet", "refs"))):
                if key != group:
                    out += schema.rows()
                    group, schema = key, sql.Schema()
                schema.apply(*change)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=FIELDS, dtype=object)
                out = []
        yield pd.DataFrame([*out, *schema.rows()], columns=FIELDS, dtype=object)

    changes = stored(files.select("file_path", "content").mapInPandas(read, f"_late int, _version array<string>, file_path string, _at int, {sql.CHANGES}"), "schema-changes")
    renamed = changes.where("op = 'rename' AND name <> other").select(F.lit("RENAMED").alias("type"), F.col("name").alias("source_id"), F.col("other").alias("target_id"))
    if renamed.isEmpty():
        grouped = changes.withColumn("_group", F.col("name"))
    else:
        names = renamed.select(F.col("source_id").alias("id")).union(renamed.select("target_id")).distinct()
        together = traverse.components(CodeGraph(names, renamed)).select(F.col("id").alias("name"), F.col("root").alias("_root"))
        grouped = changes.join(together, "name", "left").withColumn("_group", F.coalesce("_root", "name"))
    dealt = grouped.repartition("_group").sortWithinPartitions("_group", "_late", "_version", "file_path", "_at")
    rows = stored(dealt.mapInPandas(replay, ROWS), "schema-rows")
    nodes = rows.where("kind = 'node'")
    now = nodes.select(F.col("name").alias("_named"), F.col("id").alias("_now")).unionAll(rows.where("kind = 'now'").select("name", "target"))
    met = rows.where("kind = 'wanted'").join(now, F.col("target") == F.col("_named")).where("source_id <> _now")
    return nodes.unionByName(met.withColumn("kind", F.lit("edge")).withColumn("target", F.col("_now")).select(*FIELDS))


def build(files: DataFrame, dependencies: DataFrame | None = None, rest: dict[str, DataFrame] | None = None, tier: str | None = None) -> dict[str, DataFrame]:
    """nodes, edges, methods, entry_points, method_return_class, file_shapes and indexed_files of a project.

    With ``rest``, the tables of the project's other files, ``files`` are a part of it: names and calls may lead to the rest, and the
    result has the rows of the part alone. Its ``tier`` is then given, since the part does not tell it.
    """
    rows = stored(extract_rows(files, tier or project_tier(files)), "rows")
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    when = files.select("file_path", F.col("last_modified")).dropDuplicates(["file_path"])
    raw = of("node", "method").select("id", "type", "name", "qualified_name", "file_path", F.col("line").alias("line_number"), F.col("snippet").alias("code_snippet"))
    nodes = stored(by_path_order(raw.join(when, "file_path", "left").select("id", "type", "name", "qualified_name", "file_path", "line_number", "code_snippet", "last_modified")), "index-nodes")
    own_methods = of("method").select("id", "owner", "name").dropDuplicates(["id"])
    around, methods = nodes, own_methods
    if rest is not None:
        around = nodes.unionByName(rest["nodes"].select(*nodes.columns))
        known_methods = rest["nodes"].where("type = 'METHOD'").select("id", declaring_class("id").alias("owner"), method_name("id").alias("name"))
        methods = own_methods.unionByName(known_methods).dropDuplicates(["id"])
    types = around.where("type NOT IN ('METHOD', 'LIBRARY', 'SHELL_COMMAND')")
    imports, wildcards, packages = of("import"), of("wildcard"), of("package")

    def edge(df: DataFrame, kind, source: str, target: str) -> DataFrame:
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"))

    known = around.select("id").distinct()
    wanted = of("ref", "super", "call", "returns").select("file_path", F.coalesce("owner", "source_id").alias("owner"), "target")
    supers = None if rest is None else stored(rest["edges"].where("type IN ('EXTENDS', 'IMPLEMENTS')").distinct(), "supers")
    while True:  # supertypes are names too, and may be inherited member types themselves
        names = stored(resolve.type_names(wanted, types, imports, wildcards, packages, supers), "names")
        refs = of("ref").join(names, ["file_path", "owner", "target"])
        plain = refs.where("source_id <> resolved")
        own_supers = edge(plain.where(F.col("type").isin("EXTENDS", "IMPLEMENTS")), F.col("type"), "source_id", "resolved")
        if rest is not None:
            own_supers = own_supers.unionByName(rest["edges"].where("type IN ('EXTENDS', 'IMPLEMENTS')").select("type", "source_id", "target_id"))
        before, supers = supers, stored(own_supers.distinct(), "supers")
        if before is not None and (before.count() == supers.count() and supers.exceptAll(before).isEmpty()):
            break
    made = [edge(of("method"), "DECLARES_METHOD", "owner", "id"), edge(plain, F.col("type"), "source_id", "resolved"), edge(of("edge"), F.col("type"), "source_id", "target")]

    sites = of("call").withColumn("call", F.concat_ws("@", "file_path", "source_id", F.col("line").cast("string"))).drop("type_")
    typed = sites.where("target IS NOT NULL").join(names, ["file_path", "owner", "target"]).select("call", F.lit(None).cast("string").alias("parent"), F.col("resolved").alias("receiver"), "name", "n")
    own = sites.where("target IS NULL AND type IN ('own', 'super')").select("call", F.lit(None).cast("string").alias("parent"), F.col("owner").alias("receiver"), "name", "n")
    chain = sites.where("type = 'chain' AND id IS NOT NULL").select("call", F.concat_ws("@", "file_path", "source_id", "id").alias("parent"), F.lit(None).cast("string").alias("receiver"), "name", "n")
    returns = stored(of("returns").where("n = 0").join(names, ["file_path", "owner", "target"]).select(F.col("source_id").alias("method_id"), F.col("resolved").alias("class_id")).dropDuplicates(["method_id"]), "returns")
    every_return = returns if rest is None else returns.unionByName(rest["method_return_class"])
    bound = resolve.bind_chains(stored(typed.unionByName(own).unionByName(chain), "calls"), methods, supers, every_return)
    made.append(edge(bound.join(sites.select("call", "source_id"), "call").where("source_id <> method"), "CALLS", "source_id", "method"))
    made.append(resolve.overrides(methods, supers).join(own_methods.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("type", "source_id", "target_id"))

    tables = around.where("type = 'SQL_TABLE'").select(F.col("name").alias("target"), F.col("id").alias("_table"))
    made.append(edge(of("table_ref").join(tables, "target"), "REFERENCES_TABLE", "source_id", "_table"))
    scopes = of("aggregate_ref").select(F.struct("source_id", "target").alias("text_id"), F.lower("target").alias("text"))
    loaded = contains.least_contained(scopes, around.where("type = 'AGGREGATE'").select(F.col("id").alias("needle_id"), F.lower("name").alias("needle")))
    made.append(edge(loaded.select("text_id.source_id", "needle_id"), "LOADS_AGGREGATE", "source_id", "needle_id"))

    modules = around.where("type = 'PY_MODULE'").select("id", F.regexp_replace("id", r"(/__init__)?\.py$", "").alias("_module"))
    asked = of("py_import").select("source_id", F.explode(F.array("target", F.concat_ws("/", "target", "name"))).alias("_module"))
    made.append(edge(asked.join(modules, "_module").where("source_id <> id"), "IMPORTS", "source_id", "id"))
    bases = of("py_base").withColumn("_id", F.concat(F.substring_index("source_id", "::", 1), F.lit("::"), F.col("target")))
    made.append(edge(bases.join(known.select(F.col("id").alias("_id")), "_id", "left_semi"), "EXTENDS", "source_id", "_id"))
    local = of("py_call").join(known.select(F.col("id").alias("target")), "target", "left_semi")
    made.append(edge(local.where("source_id <> target"), "CALLS", "source_id", "target"))
    foreign = of("py_call").where("owner IS NOT NULL").select("source_id", F.substring_index("owner", "|", 1).alias("_module"), F.substring_index("owner", "|", -1).alias("_name"))
    made.append(edge(foreign.join(modules, "_module").withColumn("_id", F.concat("id", F.lit("#"), "_name", F.lit("()"))).join(known.select(F.col("id").alias("_id")), "_id", "left_semi"), "CALLS", "source_id", "_id"))
    made.append(edge(of("sources").join(around.where("type = 'SHELL_SCRIPT'").select(F.col("id").alias("target")), "target", "left_semi"), "SOURCES", "source_id", "target"))
    services = nodes.where("type = 'FE_SERVICE'")
    components = nodes.where("type = 'FE_COMPONENT'").select("id", "file_path").join(files.select("file_path", "content"), "file_path")
    made.append(edge(contains.injections(components, around.where("type = 'FE_SERVICE'")), "USES_SERVICE", "text_id", "needle_id"))
    made.append(edge(contains.api_calls(services, around.where("type = 'CONTROLLER'")), "CALLS_API", "text_id", "needle_id"))

    empty = nodes.limit(0)
    commands = of("edge").where("type = 'RUNS'").select("target").distinct()
    minted = commands.select(F.col("target").alias("id"), F.lit("SHELL_COMMAND").alias("type"), F.col("target").alias("name"), F.col("target").alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("line_number"), F.lit("").alias("code_snippet"), F.lit(0).cast("bigint").alias("last_modified"))
    if dependencies is not None:
        first_type = nodes.where("type <> 'METHOD'").where(F.col("file_path").endswith(".java")).groupBy("file_path").agg(F.min("id").alias("source_id"))
        used = imports.drop("source_id").join(first_type, "file_path").select("source_id", "target", "name")
        library_nodes, uses = resolve.libraries(used, dependencies, around)
        made.append(uses)
    else:
        library_nodes = empty
    edges = made[0]
    for e in made[1:]:
        edges = edges.unionByName(e)
    every = nodes.unionByName(minted.join(known, "id", "left_anti")).unionByName(library_nodes)
    return {
        "nodes": every,
        "edges": stored(edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").distinct(), "index-edges"),
        "methods": of("method").select(F.col("owner").alias("node_id"), "name", F.col("target").alias("return_type"), F.regexp_extract("id", r"(?s)\((.*)\)$", 1).alias("parameters"), F.lit("").alias("annotations"), F.col("source_id").alias("visibility")),
        "entry_points": of("entry").select(F.col("id").alias("node_id")).distinct(),
        "method_return_class": returns,
        "file_shapes": shape_hash(of("shape").select("file_path", F.col("snippet").alias("line"))),
        "indexed_files": files.select("file_path", "last_modified", F.sha2(F.coalesce("content", F.lit("")), 256).alias("checksum")),
    }


def sync_fast(tables: dict[str, DataFrame], changed: DataFrame, tier: str, dependencies: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a project after changes within the bodies of some Java files (``changed``: their new contents), equal to those of a full index.

    For files whose shape is the stored one (``incremental.decision``): their nodes, and so what others mean by their names, stay the same. So only
    their own rows are made again, against the tables of the rest, and put in the place of the old ones.
    """
    paths = stored(changed.select("file_path").distinct(), "changed-paths")
    nodes = tables["nodes"]
    gone = stored(nodes.join(paths, "file_path", "left_semi").select("id"), "changed-ids")
    of_gone = lambda name, column: tables[name].join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*tables[name].columns)
    of_path = lambda name: tables[name].join(paths, "file_path", "left_anti").select(*tables[name].columns)
    rest = {
        "nodes": of_path("nodes"), "edges": of_gone("edges", "source_id"), "entry_points": of_gone("entry_points", "node_id"), "methods": of_gone("methods", "node_id"),
        "method_return_class": of_gone("method_return_class", "method_id"), "file_shapes": of_path("file_shapes"), "indexed_files": of_path("indexed_files"),
    }
    fresh = build(changed, dependencies, rest, tier)
    out = {name: df.unionByName(fresh[name]) for name, df in rest.items()}
    out["nodes"] = out["nodes"].dropDuplicates(["id"])  # libraries and commands that the rest uses too
    held = out["edges"].select(F.col("target_id").alias("id")).distinct()
    minted = F.col("type").isin("LIBRARY", "SHELL_COMMAND")  # they last as long as something uses them
    out["nodes"] = out["nodes"].where(~minted).unionByName(out["nodes"].where(minted).join(held, "id", "left_semi").select(*nodes.columns))
    return out
