"""Graph, search and maintenance operators on small hand-made and random tables."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import ids, paths
from graphloom.functions import text as T
from graphloom.operators import cochange, dead, export, impact, incremental, rank, search, store, traverse
from graphloom.operators.graph import CodeGraph


def graph(spark, nodes, edges):
    rows = [(i, t, i.rsplit(".", 1)[-1], i, p, 1, "", 0) for i, t, p in nodes]
    return CodeGraph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(edges, schema.EDGES))


def brute_search(nodes, edges, start, depth, direction, leaf):
    kinds = dict(nodes)
    leaves = {n for n, t in nodes if t == "LIBRARY" and n != start} if leaf else set()
    declares = {(a, b) for t, a, b in edges if t == "DECLARES_METHOD" and a != b}
    other = {(a, b) for t, a, b in edges if t != "DECLARES_METHOD" and a != b}
    costed = {"out": other, "in": {(b, a) for a, b in other}, "both": other | {(b, a) for a, b in other}}[direction]
    seen, shown, previous = {start}, {}, set()
    for d in range(depth + 1):
        arrived = {start} if d == 0 else {b for a, b in costed if a in previous - leaves} - seen
        seen |= arrived
        shown |= {n: d for n in arrived}
        front, level = arrived, set(arrived)
        while front:
            down = {m for o, m in declares if o in front - leaves} - seen
            up = {o for o, m in declares if m in front - leaves} - seen - down
            seen |= down | up
            shown |= {n: d for n in (down | up if direction != "in" else down)}
            front = down | (up if direction == "both" else set())
            level |= front
        previous = level
    return {(n, d) for n, d in shown.items() if n in kinds and n != start}


@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_search_matches_brute_force(spark, direction):
    r = random.Random(direction)
    nodes = [(f"n{k}", r.choice(["CLASS", "METHOD", "LIBRARY"])) for k in range(14)]
    names = [n for n, _ in nodes] + ["gone"]
    edges = list({(r.choice(["DECLARES_METHOD", "CALLS", "INJECTS"]), r.choice(names), r.choice(names)) for _ in range(26)})
    g = graph(spark, [(n, t, "src/A.java") for n, t in nodes], edges)
    for leaf in (False, True):
        got = {(x.id, x.depth) for x in traverse.search(g, spark.createDataFrame([("n0",)], "id string"), 2, direction, leaf).collect()}
        assert got == brute_search(nodes, edges, "n0", 2, direction, leaf)


def test_components_and_chain(spark):
    g = graph(spark, [(x, "CLASS", "a") for x in "abcdef"], [("CALLS", "a", "b"), ("CALLS", "x", "b"), ("CALLS", "x", "c"), ("CALLS", "e", "e")])
    assert {(r.id, r.root) for r in traverse.components(g).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")}
    assert {r.id for r in traverse.trace_chain(g, "c").collect()} == {"a", "b", "c"}


def test_pagerank_invariants(spark):
    g = graph(spark, [(x, "CLASS", "a") for x in "abcde"], [("CALLS", "a", "b"), ("CALLS", "b", "c"), ("CALLS", "c", "c"), ("USES", "b", "a")])
    s = {r.id: r.score for r in rank.pagerank(g.nodes, g.edges, spark.createDataFrame([("a", 3.0), ("e", 1.0)], "id string, mass double")).collect()}
    assert sum(s.values()) == pytest.approx(1) and s["a"] > s["c"] > s["d"] == 0 and s["e"] > 0
    none = rank.pagerank(g.nodes, g.edges, spark.createDataFrame([], "id string, mass double")).collect()
    assert {r.score for r in none} == {0.0}


def test_pagerank_sends_a_rank_once_to_a_bucket_and_equals_plain_rounds(spark):
    import numpy as np
    import pandas as pd

    chance, size = random.Random(4), 60
    pairs = [(chance.randrange(size), chance.randrange(50) if chance.random() < 0.7 else 7) for _ in range(150)]
    pairs = [(a, b) for a, b in pairs if a < 50]  # the last ten have no edge
    w = np.zeros((size, size))
    for a, b in pairs:
        if a != b:
            w[a, b] += 1
            w[b, a] += 1
    w = np.sqrt(w)
    p = np.zeros(size)
    p[[3, 9, 55, 58]] = np.array([1, 2, 3, 1]) / 7
    out, r = w.sum(1), p
    for _ in range(20):
        lost = r[out == 0].sum()
        r = p * (0.15 + 0.85 * lost) + 0.85 * (w.T @ np.divide(r, out, out=np.zeros(size), where=out > 0))
    g = graph(spark, [(f"n{n}", "CLASS", "a") for n in range(size)], [("CALLS", f"n{a}", f"n{b}") for a, b in pairs])
    seeds = spark.createDataFrame([("n3", 1.0), ("n9", 2.0), ("n55", 3.0), ("n58", 1.0), ("unknown", 0.0)], "id string, mass double")
    got = {x.id: x.score for x in rank.pagerank(g.nodes, g.edges, seeds).collect()}
    assert len(got) == size and [got[f"n{n}"] for n in range(size)] == pytest.approx(list(r))

    many = pd.DataFrame({"s": [5] * 40 + [6, 6], "t": [*((1 << rank.SHIFT) + n for n in range(40)), 1 << rank.SHIFT, 1 << rank.SHIFT]})
    blocks = rank._blocks(many)
    route = blocks[blocks["part"] == "route"]
    assert [(r.b, r.other, list(np.frombuffer(r.i, np.int32))) for r in route.itertuples()] == [(0, 1, [5, 6])]  # forty edges, one rank
    assert np.frombuffer(blocks[blocks["part"] == "strength"]["x"].iat[0])[0] == pytest.approx(1 + 2**0.5)


def test_pagerank_of_numbers_takes_rows_of_one_tag_once_and_walks_over_unknown_ends(spark):
    import numpy as np

    chance, low = random.Random(5), 7 << 3
    ids = [n << 8 | k << 3 for n in range(40) for k in range(3)]
    rows = [(chance.choice(ids), chance.choice(ids[:30]), chance.randrange(3)) for _ in range(400)] + [(ids[0], 99 << 8, 0)]
    w = {}
    for s, t, _ in {r for r in rows if r[0] != r[1]}:
        w[s, t] = w[t, s] = w.get((s, t), 0) + 1
    every = [*ids, 99 << 8]
    m = np.array([[w.get((a, b), 0) ** 0.5 for b in every] for a in every])
    p = np.array([3.0, 1.0] + [0] * (len(every) - 2)) / 4
    out, r = m.sum(1), p
    for _ in range(20):
        r = p * (0.15 + 0.85 * r[out == 0].sum()) + 0.85 * (m.T @ np.divide(r, out, out=np.zeros(len(r)), where=out > 0))
    nodes = spark.createDataFrame([(n,) for n in ids + ids[:20]], "id bigint")
    edges = spark.createDataFrame(rows + rows[:100], "source_id bigint, target_id bigint, tag bigint")
    got = rank.pagerank(nodes, edges, spark.createDataFrame([(ids[0], 3.0), (ids[1], 1.0)], "id bigint, mass double"), near=low).collect()
    assert len(got) == len(ids) and {x.id: x.score for x in got} == pytest.approx(dict(zip(ids, r)))
    assert len(set(rank._bucket(np.array([5 << 8, 5 << 8 | 16, 5 << 8 | 40]), 1000, low))) == 1


def test_pagerank_sends_a_number_a_hub_and_not_one_an_edge(spark):
    import numpy as np
    import pandas as pd

    by_bucket = {b: [n for n in range(5000) if rank._bucket(np.array([n]), 2, 0)[0] == b] for b in (0, 1)}
    hub, leaves = by_bucket[0][0], by_bucket[1][:500]
    edges = pd.DataFrame({"s": [hub] * 500, "t": leaves, "tag": 0})
    rows = pd.concat(rank._deal_edges(2, 0)(iter([edges])))
    parts = {b: rank._laid(rows[rows["b"] == b], 2, 0, False) for b in (0, 1)}
    none = pd.DataFrame([], columns=rank._SENT_COLUMNS)
    seed = pd.DataFrame([(0, 0, "seed", b"", np.zeros(1, np.int32).tobytes(), np.ones(1).tobytes())], columns=rank._COLUMNS)
    there = rank._step(1.0, 0.85)(pd.concat([parts[0], seed]), none)
    assert [(r.b, r.sums, list(np.frombuffer(r.x))) for r in there.itertuples()] == [(1, False, [1 / 500])]
    back = rank._step(0.15, 0.85)(parts[1], there)
    assert [(r.b, r.sums) for r in back.itertuples()] == [(0, True)] and list(np.frombuffer(back["x"].iat[0])) == pytest.approx([0.85])
    assert sum(len(p[p["part"] == "edges"]) for p in parts.values()) == 1  # each edge is kept by one of its ends


def test_exchanges_go_with_the_query_that_is_stored(spark):
    from graphloom.sources.storage import bucketed, stored

    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(n).getName() for n in range(held.size()) if held.apply(n).getName().startswith("shuffle_")}

    rows, before = spark.range(1000).select((F.col("id") % 7).alias("k")), files()
    some = stored(rows.groupBy("k").count(), "some")
    assert not files() - before and some.count() == 7
    before = files()
    with bucketed(rows, "some", "k") as dealt:
        assert not files() - before and dealt.count() == 1000


def test_dead_tiers(spark):
    nodes = [("p.Ctrl", "CONTROLLER", "src/main/a.java"), ("sql:t", "SQL_TABLE", "db/a.sql"), ("p.T", "CLASS", "src/test/a.java"), ("p.Only", "CLASS", "src/main/b.java"), ("p.S", "SERVICE", "src/main/c.java"),
             ("p.E", "ENTITY", "src/main/d.java"), ("p.Impl", "CLASS", "src/main/e.java"), ("p.I", "INTERFACE", "src/main/f.java"), ("p.Conf", "CONFIGURATION", "src/main/g.java"), ("p.Use", "SERVICE", "src/main/h.java")]
    edges = [("CALLS_METHOD", "p.T", "p.Only"), ("IMPLEMENTS", "p.Impl", "p.I"), ("INJECTS", "p.Use", "p.I")]
    got = {r.id: r.tier for r in dead.candidates(graph(spark, nodes, edges), spark.createDataFrame([("p.Use",)], schema.ENTRY_POINTS)).collect()}
    assert got == {"p.Ctrl": "LOW", "sql:t": "LOW", "p.T": "TEST_SOURCE", "p.Only": "USED_ONLY_BY_TESTS", "p.S": "HIGH", "p.E": "MEDIUM", "p.Use": "MEDIUM"}


def test_words_and_ids(spark):
    stems = {"cancellation": "cancel", "cancelled": "cancel", "cancels": "cancel", "orders": "order", "sales": "sale", "controller": "control", "stopped": "stop", "order": "order", "install": "install", "class": "class", "status": "status", "analysis": "analysis", "installed": "instal", "classes": "class"}
    words = spark.createDataFrame(list(stems.items()), "w string, s string")
    assert words.where(T.stem("w") != F.col("s")).count() == 0
    one = spark.createDataFrame([("add notes field to purchase orders", "a.b.C#go(java.util.List<X>, int)", "HTTPServerName", "src/test/ALatest.java")], "t string, m string, s string, p string")
    r = one.select(T.keywords("t").alias("k"), ids.arity("m").alias("n"), ids.short_label("m").alias("l"), ids.snake_case("s").alias("s"), paths.is_test_source("p").alias("p"), ids.simplify_type(F.lit("java.util.Map<A,B>[]")).alias("y")).first()
    assert list(r.k) == ["notes", "purchase", "orders"] and r.n == 2 and r.l.startswith("C#go(") and r.s == "http_server_name" and r.p and r.y == "Map"


def test_full_text(spark):
    n = spark.createDataFrame([("1", "PurchaseOrder", "p.PurchaseOrder", ""), ("2", "Other", "p.Other", "new PurchaseOrder()"), ("3", "clean", "p.clean", "a clean-restart here")], "id string, name string, qualified_name string, code_snippet string")
    hits = lambda q: sorted(r.id for r in search.full_text(n, q).collect())
    assert hits("purchaseorder") == ["1", "2"] and hits("purchase") == ["1", "2"] and hits("order") == [] and hits("clean-rest") == ["3"] and hits("") == []


def test_co_change(spark):
    rows = [(1, 1, f) for f in "ABC"] + [(2, 2, f) for f in "AC"] + [(3, 3, "A")] + [(4, 4, f"f{k}") for k in range(60)]
    c = spark.createDataFrame(rows, "commit int, seq int, file string")
    pairs = cochange.pairs(c)
    assert {(r.file_a, r.file_b, r["count"]) for r in pairs.collect()} == {("A", "B", 1), ("A", "C", 2), ("B", "C", 1)}
    assert cochange.skipped_bulk_commits(c).first().skipped == 1
    more = spark.createDataFrame([("C", "A", 3)], "file_a string, file_b string, count bigint")
    assert cochange.top_coupled(cochange.upsert(pairs, more), "A", 1).first()["count"] == 5


def test_spans(spark):
    spans = spark.createDataFrame([("m1", "f", 10, 20), ("m2", "f", 12, 15), ("m3", "g", 1, 5)], "id string, path string, begin int, end int")
    hunks = spark.createDataFrame([("f", 13, 14), ("g", 5, 5), ("g", 2, 2)], "path string, begin_b int, end_b int")
    assert {r.id for r in impact.changed_spans(hunks, spans).collect()} == {"m1", "m2", "m3"}
    lines = spark.createDataFrame([("f", 13), ("f", 19), ("g", 9)], "path string, line int")
    assert {(r.line, r.id) for r in impact.innermost(lines, spans).collect()} == {(13, "m2"), (19, "m1")}


def test_store_and_catalog(spark, tmp_path):
    known = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    more = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in store.upsert(known, more, ["k"], ["v"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    c = store.Catalog(spark, f"file://{tmp_path}/p")
    with pytest.raises(LookupError):
        c.table("t")
    c.batch({"t": known})
    first = c.version()
    c.batch({"t": more})
    assert c.version() != first and c.table("t").count() == 3


def test_incremental(spark):
    files = "file_path string, last_modified bigint, checksum string"
    scan = spark.createDataFrame([("A.java", 2, "x"), ("B.java", 1, "y"), ("C.java", 5, "c2"), ("D.java", 1, "d")], files)
    tracked = spark.createDataFrame([("A.java", 1, "x"), ("B.java", 1, "z"), ("C.java", 1, "c"), ("E.java", 1, "e")], files)
    states = incremental.classify(scan, tracked)
    assert {r.file_path: r.state for r in states.collect()} == {"A.java": "same", "B.java": "same", "C.java": "changed", "D.java": "new", "E.java": "deleted"}
    shapes = spark.createDataFrame([(f"{k}.java", k) for k in "ABCD"], schema.FILE_SHAPES)
    assert incremental.decision(states, shapes, shapes).first().reason == "new file"
    quiet = states.where("file_path IN ('A.java', 'B.java', 'C.java')").unionByName(spark.createDataFrame([("F.java", "same")], "file_path string, state string"))
    assert incremental.decision(quiet, shapes, shapes).first().reason == "fast"
    assert incremental.decision(quiet, shapes.withColumn("shape_hash", F.lit("new")), shapes).first().reason == "shape changed"
    assert incremental.decision(states.where("state = 'same'"), shapes, shapes).first().reason == "none"


def test_stream_of_arrivals(spark, tmp_path):
    from graphloom.streaming.sync import arrivals

    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    args = (spark, str(folder), f"file://{tmp_path}/cat", str(tmp_path / "check"))
    assert arrivals(*args).count() == 1
    (folder / "b.txt").write_text("two")
    assert arrivals(*args).count() == 2


def test_sync_sees_changed_and_deleted_files(spark, tmp_path):
    import os

    from graphloom.streaming.sync import sync

    folder, root = tmp_path / "src", f"file://{tmp_path}/cat"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(name)

    def states():
        return {r.file_path[-5]: r.state for r in sync(spark, str(folder), root).collect()}

    assert states() == {"a": "new", "b": "new", "c": "new"}
    assert states() == {"a": "same", "b": "same", "c": "same"}
    catalog = store.Catalog(spark, root)
    before = catalog.version()
    (folder / "a.txt").write_text("other")
    os.utime(folder / "a.txt", (1, 1))
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("d")
    assert states() == {"a": "changed", "b": "deleted", "c": "same", "d": "new"}
    assert catalog.version() != before and {r.file_path[-5] for r in catalog.table("indexed_files").collect()} == set("acd")


def test_a_mark_made_during_a_sync_stays(spark, tmp_path):
    from graphloom.streaming.sync import Marks, sync, sync_if_marked

    folder, root = tmp_path / "src", f"file://{tmp_path}/cat"
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    marks = Marks(spark, root)
    assert marks.seen() == [] and sync_if_marked(spark, str(folder), root) is None and store.Catalog(spark, root).version() is None
    first = {marks.make(), marks.make()}
    assert set(marks.seen()) == first
    late = []

    def busy(*args):
        states = sync(*args)
        (folder / "b.txt").write_text("b")
        late.append(marks.make())
        return states

    assert [r.state for r in sync_if_marked(spark, str(folder), root, busy).collect()] == ["new"]
    assert marks.seen() == late

    def failing(*_):
        raise OSError("gone")

    with pytest.raises(OSError):
        sync_if_marked(spark, str(folder), root, failing)
    assert marks.seen() == late
    assert {r.file_path[-5]: r.state for r in sync_if_marked(spark, str(folder), root).collect()} == {"a": "same", "b": "new"}
    assert marks.seen() == [] and sync_if_marked(spark, str(folder), root) is None


def test_equal_sets_of_ids(spark):
    a, b = (spark.createDataFrame([(x, 1) for x in ids], "id string, n int") for ids in (["x", "y"], ["y", "x"]))
    assert incremental.same_ids(a, b) and not incremental.same_ids(a, b.limit(1)) and not incremental.same_ids(a.limit(0), b)


def test_tests_that_a_change_reaches(spark):
    g = graph(spark, [("p.A", "CLASS", "src/main/java/p/A.java"), ("p.ATest", "CLASS", "src/test/java/p/ATest.java"), ("p.BTest", "CLASS", "src/test/java/p/BTest.java")], [("USES_TYPE", "p.ATest", "p.A")])
    found = traverse.impact(g, "p.A", 1)
    assert [r.id for r in impact.tests_reached(g, found).collect()] == ["p.ATest"]


def test_rollup_of_what_a_change_may_break(spark):
    nodes = [(f"p.A{n}", "AGGREGATE", "src/main/java/p/A.java") for n in range(5)] + [("p.E", "DOMAIN_EVENT", None)]
    nodes += [("p.S", "SERVICE", "S.java"), ("p.C", "CONTROLLER", "C.java"), ("p.K1", "CLASS", "K.java"), ("p.K2", "CLASS", "K.java"), ("p.ATest", "AGGREGATE", "src/test/java/p/ATest.java")]
    g = graph(spark, nodes, [("USES_TYPE", "p.S", "p.A1")])
    found = spark.createDataFrame([(i,) for i, _, _ in nodes] + [("p.S",), ("p.gone",), (None,)], "id string")
    rows = sorted(tuple(r) for r in impact.guard_rollup(g, found, 3).collect())
    assert rows == [
        ("other", 1, "CLASS", 2, 0), ("other", 2, "CONTROLLER", 1, 0), ("other", 3, "SERVICE", 1, 0),
        ("significant", 1, "p.A0", 1, 3), ("significant", 2, "p.A1", 1, 3), ("significant", 3, "p.A2", 1, 3), ("test", 1, "", 1, 0),
    ]
    assert impact.guard_rollup(g, found.limit(0)).count() == 0


def test_a_batch_that_starts_tables_anew(spark, tmp_path):
    catalog = store.Catalog(spark, str(tmp_path))
    tables = {n: spark.range(k).toDF("id") for n, k in (("nodes", 3), ("edges", 4), ("co_change", 5))}
    catalog.batch(tables)
    catalog.batch(store.truncated({n: catalog.table(n) for n in tables}, ["edges", "co_change"]))
    assert {n: catalog.table(n).count() for n in tables} == {"nodes": 3, "edges": 0, "co_change": 0}
    assert catalog.table("edges").columns == ["id"]


def test_labels_of_code_blocks(spark):
    rows = spark.createDataFrame([("a/B.java", "java"), ("x.ts", "typescript"), ("run.sh", "bash"), ("v1.sql", "sql"), ("README.md", "java"), ("none", "java"), (None, "java")], "path string, want string")
    assert rows.where(ids.fence_language("path") != F.col("want")).count() == 0


def test_mermaid_text_opens_and_closes_each_package(spark, tmp_path):
    g = graph(spark, [("p.A", "CLASS", "A.java"), ("q.B", "CLASS", "B.java")], [("USES_TYPE", "p.A", "q.B")])
    export.write_mermaid(export.mermaid_rows(g.nodes, g.edges, spark.createDataFrame([("p.A", "p"), ("q.B", "q")], "id string, package string")), str(tmp_path / "m"))
    lines = [line for f in sorted((tmp_path / "m").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "graph LR" and sum(line.startswith("  subgraph") for line in lines) == lines.count("  end") == 2
    assert sum("-->" in line for line in lines) == 1 and lines[-1].startswith("  classDef")
    inside = [n for n, line in enumerate(lines) if "subgraph" in line or line == "  end"]
    assert ["subgraph" in lines[n] for n in inside] == [True, False, True, False]


def test_a_batch_that_comes_second_fails_and_leaves_the_first(spark, tmp_path):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    one, other = (store.Catalog(spark, f"file://{tmp_path}/p") for _ in range(2))
    first = one.batch({"t": known})
    other._newest = lambda: 0  # it began before the first ended
    with pytest.raises(RuntimeError):
        other.batch({"t": known.limit(0)})
    assert one.version() == first and one.table("t").count() == 1


def test_packages_of_deeply_nested_types_and_cyclic_supertypes(spark):
    from graphloom.operators import dead, packages, resolve
    from graphloom.operators.graph import CodeGraph

    names = ["p.q.T0"]
    for k in range(1, 20):
        names.append(f"{names[-1]}.T{k}")
    nodes = spark.createDataFrame([(n, "CLASS", n, n, "T0.java", 1, "", 0) for n in names], schema.NODES)
    edges = spark.createDataFrame([("EXTENDS", "p.q.T0", "p.q.T0.T1"), ("EXTENDS", "p.q.T0.T1", "p.q.T0"), ("INJECTS", "x", "p.q.T0")], schema.EDGES)
    g = CodeGraph(nodes, edges)
    assert {r.package for r in packages.with_package(g).collect()} == {"p.q"}
    assert {r.id for r in dead.live_subtypes(g).collect()} == {"p.q.T0", "p.q.T0.T1"}
    chain = [(f"C{k}", f"C{k + 1}") for k in range(15)] + [("C15", "C0")]
    supers = spark.createDataFrame(chain, "source_id string, target_id string")
    methods = spark.createDataFrame([("C14#m()", "C14", "m")], "id string, owner string, name string")
    calls = spark.createDataFrame([("one", "C0", "m", 0), ("none", "C0", "absent", 0)], "call string, receiver string, name string, n int")
    assert [tuple(r) for r in resolve.bind_through_supertypes(calls, methods, supers).collect()] == [("one", "C14#m()")]


def test_reply_of_very_short_lines_is_whole(spark):
    rows = spark.range(20_000).select(F.format_string("%06d", "id").alias("k"), F.lit("x").alias("line"))
    assert export.fitting(rows, ["k"], "line", budget=40_000).count() == 20_000


def test_reply_budget(spark):
    rows = spark.createDataFrame([(f"{k:03d}", "x" * 9) for k in range(100)], "k string, line string")
    assert export.fitting(rows, ["k"], "line", budget=105).count() == 10


def test_components_by_contraction_equal_union_find(spark):
    """Random links, a long path, a hub, and ids without a node; scrambling has a way back, so that no two nodes get one number."""
    rnd = random.Random(3)
    pairs = [(f"r{rnd.randrange(300)}", f"r{rnd.randrange(300)}") for _ in range(200)]
    pairs += [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [("a-gone", "x1"), ("a-gone", "x2"), ("alone", "alone")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    ids = sorted({x for p in pairs for x in p} - {"a-gone"}) + ["single"]
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    edges = spark.createDataFrame([("CALLS", a, b) for a, b in pairs], "type string, source_id string, target_id string")
    found = {(r.id, r.root) for r in traverse.components(CodeGraph(nodes, edges)).collect()}
    assert found == {(x, find(x)) for x in ids}
    numbers = spark.range(2000).select(F.expr("id * 8589934592 div 7").alias("n"))
    there = numbers.select("n", traverse._scrambled(F.col("n"), 4).alias("s"))
    assert there.select("s").distinct().count() == 2000
    assert there.where(traverse._unscrambled(F.col("s"), 4) != F.col("n")).count() == 0
    assert traverse.components(CodeGraph(nodes, edges.limit(0))).where("id <> root").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packages_do_not_move_nodes_by_their_package(spark):
    """All nodes of a package would meet in one task; only distinct packages that are types are joined, by broadcast."""
    from graphloom.operators import packages

    g = graph(spark, [("p.A", "CLASS", "A.java"), ("p.A.B", "CLASS", "A.java"), ("p.A.B.C", "CLASS", "A.java"), ("p.A.B.C.D", "CLASS", "A.java"), ("p.D#m()", "METHOD", "D.java")], [])
    out = packages.with_package(g)
    assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
    assert {r.id: r.package for r in out.collect()} == {"p.A": "p", "p.A.B": "p", "p.A.B.C": "p", "p.A.B.C.D": "p", "p.D#m()": "p"}


def test_search_leaves_nodes_in_place_where_little_is_found(spark):
    g = graph(spark, [(x, "CLASS", "a") for x in "abc"], [("CALLS", "a", "b"), ("CALLS", "a", "gone")])
    found = traverse.search(g, spark.createDataFrame([("a",)], "id string"), 1, "out")
    assert "BroadcastHashJoin [id" in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("b", 1)]


def test_pairs_sort_a_commit_once_and_join_nothing(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "a"), (2, "b"), (3, "a"), (None, "a"), (None, "b"), (4, "a"), (4, "b"), (4, "c"), (4, "d")]
    out = cochange.pairs(spark.createDataFrame(rows, "commit int, file string"), 3)
    assert "Join" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [("a", "b", 2)]


def test_exports_move_neither_nodes_nor_edges(spark):
    from graphloom.operators import packages
    from graphloom.operators.graph import CodeGraph

    rows = [(i, "CLASS", i, i, f"{i}.java", 1, "", 0) for i in ("p.A", "p.B", "q.C")] + [("p.B", "ENTITY", "again", "p.B", "p.B.java", 2, "", 0)]
    nodes = spark.createDataFrame(rows, schema.NODES)
    edges = spark.createDataFrame([("INJECTS", "p.A", "p.B"), ("INJECTS", "p.A", "x.Gone"), ("INJECTS", "x.Gone", "p.A"), ("EXTENDS", "q.C", "p.A")], schema.EDGES)
    placed = packages.with_package(CodeGraph(nodes, edges), "name")
    before = nodes.join(placed.select("id", "package"), "id")
    node_lines = sorted(f"  [{r.name}] as {r.id.replace('.', '_')} <<{r.type}>>" for r in before.collect())
    got = export.plantuml_rows(placed, edges)
    assert sorted(r.line for r in got.where("section = 1").collect()) == node_lines and len(node_lines) == 6
    assert sorted(r.line for r in got.where("section = 2").collect()) == ["p_A --> p_B : INJECTS", "q_C --> p_A : EXTENDS"]
    assert sorted(r.line for r in export.mermaid_rows(placed, edges).where("section = 2").collect()) == ["  p_A -->|INJECTS| p_B", "  q_C -->|EXTENDS| p_A"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_id" not in plan and "hashpartitioning(target_id" not in plan


@pytest.mark.parametrize("odd", ["repeats and nulls", "a part of two brands", "keys below zero"])
def test_search_reads_the_tables_and_builds_no_graph(spark, tmp_path, odd):
    """Levels are met in the tables by numbers, equal to the search of the stored graph; keys that give no numbers are searched there."""
    from graphloom.plans import queries as plans
    from graphloom.sources import star

    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    line = t["lineitem"]
    if odd == "repeats and nulls":
        again = line.where("l_orderkey % 3 = 2").withColumn("l_partkey", F.col("l_partkey") + 1).withColumn("l_quantity", F.lit(50.0))
        null = line.where("l_orderkey < 40").withColumn("l_suppkey", F.lit(None).cast("bigint"))
        t["lineitem"] = line.unionAll(again).unionAll(null).unionAll(line.limit(5).withColumn("l_orderkey", F.lit(None).cast("bigint"))).unionAll(line.limit(5).withColumn("l_suppkey", F.lit(10**9)))
        t["part"] = t["part"].unionAll(t["part"]).unionAll(t["part"].limit(2).withColumn("p_partkey", F.lit(None).cast("bigint")))
    elif odd == "a part of two brands":
        t["part"] = t["part"].unionAll(t["part"].withColumn("p_brand", F.lit("Brand#99")))
    else:
        t["lineitem"] = line.unionAll(line.where("l_orderkey = 8").withColumn("l_linenumber", -F.col("l_linenumber")))
    d = str(tmp_path)
    for n, df in t.items():
        df.write.parquet(f"{d}/{n}.parquet")
    got = sorted((r.id, r.depth) for r in plans.QUERIES["impact_d2"](spark, d).collect())
    built = any(k[1] == d for k in star._graphs)
    assert built == (odd != "repeats and nulls")
    g = CodeGraph(*star.graph(spark, d))
    want = sorted((r.id, r.depth) for r in traverse.search(g, spark.createDataFrame([(plans.ORDER,)], "id string"), 2, "both").collect())
    assert got == want and len(got) > 20
