"""The full-text index, resolution through chains and supertypes, many-start search, contains joins and covers, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.extract import index
from graphloom.functions import text as T
from graphloom.operators import contains, impact, resolve, search, traverse
from graphloom.operators.graph import CodeGraph
from graphloom.operators.store import Catalog
from graphloom.operators.textindex import TextIndex
from graphloom.sources import git

# --- full-text index ---------------------------------------------------------------

WORDS = ["red", "Red-Widget", "größe", "Grosse", "Müller", "muller", "áb", "áb", "x_y", "café9", "re", "widgets", "ring"]
NODE = "id string, name string, qualified_name string, code_snippet string"
QUERIES = ["red", "re", "red widget", "red-widget", "muller", "MÜLLER", "ab", "größe ring*", "widget-ring re", "x-y", "ring ring", "re-red-widget", "!?", ""]


def rows_of(r, ids):
    return [(i, r.choice(WORDS), ".".join(r.choices(WORDS, k=2)), r.choice([None, " ".join(r.choices(WORDS, k=6))])) for i in ids]


def matches(spark, rows, query):
    return {r.id for r in search.full_text(spark.createDataFrame(rows, NODE), query).collect()}


def test_index_finds_what_a_scan_finds(spark):
    rows = rows_of(random.Random(1), [f"n{k}" for k in range(60)])
    idx = TextIndex.build(spark.createDataFrame(rows, NODE))
    for q in QUERIES:
        assert {r.id for r in idx.search(q).collect()} == matches(spark, rows, q), q
    assert {r.id for r in idx.search("MULLER").collect()} == {r.id for r in idx.search("müller").collect()} != set()


@pytest.mark.parametrize("seed", [2, 3])
def test_index_stays_in_step_with_upserts_and_deletions(spark, tmp_path, seed):
    r = random.Random(seed)
    known = {row[0]: row for row in rows_of(r, [f"n{k}" for k in range(30)])}
    idx = TextIndex.build(spark.createDataFrame(list(known.values()), NODE))
    for _ in range(3):
        new = rows_of(r, r.sample([f"n{k}" for k in range(40)], 8))
        gone = r.sample(sorted(known), 4)
        idx = idx.upsert(spark.createDataFrame(new, NODE)).delete(spark.createDataFrame([(g,) for g in gone], "id string"))
        known |= {row[0]: row for row in new}
        for g in gone:
            known.pop(g, None)
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.batch(idx.tables())
    again = TextIndex.of_tables({n: catalog.table(n) for n in idx.tables()})
    task = "widget rings of re muller"
    want = {tuple(x) for x in search.seeds(spark.createDataFrame(list(known.values()), NODE), task).collect()}
    for i in (idx, idx.compact(), again, again.upsert(spark.createDataFrame([known[min(known)]], NODE))):
        for q in ("red", "red-widget", "re", "ring widget"):
            assert {x.id for x in i.search(q).collect()} == matches(spark, list(known.values()), q), q
        assert {tuple(x) for x in i.seeds(task).collect()} == want and i.has_seed(task)
    assert not idx.has_seed("of the and") and not idx.has_seed("zzzz")


def test_index_of_nothing_and_of_a_long_task(spark):
    idx = TextIndex.build(spark.createDataFrame([], NODE))
    assert idx.search("red").count() == 0 and idx.seeds("red widget").count() == 0
    some = [("a", "word7", "q.word7", "word70 word100"), (None, "word7", "x", None)]
    long = " ".join(f"word{k}" for k in range(130))  # more terms than a mask holds
    got = TextIndex.build(spark.createDataFrame(some, NODE)).seeds(long).collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in search.seeds(spark.createDataFrame(some[:1], NODE), long).collect()]


def test_index_prunes_by_token(spark):
    idx = TextIndex.build(spark.createDataFrame(rows_of(random.Random(4), ["a", "b"]), NODE))
    plan = idx.search("red rin")._jdf.queryExecution().toString()
    assert "StringStartsWith(token,rin)" in plan and "EqualTo(token,red)" in plan


def test_folding_is_that_of_unicode(spark):
    letters = "àÉîõüÿçñǖệžß日ø"
    assert spark.range(1).select(T.tokens(F.lit(letters))).first()[0] == T.plain_tokens(letters) == ["aeiouycnuezß日ø"]


# --- chained calls -------------------------------------------------------------------

CHAINS = """package p;
class A { B b(C c) { return null; } }
class B { C c() { return null; } D two(int x) { return null; } D two(long x) { return null; } }
class C { D d() { return null; } A y() { return null; } }
class D { void e() { } void c() { } }
class Use {
  private A a;
  private C x;
  void nested() { a.b(x.y()).c(); }
  void deep() { a.b(x).c().d().e(); }
  void several() { a.b(x).two(1).e(); }
  void plain() { x.d(); }
}
"""


def test_chained_calls_follow_nesting_and_any_depth(spark):
    files = spark.createDataFrame([("p/A.java", "java", CHAINS, 1)], "file_path string, language string, content string, last_modified bigint")
    calls = {(r.source_id, r.target_id) for r in index.build(files)["edges"].where("type = 'CALLS'").collect()}
    of = lambda m: {t for s, t in calls if s == f"p.Use#{m}()"}
    assert of("nested") == {"p.A#b(C)", "p.C#y()", "p.B#c()"}
    assert of("deep") == {"p.A#b(C)", "p.B#c()", "p.C#d()", "p.D#e()"}
    assert of("several") == {"p.A#b(C)", "p.B#two(int)", "p.B#two(long)"}  # two methods give no receiver


def test_chain_of_calls_through_supertypes(spark):
    calls = spark.createDataFrame([("1", None, "S", "m", 0), ("2", "1", None, "n", 0), ("3", "2", None, "o", 0), ("4", "3", None, "m", 0), ("5", "9", None, "m", 0)], "call string, parent string, receiver string, name string, n int")
    methods = spark.createDataFrame([("T#m()", "T", "m"), ("U#n()", "U", "n"), ("U#o()", "U", "o")], "id string, owner string, name string")
    supers = spark.createDataFrame([("S", "T"), ("V", "U"), ("T", "S")], "source_id string, target_id string")
    returns = spark.createDataFrame([("T#m()", "V"), ("U#n()", "V")], "method_id string, class_id string")
    assert {tuple(r) for r in resolve.bind_chains(calls, methods, supers, returns).collect()} == {("1", "T#m()"), ("2", "U#n()"), ("3", "U#o()")}


def test_chains_read_the_methods_once_whatever_the_height_of_the_types(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    height = 6
    supers = spark.createDataFrame([(f"C{k}", f"C{k + 1}") for k in range(height)] + [(f"C{height}", "C0")], "source_id string, target_id string")
    methods = spark.createDataFrame([(f"C{height}#m()", f"C{height}", "m"), ("C3#o(int)", "C3", "o"), ("C3#o(long)", "C3", "o")], "id string, owner string, name string")
    methods = methods.mapInPandas(counted, methods.schema)
    calls = spark.createDataFrame([("1", None, "C0", "m", 0), ("2", "1", None, "m", None), ("3", "2", None, "o", 1), ("4", "3", None, "m", 0), ("5", None, "C4", "o", -1)], "call string, parent string, receiver string, name string, n int")
    returns = spark.createDataFrame([(f"C{height}#m()", "C1"), ("C3#o(int)", "C1")], "method_id string, class_id string")
    bound = resolve.bind_chains(calls, methods, supers, returns)
    assert sorted(tuple(r) for r in bound.collect()) == [("1", f"C{height}#m()"), ("2", f"C{height}#m()"), ("3", "C3#o(int)"), ("3", "C3#o(long)")]
    assert read.value == 3
    single = resolve.bind_through_supertypes(calls.where("receiver IS NOT NULL"), methods, supers)
    assert [tuple(r) for r in single.select("call", "method").collect()] == [("1", f"C{height}#m()")]
    assert read.value == 6


# --- inherited member types ------------------------------------------------------------


def brute_inherited(asked, supers, ids):
    out = set()
    for t, name in asked:
        been, level = {t}, [b for a, b in supers if a == t and b != t]
        while level:
            level = sorted(set(level) - been)
            been |= set(level)
            found = {f"{s}.{name}" for s in level} & ids
            if found:
                out.add((t, name, found.pop() if len(found) == 1 else None))
                break
            level = [b for a, b in supers if a in level]
    return out


def test_inherited_members_match_brute_force(spark):
    r = random.Random(5)
    types = [f"t{k}" for k in range(12)]
    supers = [(r.choice(types), r.choice(types)) for _ in range(18)]
    ids = {f"{t}.{n}" for t in types for n in "xyz" if r.random() < 0.25}
    asked = [(t, n) for t in types for n in "xyzw"]
    got = resolve.inherited_members(spark.createDataFrame(asked + asked[:3], "type string, name string"), spark.createDataFrame(supers, "source_id string, target_id string"), spark.createDataFrame([(i,) for i in ids], "id string"))
    assert {tuple(x) for x in got.collect()} == brute_inherited(asked, supers, ids) and got.count() == len(brute_inherited(asked, supers, ids))
    assert got.where("member IS NULL").count() > 0


INHERITED = """package p;
interface First { class Part { } class Only { } }
interface Second { class Part { } }
class Base implements First { class Deep { } }
class Both extends Base implements Second { Only only() { return null; } Deep deep() { return null; } Part part() { return null; } }
class Mine extends Both { class Part { } Part part() { return null; } class Inner { Deep deep() { return null; } } }
"""


def test_names_resolve_through_supertypes(spark):
    files = spark.createDataFrame([("p/Base.java", "java", INHERITED, 1)], "file_path string, language string, content string, last_modified bigint")
    edges = {(r.source_id, r.target_id) for r in index.build(files)["edges"].where("type = 'RETURNS_TYPE'").collect()}
    assert ("p.Both", "p.First.Only") in edges and ("p.Both", "p.Base.Deep") in edges  # a level up before two
    assert ("p.Both", "p.Second.Part") in edges  # Second is nearer than First, which is a level above Base
    assert ("p.Mine", "p.Mine.Part") in edges and ("p.Mine.Inner", "p.Base.Deep") in edges


def test_an_ambiguous_name_resolves_to_nothing(spark):
    types = spark.createDataFrame([(i, "CLASS", i.rsplit(".", 1)[-1], f) for i, f in [("p.A", "a"), ("p.B", "b"), ("p.C", "c"), ("p.A.X", "a"), ("p.B.X", "b"), ("p.X", "d")]], "id string, type string, name string, file_path string")
    refs = spark.createDataFrame([("c", "p.C", "X"), ("e", "p.E", "X")], "file_path string, owner string, target string")
    none = spark.createDataFrame([], "file_path string, name string, target string")
    packages = spark.createDataFrame([("c", "p"), ("e", "p")], "file_path string, name string")
    supers = spark.createDataFrame([("p.C", "p.A"), ("p.C", "p.B")], "source_id string, target_id string")
    got = resolve.type_names(refs, types, none, none, packages, supers)
    assert {(r.owner, r.resolved) for r in got.collect()} == {("p.E", "p.X")}


# --- many starts -------------------------------------------------------------------------


def random_graph(spark, seed, n=14, m=26):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(n)]
    rows = [(i, r.choice(["CLASS", "METHOD", "LIBRARY"]), i, i, "src/A.java", 1, "", 0) for i in names]
    edges = list({(r.choice(["DECLARES_METHOD", "CALLS", "INJECTS"]), r.choice([*names, "gone"]), r.choice([*names, "gone"])) for _ in range(m)})
    return CodeGraph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(edges, schema.EDGES)), names, edges


@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_many_starts_equal_single_searches(spark, direction):
    g, names, _ = random_graph(spark, direction)
    some = names[:3]
    starts = spark.createDataFrame([(s, s) for s in some], "start string, id string")
    for leaf, allowed in ((True, None if direction == "in" else ["CALLS", "DECLARES_METHOD"]),):
        got = {(r.start, r.id, r.depth) for r in traverse.search_many(g, starts, 2, direction, leaf, allowed).collect()}
        want = {(s, r.id, r.depth) for s in some for r in traverse.search(g, spark.createDataFrame([(s,)], "id string"), 2, direction, leaf, allowed).collect()}
        assert got == want


def test_allowed_types_are_those_of_a_smaller_graph(spark):
    g, names, edges = random_graph(spark, 8)
    kept = [e for e in edges if e[0] in ("CALLS", "DECLARES_METHOD")]
    small = CodeGraph(g.nodes, spark.createDataFrame(kept, schema.EDGES))
    start = spark.createDataFrame([("n0",)], "id string")
    assert {tuple(r) for r in traverse.search(g, start, 3, "both", allowed_types=["CALLS", "DECLARES_METHOD"]).collect()} == {tuple(r) for r in traverse.search(small, start, 3, "both").collect()}


def test_dependents_of_a_type_are_types_and_callers_of_its_methods(spark):
    nodes = [("A", "CLASS"), ("A#m()", "METHOD"), ("A#k()", "METHOD"), ("B", "CLASS"), ("B#x()", "METHOD"), ("C", "CLASS"), ("C#y()", "METHOD")]
    edges = [("DECLARES_METHOD", "A", "A#m()"), ("DECLARES_METHOD", "A", "A#k()"), ("DECLARES_METHOD", "B", "B#x()"), ("DECLARES_METHOD", "C", "C#y()"), ("INJECTS", "B", "A"), ("CALLS", "C#y()", "A#m()"), ("CALLS", "A#k()", "A#m()")]
    g = CodeGraph(spark.createDataFrame([(i, t, i, i, "f", 1, "", 0) for i, t in nodes], schema.NODES), spark.createDataFrame(edges, schema.EDGES))
    each = impact.dependents_each(g, spark.createDataFrame([("A",), ("A#m()",), ("A",)], "id string"), 1)
    assert {tuple(r) for r in each.collect()} == {("A", "B"), ("A", "C#y()"), ("A", "A#k()"), ("A#m()", "C#y()"), ("A#m()", "A#k()")}
    assert {r.id for r in impact.dependents(g, "A", 1).collect()} == {"B", "C#y()", "A#k()"}


# --- contains ------------------------------------------------------------------------------


def test_contains_join_matches_brute_force(spark):
    r = random.Random(6)
    texts = [(k, "".join(r.choices("aab/ é\n😀", k=r.randint(0, 60)))) for k in range(80)] + [(90, None), (91, "")]
    needles = [(k, "".join(r.choices("aab/ é", k=r.randint(1, 7)))) for k in range(40)] + [(90, None), (91, ""), (92, "a.b"), (93, "aaaaaaaaaaaaaaaaaaaaaaa"), (94, "/"), (94, "/")]
    t, n = spark.createDataFrame(texts + texts[:2], "text_id int, text string"), spark.createDataFrame(needles, "needle_id int, needle string")
    want = {(i, j) for i, a in texts for j, b in needles if a and b and b in a}
    got = contains.containing(t, n)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert {tuple(x) for x in contains.least_contained(t, n).collect()} == {(i, min(j for k, j in want if k == i)) for i, _ in want}
    assert contains.containing(t, n.limit(0)).count() == 0 and contains.containing(t.limit(0), n).count() == 0


def test_contains_join_compares_no_text_with_each_needle(spark):
    t, n = spark.createDataFrame([(1, "abcdef")], "text_id int, text string"), spark.createDataFrame([(1, "bcde")], "needle_id int, needle string")
    plan = contains.containing(t, n)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_routes_and_injections(spark):
    services = spark.createDataFrame([("S", "get('/orders/1')"), ("T", "x"), ("U", None)], "id string, code_snippet string")
    controllers = spark.createDataFrame([("c1", "OrderController"), ("c2", "Other")], "id string, name string")
    assert {tuple(r) for r in contains.api_calls(services, controllers).collect()} == {("S", "c1")}
    components = spark.createDataFrame([("C", "a = inject(S); b = inject(Sx)"), ("D", "inject( S )")], "id string, content string")
    assert {tuple(r) for r in contains.injections(components, spark.createDataFrame([("S", "S"), ("q", "T")], "id string, name string")).collect()} == {("C", "S")}


# --- hunks and spans -------------------------------------------------------------------------


def test_cover_by_a_union_of_spans(spark):
    r = random.Random(7)
    spans = [(f"s{k}", r.choice("fg"), b, b + r.randint(0, 4)) for k in range(14) for b in [r.randint(1, 40)]]
    hunks = [(r.choice("fgh"), b, b + r.randint(0, 5)) for _ in range(60) for b in [r.randint(0, 40)]]
    got = impact.covered_hunks(spark.createDataFrame(hunks, "path string, begin_b int, end_b int"), spark.createDataFrame(spans, "id string, path string, begin int, end int"))
    want = set()
    for p, b, e in hunks:
        own = [(x, y) for _, q, x, y in spans if q == p]
        want.add((p, b, e, all(any(x <= n <= y for x, y in own) for n in range(b + 1, e + 1)) if e > b else any(x <= b and b + 1 <= y for x, y in own)))
    assert {tuple(x) for x in got.collect()} == want and {w[3] for w in want} == {True, False}


def test_hunk_over_two_methods_and_innermost_type(spark):
    nodes = [("A", "CLASS"), ("A.In", "CLASS"), ("A#m()", "METHOD"), ("A#n()", "METHOD"), ("A#gone()", "METHOD")]
    nodes = spark.createDataFrame([(i, t, i, i, "A.java", 1, "", 0) for i, t in nodes], schema.NODES)
    kind = "id string, path string, begin int, end int"
    spans = spark.createDataFrame([("A#m()", "A.java", 4, 6), ("A#n()", "A.java", 7, 9)], kind)
    types = spark.createDataFrame([("A", "A.java", 2, 30), ("A.In", "A.java", 12, 20)], kind)

    def changed(hunks, parsed=None):
        files = spark.createDataFrame([("A.java", "changed", hunks)], "path string, state string, hunks array<struct<begin_b:int,end_b:int>>")
        return {tuple(r) for r in git.changed_symbols(files, nodes, spans, types, parsed).collect()}

    assert changed([(4, 8)]) == {("A#m()", "modified"), ("A#n()", "modified")}  # lines 5 to 8
    assert changed([(13, 14)]) == {("A.In", "modified")}
    assert changed([(21, 22)]) == {("A", "modified")}
    assert changed([(0, 1)]) == {("A", "modified"), ("A.In", "modified")}  # around no type: all of the file
    assert changed([(6, 6)]) == {("A", "modified")}  # a deletion between the two methods
    parsed = spark.createDataFrame([("A#m()",), ("A#n()",)], "id string")
    assert changed([(4, 5)], parsed) == {("A#m()", "modified"), ("A#gone()", "removed")}


def test_paths_in_quotes_are_read_back(spark, tmp_path):
    (tmp_path / "log").write_text('\x01c1\t10\n"src/\\303\\244.java"\n"a\\"b\\\\c.java"\nplain é.java\n')
    assert [r.file for r in git.history(spark, str(tmp_path / "log")).collect()] == ["src/ä.java", 'a"b\\c.java', "plain é.java"]
    (tmp_path / "diff").write_text('diff --git "a/src/\\303\\244.java" "b/src/\\303\\244.java"\n--- "a/src/\\303\\244.java"\n+++ "b/src/\\303\\244.java"\n@@ -1 +1 @@\n-a\n+b\n')
    assert [(r.path, len(r.hunks)) for r in git.diff(spark, str(tmp_path / "diff")).collect()] == [("src/ä.java", 1)]


# --- declarations ------------------------------------------------------------------------------


def test_declarations_and_supertype_clauses(spark):
    from graphloom.functions import declarations

    cases = [
        ("/** doc {\n * more\n */\n@A(v = { \"x;\" })\npublic class C<T extends Money & Low<A, B>> extends Base<X, Y> implements I, J<K, L> permits P {\n int x;\n}", "a.java",
         "@A(v = { \"x;\" })\npublic class C<T extends Money & Low<A, B>> extends Base<X, Y> implements I, J<K, L> permits P", ["Base<X, Y>"], ["I", "J<K, L>"]),
        ("// one\nint f(String s = \"a\\\"{\", char c = '{');\nrest", "a.java", "int f(String s = \"a\\\"{\", char c = '{');", [], []),
        ("record R(int a, Map<K, V> extendsNot)\n   implements   I  ,\n J { }", "R.java", "record R(int a, Map<K, V> extendsNot)\n   implements   I  ,\n J", [], ["I", "J"]),
        ("class A extends B:\n  x = {", "a.py", "class A extends B:\n  x = {", [], []),
        ("class Uni😀 extends Bö {", "a.ts", "class Uni😀 extends Bö", ["Bö"], []),
        ("class A \"unclosed { ;", "a.java", "class A \"unclosed { ;", [], []),
        ("/* one line */\n\n  class A with M, N implements Q {", "l.dart", "class A with M, N implements Q", [], ["Q"]),
        ("class A\r\n  implements B {", None, "class A\n  implements B", [], ["B"]),
        (None, "a.java", "", [], []), ("", "a.java", "", [], []),
    ]
    table = spark.createDataFrame([(s, p) for s, p, *_ in cases], "s string, p string").coalesce(1)
    s, p = F.col("s"), F.col("p")
    got = table.select(declarations.declaration(s, p).alias("d"), declarations.supertype_clause(s, p, "extends").alias("e"), declarations.supertype_clause(s, p, "implements").alias("i")).collect()
    assert [(r.d, list(r.e), list(r.i)) for r in got] == [(d, e, i) for _, _, d, e, i in cases]


def test_declarations_are_cut_once_a_snippet_by_no_fold_over_characters(spark):
    import random

    from graphloom.functions import declarations

    s, p = F.col("s"), F.col("p")
    df = spark.createDataFrame([("class A extends B {", "a.java")], "s string, p string")
    cut = df.select(declarations.declaration(s, p).alias("d"), declarations.supertype_clause(s, p, "extends").alias("e"), declarations.supertype_clause(s, p, "implements").alias("i"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 2  # each text is cut once and marked once for all three columns

    def slow(text):
        depth, quote, escaped = 0, "", False
        for at, c in enumerate(text):
            if quote:
                quote, escaped = (quote if escaped or c != quote else ""), (not escaped and c == "\\")
            elif c in "\"'":
                quote = c
            elif depth <= 0 and c in "{;":
                return at + (c == ";")
            else:
                depth += (c == "(") - (c == ")")
        return -1

    chance = random.Random(5)
    for _ in range(2000):
        text = "".join(chance.choices("a\"'\\(){;\n", [6, 1, 1, 1, 2, 2, 1, 1, 1], k=chance.randint(0, 30)))
        assert declarations.cut_at(text) == slow(text)


def test_first_rows_and_how_many_more(spark):
    rows = [("a", n) for n in range(7)] + [("b", 1), (None, 3), (None, 4)]
    got = search.first_and_more(spark.createDataFrame(rows, "k string, n int"), ["k"], [F.desc("n")], 2)
    assert {tuple(r) for r in got.where("k IS NOT NULL").select("k", "n", "rank", "more").collect()} == {("a", 6, 1, 5), ("a", 5, 2, 5), ("b", 1, 1, 0)}


def test_names_in_snake_case(spark):
    from graphloom.functions import ids

    names = ["OrderLineItem", "HTTPServer", "aB1C", "ABC", "x"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(ids.snake_case("n")).collect()] == ["order_line_item", "http_server", "a_b1_c", "abc", "x"]


def test_a_segment_is_sorted_runs_and_moves_no_posting(spark):
    """A word is stored beside its token only if it has accents; each run lies in the order of tokens."""
    from graphloom.operators import textindex

    made = textindex.postings(spark.createDataFrame([("a", "zeta Größe alpha"), ("b", "Alpha beta")], "id string, text string"), ("text",), "id", 0)
    assert {(r.token, r.word) for r in made.collect()} == {("zeta", None), ("große", "größe"), ("alpha", None), ("beta", None)}
    run = textindex.sorted_segment(made.coalesce(1))
    assert [r.token for r in run.collect()] == ["alpha", "alpha", "beta", "große", "zeta"]
    assert len(run.inputFiles()) == 1


@pytest.mark.parametrize("tested", [False, True])
def test_context_of_numbers_with_repeated_rows_equals_that_of_texts(spark, tested):
    chance, low = random.Random(11), 255
    types = [(n << 8, f"p.T{n}", chance.choice(["SERVICE", "CONTROLLER", "LIBRARY"]), f"src/{chance.choice(['main', 'main', 'test'])}/T{n}.java", chance.choice(["red widget", "blue", "caf\u00e9 r\u00e9d"])) for n in range(30)]
    methods = [(t[0] | k, f"{t[1]}#m{k}()", "METHOD", "src/test/x.java" if tested and k == 2 else "src/main/x.java", "") for t in types for k in (1, 2)]
    every = [*types, *methods]
    nodes = [(n, i, kind, i.split(".")[-1], i, path, code) for n, i, kind, path, code in every]
    edges = [("CALLS_METHOD", chance.choice(methods), chance.choice(types)) for _ in range(150)] + [("INJECTS", chance.choice(types), chance.choice(types)) for _ in range(40)] + [("DECLARES_METHOD", t, m) for t in types for m in methods if m[0] - t[0] in (1, 2)]
    numbered = [(k, a[0], b[0], (k == "INJECTS") | (a[0] & low) << 1 | (b[0] & low) << 9) for k, a, b in edges] + [("INJECTS", 99 << 8, types[0][0], 1)]
    shape = "type string, name string, qualified_name string, file_path string, code_snippet string"
    g = CodeGraph(spark.createDataFrame([x[1:] for x in nodes], f"id string, {shape}"), spark.createDataFrame({(k, a[1], b[1]) for k, a, b in edges}, "type string, source_id string, target_id string"))
    n = CodeGraph(spark.createDataFrame([(x[0], *x[2:]) for x in nodes + nodes[30:50]], f"id bigint, {shape}"), spark.createDataFrame(numbered + numbered[:60], "type string, source_id bigint, target_id bigint, tag bigint"))
    columns = ["id", "type", "file_path", "keywords_matched", "typed_matched", "score"]
    want = search.context(g, "red widgets", 8, index=TextIndex.build(g.nodes)).select(columns).collect()
    got = search.context(n, "red widgets", 8, owner_of=lambda c: c.bitwiseAND(F.lit(~low)), calls="CALLS_METHOD", shown="qualified_name", near=low).select(columns).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_the_ranked_queries_write_neither_the_graph_nor_an_index_of_it(spark, monkeypatch):
    from graphloom.plans import queries
    from graphloom.sources import star

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, search.context(CodeGraph(*star.graph(spark, d)), queries.TASK, index=star.text_index(spark, d)).collect()))
    for name in ("graph", "text_index"):
        monkeypatch.setattr(star, name, lambda *_: pytest.fail("stored"))
    assert sorted(map(tuple, queries.context_files(spark, d).collect())) == want
    assert queries.ppr_20(spark, d).count() == star.nodes(spark, d).count()
