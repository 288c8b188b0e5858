"""Histories and diffs as tables."""

from graphloom import schema
from graphloom.operators import cochange
from graphloom.sources import git

LOG = "\x01c3\t30\n\nA.java\nB.java\n\x01c2\t20\n\x01c1\t10\n\nA.java\nB.java\n\"C d.java\"\n"
DIFF = """diff --git a/src/A.java b/src/A.java
index 1..2 100644
--- a/src/A.java
+++ b/src/A.java
@@ -3 +3 @@ class A {
-  old
+  diff --git a/not b/not
@@ -8,2 +7,0 @@ void m() {
-  gone
-  gone
@@ -20,0 +19,3 @@
+a
+b
+c
diff --git a/src/B.ts b/src/B.ts
deleted file mode 100644
--- a/src/B.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
diff --git a/old.sh b/new.sh
similarity index 100%
rename from old.sh
rename to new.sh
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+a
+b
"""


def test_history_gives_coupling(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    found = git.history(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, found.collect())) == [("c1", 10, "A.java"), ("c1", 10, "B.java"), ("c1", 10, "C d.java"), ("c3", 30, "A.java"), ("c3", 30, "B.java")]
    assert {(r.file_a, r.file_b): r["count"] for r in cochange.pairs(cochange.recent(found)).collect()} == {("A.java", "B.java"): 2, ("A.java", "C d.java"): 1, ("B.java", "C d.java"): 1}


def test_diff_gives_files_hunks_and_symbols(spark, tmp_path):
    (tmp_path / "diff").write_text(DIFF)
    files = git.diff(spark, str(tmp_path / "diff"))
    got = {r.path: (r.state, [tuple(h) for h in r.hunks]) for r in files.collect()}
    assert got == {"src/A.java": ("changed", [(2, 3), (7, 7), (18, 21)]), "src/B.ts": ("deleted", [(0, 0)]), "new.sh": ("changed", []), "n.py": ("added", [(0, 2)])}
    rows = [("A", "CLASS", "src/A.java"), ("A#m()", "METHOD", "src/A.java"), ("A#n()", "METHOD", "src/A.java"), ("B", "FE_CLASS", "src/B.ts"), ("new.sh", "SHELL_SCRIPT", "new.sh"), ("Z", "CLASS", "Z.java")]
    nodes = spark.createDataFrame([(i, t, i, i, p, 1, "", 0) for i, t, p in rows], schema.NODES)
    kind = "id string, path string, begin int, end int"
    spans = [("A#m()", "src/A.java", 2, 9), ("A#n()", "src/A.java", 12, 18)]
    found = git.changed_symbols(files, nodes, spark.createDataFrame(spans, kind))
    assert {tuple(r) for r in found.collect()} == {("B", "removed"), ("A#m()", "modified"), ("A", "modified"), ("new.sh", "modified")}
    inside = git.changed_symbols(files, nodes, spark.createDataFrame([("A#m()", "src/A.java", 2, 30)], kind))
    assert {tuple(r) for r in inside.collect()} == {("B", "removed"), ("A#m()", "modified"), ("new.sh", "modified")}
