"""The pipeline on a small corpus with planted cases, stage by stage."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random = np.random.default_rng(11)
    words = [f"v{i}x" for i in range(2000)]
    rows, marks = [], []
    for n in range(200):
        body = [" ".join(random.choice(words, 12)).capitalize() + "." for _ in range(8)]
        if n % 10 == 0:
            body[4] = "You vilest of the vilest."
        rows.append((n, "\n".join(body), "en", f"src{n % 3}", None))
        marks.append((n, 1, int(n % 10 == 0)))
    rows += [(1000 + k, rows[1][1], "en", "src0", None) for k in range(3)]  # copies
    rows.append((1100, rows[2][1].replace("v7x", "v8x") + " One more.", "en", "src0", None))
    passage = "\n".join(" ".join(random.choice(words, 20)) for _ in range(4))
    rows += [(1200 + k, "\n".join(" ".join(random.choice(words, 15)) for _ in range(3)) + "\n" + passage, "en", "src0", None) for k in range(3)]
    rows += [(1300, None, None, None, None), (1301, "", "en", "src0", 0)]
    d = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, passage


def test_stages(spark, folder):
    import corpus_pipeline as P

    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    stage = dict(P.STAGES)
    kept = stage["toxicity"](spark, docs, d)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == names and ids == {i for i, *_ in rows if not (i < 200 and i % 10 == 0)}
    lined = stage["line dedup"](spark, kept, d)
    text = {r.doc_id: r.text for r in lined.collect()}
    assert lined.columns == names and set(text) == ids
    assert passage in text[1200] and not any(x in text[1201] for x in passage.split("\n")) and text[1300] is None
    deduped = stage["simhash near-dedup"](spark, kept, d)
    left = {r.doc_id for r in deduped.collect()}
    assert deduped.columns == names and {1000, 1001, 1002, 1100, 1301} & left == set()
    assert ids - left == {1000, 1001, 1002, 1100, 1301}  # the empty text is like the null one
    packed = stage["best-fit packing"](spark, deduped, d).collect()
    assert {r.doc_id for r in packed} == left


def test_run(spark, folder):
    import corpus_pipeline as P

    rows = P.run(spark, folder[0]).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names


def test_near_copies_are_those_of_brute_force(spark):
    import corpus_pipeline as P

    random = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        base = random.choice(words, 120)
        for edits in (0, 1, 2, 3, 4, 5):
            copy = base.copy()
            copy[random.choice(120, edits, replace=False)] = "new"
            rows.append((n, " ".join(copy)))
            n += 1
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i // 6 * 6, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i} and 60 < len(kept) < 300


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_run_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_repeated_rows_nulls_and_columns_with_inner_names(spark, tmp_path):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c d e f g", "en", "s", 7), (1, "a b c d e f g", "en", "s", 7), (2, "other words in this text, all of them", "en", "s", 9), (None, "a b c d e f g", None, None, None), (3, "a b c d e f g", "en", "s", 7)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    for name in ("_row", "_gone", "set", "node", "a", "b", "root", "least", "_y", "score", "dense"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids = sorted((r.doc_id or 0) for r in kept.collect())
        assert ids == ([0, 1, 1, 2] if "simhash" in name else [0, 1, 1, 2, 3]), name
        docs = kept
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in packed) == [0, 1, 1, 2] and len({r.sequence_id for r in packed}) == 1
