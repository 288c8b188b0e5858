"""Exact top-k, vector codes and phrases against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import random as plain_random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import codes, phrases, topk

VECTORS = "vec_id bigint, embedding array<float>, label int"


def usable(rows):
    return [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def odd_rows(dims):
    return [(9000, None, 1), (9100, [math.nan] * dims, 1), (9200, [math.inf] + [0.0] * (dims - 1), 1), (9300, [None] * dims, 1)]


# --- exact top-k -----------------------------------------------------------------


def brute_top(rows, every, k):
    out = Counter()
    kept = sorted({(i, v) for i, v, _ in usable(rows) if i is not None})
    for i, v in kept:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    return out


def top(df, **kw):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df, **kw).collect())


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_topk_is_exact(spark, spread, monkeypatch):
    random = np.random.default_rng(3)
    x = random.normal(size=(900, 12)) * np.exp(spread * random.normal(size=900))[:, None]
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    rows += [(2000 + n, (x[5] * (1 + 1e-3 * n)).tolist(), 1) for n in range(40)] + [(3000 + n, x[7].tolist(), 1) for n in range(60)]  # near copies and copies
    rows += [*odd_rows(12), (None, x[1].tolist(), 1), (4000, [0.0] * 12, 1), (4100, [1.0, 2.0], 1), (4101, [3.0, 1.0], 1), (4200, [], 1), (5, x[5].tolist(), 2), (100, x[3].tolist(), 1), (5, x[6].tolist(), 1)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("x")).withColumn("bar", F.lit(1)).withColumn("d", F.lit(0))
    want = brute_top(rows, 50, 10)
    assert top(table, every=50) == want
    monkeypatch.setattr(topk, "BLOCK_BYTES", 700)  # several blocks of queries
    monkeypatch.setattr(topk, "LEAST_ROWS", 100)
    monkeypatch.setattr(topk, "SEEDS", 30)
    monkeypatch.setattr(topk, "COORDINATE", 0.3)  # coordinates prune for most
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert top(table, every=50) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_topk_of_few_none_and_wide_numbers(spark):
    few = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], VECTORS)
    assert top(few) == Counter([(0, 1, 1, 1024 * 2048)])
    assert topk.top_products(few.limit(0)).count() == 0
    assert topk.top_products(few.where("vec_id = 1")).count() == 0  # no query
    assert topk.top_products(few.where("vec_id = 0")).count() == 0  # no candidate
    random = np.random.default_rng(4)
    rows = [(n, (random.normal(size=4) * 2.0**17).tolist(), 1) for n in range(50)]  # products above 2**53
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows]
    best = sorted((-sum(a * b for a, b in zip(kept[0][1], w)), j) for j, w in kept[1:])[:10]
    assert top(table) == Counter((0, n + 1, j, -s) for n, (s, j) in enumerate(best))
    with pytest.raises(Exception, match="64 bits"):
        topk.top_products(spark.createDataFrame([(0, [1e17], 1), (1, [1e17], 1)], "vec_id bigint, embedding array<double>, label int")).collect()


def test_local_thresholds_choose_the_pruning(monkeypatch):
    """A query whose bar is near takes coordinates, another lengths, a third nothing; all find the same as the full product."""
    random = np.random.default_rng(5)
    y = (random.normal(size=(500, 8)) * 1000).astype(np.int64)
    x = np.array([y[(y**2).sum(axis=1).argmax()], y[4] // 50, y[5] // 1000])
    every = x @ y.T
    bar = np.array([every[0].max(), every[1].mean(), 10 * np.abs(every[2]).max() + 1e9])
    calls = []
    for name in ("_by_coordinate", "_by_length"):
        whole = getattr(topk.Block, name)
        monkeypatch.setattr(topk.Block, name, lambda self, best, who, *a, f=whole, n=name: calls.append((n, who.tolist())) or f(self, best, who, *a))
    best = topk.Best(bar.astype(float), 600)
    topk.Block(np.arange(3), np.full(3, -1), x, bar.astype(float)).search(best, np.arange(500), y)
    assert dict(calls) == {"_by_coordinate": [0], "_by_length": [1]}
    assert sorted(zip(best.q, best.vec)) == sorted((q, j) for q in range(3) for j in range(500) if every[q, j] >= bar[q])


# --- vector codes ----------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    out = {}
    kept = usable(rows)
    for d in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == d]
        cut = [c.tolist() for c in np.array_split(np.arange(d), parts)]
        first = {}
        for i, v, _ in own:
            first[i] = min(first.get(i, v), v)
        ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
        books = [[[first[i][j] for j in c] for i in ids] for c in cut]

        def near(v, p):
            x = [v[j] for j in cut[p]]
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))

        for _ in range(rounds):
            fresh = []
            for p in range(parts):
                groups = defaultdict(list)
                for _, v, _ in own:
                    groups[near(v, p)[1]].append([v[j] for j in cut[p]])
                fresh.append([[sum(c) // len(groups[n]) for c in zip(*groups[n])] if groups[n] else e for n, e in enumerate(books[p])])
            books = fresh
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in own:
            found = [near(v, p) for p in range(parts)]
            out.setdefault((i, label, "".join(f"{n:02x}" for _, n in found), sum(s for s, _ in found), sha), []).append(1)
    return Counter({k: len(v) for k, v in out.items()})


@pytest.mark.parametrize("dims", [8, 6])
def test_codes_match_brute_force(spark, dims, monkeypatch):
    random = np.random.default_rng(dims)
    monkeypatch.setattr(codes, "BLOCK", 50)
    monkeypatch.setattr(codes, "STEP", 16)
    x = random.normal(size=(300, dims))
    rows = [(1000 - n, v.tolist(), int(n % 3) if n % 5 else None) for n, v in enumerate(x)]
    rows += [(5000 + n, x[0].tolist(), 7) for n in range(90)]  # copies under one label
    rows += [(710, x[9].tolist(), 1), rows[3], rows[3], (None, x[2].tolist(), None), (None, x[4].tolist(), 1), *odd_rows(dims), (1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1), (3, [], 1)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).repartition(5)
    got = codes.with_label_error(codes.compress(table, entries=16)).collect()
    want = brute_codes(rows, 4, 16, 4)
    per_label = Counter()
    for (_, label, _, error, _), n in want.items():
        per_label[label] += n * error
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sum((Counter({(i, c, e, per_label[label], s): n}) for (i, label, c, e, s), n in want.items()), Counter())


def test_codes_of_few_and_none(spark):
    table = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 5.0], None)], VECTORS)
    got = codes.with_label_error(codes.compress(table)).collect()
    assert {r.code for r in got} == {"00000000"} and len(got) == 2
    assert codes.with_label_error(codes.compress(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        codes.compress(table, entries=257)
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e12], 1), (2, [-1e12], 1)], "vec_id bigint, embedding array<double>, label int"), parts=1)


def test_sums_merge_in_any_grouping():
    random = np.random.default_rng(6)
    each = [([random.integers(-9, 9, (4, 3))], [random.integers(0, 9, 4)]) for _ in range(5)]
    left = None
    for e in each:
        left = codes.merge(left, e)
    pairs = codes.merge(codes.merge(each[0], codes.merge(each[1], None)), codes.merge(codes.merge(each[2], each[3]), each[4]))
    assert all((a == b).all() for a, b in zip(left[0] + left[1], pairs[0] + pairs[1]))


# --- phrases ---------------------------------------------------------------------


def brute_phrases(texts, top, least, most, cover):
    f, n = defaultdict(Counter), Counter()
    for text, lang in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                longer = [b for q, b in c.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
                if all(100 * b < cover * a for b in longer):
                    kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.add((lang, rank + 1, p.decode(), -a, l, r, n[lang], -s))
    return out


def made_texts():
    random = plain_random.Random(7)
    words = ["the", "cat", "Sat", "on", "mat", "é", "日本", "x y", "a-b", "..", "big", "red"]
    texts = []
    for _ in range(260):
        body = " ".join(random.choices(words, weights=[9, 5, 4, 4, 3, 2, 2, 2, 2, 3, 2, 2], k=random.randint(0, 40)))
        texts.append((body.replace(" on", random.choice([" on", ", on", "\non", "\ton"])), random.choice(["en", "en", "en", "de", None])))
    return texts + [(None, "en"), ("", "fr"), ("...!?", "fr"), (" \t ", None), ("New York City", "en")] + [("New York City is big", "en")] * 30


def listed(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 3, 5])
def test_phrases_match_brute_force(spark, most, monkeypatch):
    texts = made_texts()
    table = spark.createDataFrame(texts, "text string, lang string").withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).withColumn("shard", F.lit(0)).repartition(3)
    got = phrases.collocations(table, top=60, most=most)
    assert listed(got) == brute_phrases(texts, 60, 10, most, 50) and got.count() == len(listed(got))
    # small shards, chunks and key ranges, and texts longer than a shard
    monkeypatch.setattr(phrases, "SHARD", 97)
    monkeypatch.setattr(phrases, "CHUNK", 160)
    monkeypatch.setattr(phrases, "RANGE", 500)
    long = " ".join(t or "" for t, _ in texts[:100])
    texts.append((long, "en"))
    table = spark.createDataFrame(texts, "text string, lang string").repartition(2)
    assert listed(phrases.collocations(table, top=60, most=most)) == brute_phrases(texts, 60, 10, most, 50)


def test_phrases_without_texts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("", None), (None, "en")], "text string, lang string")).count() == 0


def test_suffix_array_and_intervals_count_ngrams():
    random = np.random.default_rng(8)
    for most in (1, 2, 3, 4, 6):
        s = random.integers(0, 5, 400).astype(np.int32)
        own = 350
        for n, (begin, count) in enumerate(phrases.intervals(s, own, most), 1):
            grams = Counter(tuple(s[i : i + n]) for i in range(own) if i + n <= len(s) and (s[i : i + n] > 0).all())
            assert {tuple(s[b : b + n]): c for b, c in zip(begin, count)} == grams and len(begin) == len(grams)


def test_counts_of_any_size_travel_whole():
    count = np.array([1, 254, 255, 256, 2**40, 3])
    assert phrases.unpacked_counts(phrases.packed_counts(count), 6).tolist() == count.tolist()
