"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, katz, lines, neighbours, packing, sampling, simhash, toxicity, urls

DOC = "doc_id bigint, text string, lang string"
LONG = " ".join(f"word{i % 977}" for i in range(9000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog", "en"),
    (2, "the cat sat on the mat and looked at the dog", "en"),
    (3, "", "en"),
    (4, None, "de"),
    (5, LONG, "en"),
    (6, LONG + " end", "en"),
    (7, "one", None),
    (8, "x y", "fr"),
    (None, "the cat sat on the mat and looked at the dog", "en"),
    (9, "a b c\n\nd e f\ng h i", "en"),
    (9, "a b c\n\nd e f\ng h i", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- BPE -------------------------------------------------------------------------


def test_bpe_matches_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    own = bpe.model_of(open(bpe.default_path(), encoding="utf-8").read())
    samples = [t or "" for _, t, _ in TEXTS] + ["It's <|endoftext|>we'll GO<|startoftext|>", "ΣΑΣ İstanbul é e\u0301", "a\x1cb\x85c\u3000d!!?", "日本語 текст १२३ 😀😀", "'s'", "\ud7ff " * 3, "x" * 3000]
    for s in samples:
        want = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == want, s[:40]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_cuts_all_kinds_of_code_points_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(bpe.default_path())
    with open(bpe.default_path(), encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    newer = {c for a, b in (*bpe.NEWER_LETTERS, *bpe.NEWER_DIGITS) for c in (*range(a, min(b, a + 40) + 1), b)} | set(bpe.LOWER)
    some = [c for c in sorted(newer | set(range(0, 0x3000)) | set(range(0x3000, 0x110000, 37))) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b1{chr(c)} !{chr(c)}{chr(c)}" for c in some]
    for text, expected in zip(texts, known.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == expected.ids, text


def test_bpe_digests(docs, empty):
    import hashlib

    own = bpe.model_of(open(bpe.default_path(), encoding="utf-8").read())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs).collect())
    want = Counter()
    for i, t, _ in TEXTS:
        ids = own.encode(t or "")
        want[(i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), own.decode(ids))))] += 1
    assert got == want
    assert bpe.round_trip_digests(empty).count() == 0


# --- packing ---------------------------------------------------------------------


def test_packing_places_every_piece_once(spark, docs, empty):
    rows = packing.pack_documents(docs, capacity=64, keep_ids=True).collect()
    own = bpe.model_of(open(bpe.default_path(), encoding="utf-8").read())
    want = sum(len(own.encode(t or "")) + 1 for _, t, _ in TEXTS)
    assert sum(r.length for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert max(filled.values()) <= 64
    assert len(filled) <= -(-want // 64) + 1
    whole = packing.sequences(packing.pack_documents(docs, capacity=64, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == want
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_rows_repeated_in_full(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 4)
    rows = [(7, "one and the same text " * 3, "x")] * 37 + [(7, "one and the same text " * 3, "y")] * 2 + [(None, None, "z")] * 9 + [(8, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string").withColumn("length", F.lit("n")).withColumn("_copies", F.lit(1))
    got = packing.pack_documents(docs, capacity=16).collect()
    own = bpe.model_of(open(bpe.default_path(), encoding="utf-8").read())
    want = Counter()
    for doc_id, text, _ in rows:
        ids = own.encode(text or "") + [1]
        for n, at in enumerate(range(0, len(ids), 16)):
            part = ids[at : at + 16]
            want[doc_id, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 16


def test_plan_is_best_fit():
    def one_by_one(lengths, capacity):
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(capacity - n)
        return len(rooms)

    random = np.random.default_rng(3)
    for _ in range(50):
        lengths = random.integers(1, 40, random.integers(1, 300)).tolist()
        runs = packing.plan(Counter(lengths), 40)
        used, placed = {}, Counter()
        for length, first, n, seq, offset, each in runs:
            for t in range(n):
                used.setdefault(seq + t // each, []).append((offset + t % each * length, length))
                placed[length] += 1
        assert placed == Counter(lengths)
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 40
        assert len(used) == one_by_one(lengths, 40)


# --- SimHash ---------------------------------------------------------------------


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    for r in simhash.fingerprints(docs, 3).collect():
        text = next(t for i, t, _ in TEXTS if i == r.doc_id)
        assert r.fp & (2**64 - 1) == brute_fingerprint(text, 3)


@pytest.mark.parametrize(("most", "groups", "dense"), [(0, None, 16), (3, None, 16), (3, (4,), 0), (7, (4,), 16), (7, (6,), 1), (8, (8,), 16)])
def test_links_join_what_brute_force_joins(spark, most, groups, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "SMALL", 8)
    random = np.random.default_rng(5)
    centres = random.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for n, c in enumerate(centres):
        for _ in range(150 if n == 0 else 6):  # one dense group
            x = int(c)
            for b in random.integers(0, 64, random.integers(0, most + 2)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    rows = [(n, f - 2**64 if f >= 2**63 else f) for n, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node bigint, fp bigint")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    from graphloom.llm.components import components

    found = {r.node: r.root for r in components(simhash.links(nodes, most, groups)).collect()}
    assert all(found.get(i, i) == find(i) for i in range(len(fps)))


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)})
    nodes = spark.createDataFrame([(n, f) for n, f in enumerate(fps)], "node bigint, fp bigint")
    monkeypatch.setattr(simhash, "BLOCK", 100)
    from graphloom.llm.components import components

    found = components(simhash.links(nodes, 3)).collect()
    assert len(found) == len(fps) and {r.root for r in found} == {0}


def test_near_components_and_keep_one(docs, empty):
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_components(docs, 3, 3).collect())
    assert got[(2, 1)] == 1 and got[(1, 1)] == 1 and got[(4, 3)] == 1 and got[(9, 9)] == 2 and got[(None, None)] == 1
    assert simhash.near_components(empty, 3, 3).count() == 0


def test_a_very_long_text_has_its_fingerprint():
    assert simhash.fingerprint(LONG * 4, 3) == brute_fingerprint(LONG * 4, 3)


def test_keep_one_each_cases(spark, docs, empty):
    more = docs.withColumn("set", F.lit("s")).withColumn("node", F.lit(1)).withColumn("least", F.lit(0))  # names of inner columns
    got = simhash.keep_one_each(more, 5, 0.8)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == more.columns and kept.count(9) == 2 and None in kept
    assert sorted(x for x in kept if x and x != 9) == [1, 3, 5, 7, 8]  # 2 is 1 again, 4 is empty like 3, 6 is 5 and a word
    assert simhash.keep_one_each(empty, 5, 0.8).count() == 0


@pytest.mark.parametrize("dense", [0, 16])
def test_keep_one_each_is_brute_force_in_a_dense_group(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "SMALL", 4)
    random = np.random.default_rng(13)
    words = [f"w{i}" for i in range(3000)]
    base = random.choice(words, 200)
    rows = []
    for n in range(150):  # all like the base, many not like each other
        copy = base.copy()
        copy[random.choice(200, random.integers(0, 6), replace=False)] = random.choice(words)
        rows.append((n * 7 % 150, " ".join(copy)))
    rows += [(200 + n, " ".join(random.choice(words, 200))) for n in range(150)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i < 200 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    kept = {r.doc_id for r in simhash.keep_one_each(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC), 5, 0.8).collect()}
    assert kept == {i for i in root if root[i] == i} and len(kept) < 290


def test_components_of_a_long_path(spark):
    from graphloom.llm.components import components

    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(n, 0) for n in range(201)}
    assert components(links.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark, empty):
    random = np.random.default_rng(1)
    clean = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for n in range(400):
        text = [" ".join(random.choice(clean, 12)).capitalize() + "." for _ in range(6)]
        bad = n % 5 == 0
        if bad:
            text[3] = "You " + random.choice(["vilest", "foulness"]) + " " + " ".join(random.choice(clean, 5)) + "."
        rows.append((n, " ".join(text), "en"))
        marks.append((n, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, "en"), (1000, "", "en"), (1001, "So foul, the vilest of all.", "en")], DOC)
    labels = spark.createDataFrame([*marks, (5, 1), (7, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for n, bad in marks:
        if n % 4 == 2:
            assert (got[n].score >= 0.3) == bool(bad)
            assert len(got[n].offending) == bad
    assert got[1000].score < 0.3 and got[None].score < 0.3 and got[1001].score >= 0.3
    spot = got[10].offending[0]
    text = rows[10][1]
    assert text[spot.start : spot.end].strip().startswith("You ")
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.3}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_without_one_kind_of_label_has_one_score(spark):
    docs = spark.createDataFrame([(1, "A b. " * 500, "en"), (2, "", "en"), (3, "C d.", "en")], DOC)
    kind = "doc_id bigint, toxic int"
    for marks in ([], [(1, 0), (3, 0)], [(1, 1)], [(1, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(marks, kind))
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert max(scores) < 0.02 and max(scores) - min(scores) < 1e-6
        assert toxicity.keep_clean(docs, model).count() == 3


def test_toxicity_finds_the_one_sentence_of_a_very_long_text(spark):
    random = np.random.default_rng(4)
    clean = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for n in range(200):
        text = [" ".join(random.choice(clean, 9)) + "." for _ in range(400 if n % 20 == 0 else 5)]
        if n % 4 == 0:
            text[-1] = "You vilest."  # beyond any prefix of the long ones
        rows.append((n, " ".join(text), "en"))
        marks.append((n, int(n % 4 == 0)))
    docs = spark.createDataFrame([*rows, *rows[:8]], DOC).withColumn("_h", F.lit("x")).withColumn("_y", F.lit("y")).withColumn("score", F.lit("z"))
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 208 and all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in got)
    assert {len(r.offending) for r in got if r.doc_id % 4 == 0} == {1}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 208 - 52


# --- URL rules -------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [0, 100])
def test_rules_of_one_short_prefix_are_told_apart_by_their_digests(spark, broadcast, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 1)
    monkeypatch.setattr(urls, "BROADCAST", broadcast)
    rules = [(f"h{n}.org", "/", "block") for n in range(0, 60, 2)]  # 30 rules, 16 prefixes
    pages = spark.createDataFrame([(n, f"http://h{n}.org/x") for n in range(60)], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {n: ((f"h{n}.org/", "block") if n % 2 == 0 else (None, "allow")) for n in range(60)}



def test_url_rules(spark):
    cases = [
        ("http://A.example.com/en/x", "example.com/en/", "block"),
        ("http://www.Example.com/en/x?q", "www.example.com/en/", "allow"),
        ("https://example.com", None, "allow"),
        ("https://example.com/", "com/", "allow"),
        ("https://notexample.com/en/", "com/", "allow"),
        ("https://x.net/es/1#a", "net/es/", "block"),
        ("https://x.net/est/1", None, "allow"),
        ("https://x.net:80/es/1", None, "allow"),
        ("x.net/es/1", None, "allow"),
        (None, None, "allow"),
        ("http://a://x.com/", None, "allow"),
        ("https://x.net/fr/1", "net/fr/", "block"),
        ("https://x.net/fr/1", "net/fr/", "block"),
        ("https://" + "a." * 2000 + "com/" + "b/" * 5000, "com/", "allow"),
    ]
    pages = spark.createDataFrame([(n, u, "mine") for n, (u, _, _) in enumerate(cases)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(cases)
    for n, (u, rule, verdict) in enumerate(cases):
        assert (got[n].rule, got[n].verdict) == (rule, verdict), u
    assert got[0].host == "a.example.com" and got[0].path == "/en/x" and got[2].path == "" and got[9].host == ""
    assert urls.judge(pages.limit(0)).count() == 0


# --- lines -----------------------------------------------------------------------


def brute_lines(rows):
    seen, out = {}, {}
    for i, text in sorted(((i, t) for i, t in rows if t is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        split = text.split("\n")
        full = [n for n, x in enumerate(split) if x.strip(" ")]
        gone = set()
        for k in range(len(full) - 2):
            win = tuple(split[n].strip(" ") for n in full[k : k + 3])
            if win in seen:
                fi, fk = seen[win]
                gone.update(full[m] for m in range(max(k, fk + 3) if fi == i else k, k + 3))
            else:
                seen[win] = (i, k)
        out[i] = "\n".join(x for n, x in enumerate(split) if n not in gone)
    return out


def test_line_dedup(spark):
    random = np.random.default_rng(2)
    rows = [(n, "\n".join(random.choice(["a", "b", " c", "", "d ", "e"], random.integers(0, 25)))) for n in range(120)]
    rows += [(500, None), (501, ""), (502, "x\nx\nx\nx\nx\nx"), (503, "q\nr"), (504, "\n".join(f"l{i % 50}" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, _at string")
    got = {r.doc_id: r.text for r in lines.dedupe(docs).collect()}
    want = brute_lines(rows)
    assert got[500] is None and len(got) == len(rows)
    for i, t in want.items():
        assert got[i] == t, i
    assert lines.dedupe(docs).columns == docs.columns
    assert lines.dedupe(docs.limit(0)).count() == 0


def test_line_dedup_of_null_ids_repeated_rows_and_carriage_returns(spark):
    text = "one\ntwo\nthree\nown"
    rows = [(None, text), (1, text + " 1"), (1, text + " 1"), (2, text.replace("\n", "\r\n")), (3, "one\n\n two \nthree")]
    got = Counter((r.doc_id, r.text) for r in lines.dedupe(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)).collect())
    # a null id comes first; rows repeated in full are one document; "one" and a carriage return is another line
    assert got == Counter({(None, text): 1, (1, "own 1"): 2, (2, text.replace("\n", "\r\n")): 1, (3, ""): 1})


# --- chat ------------------------------------------------------------------------


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "so"), (0, 3, "assistant", "good"), (1, 0, "user", "hey"), (1, 1, "assistant", "bad"), (2, 0, None, None), (2, 0, None, None)]
    talks = chat.conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in chat.preference(chat.with_last_of_partner(talks)).collect()}
    r = got[0]
    assert r.n_prompt_turns == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nso<|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "good"
    a, b = map(int, r.rejected_mask.split("-"))
    assert r.rejected[a:b] == "bad"
    assert got[2].n_prompt_turns == 2 and got[2].chosen == ""
    pairs = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b"), ("assistant", "c")], None, "x")], "k int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    one = chat.preference(pairs).first()
    assert one.prompt == "" and one.rejected == "" and one.k == 1
    assert [one.chosen[slice(*map(int, s.split("-")))] for s in one.chosen_mask.split(",")] == ["b", "c"]


def test_preference_of_empty_long_and_repeated_conversations(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    assert chat.preference(chat.with_last_of_partner(chat.conversations(spark.createDataFrame([], kind)))).count() == 0
    long = "word " * 50_000
    turns = [(4, n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(2000)] + [(5, 0, "assistant", long)] + [(6, 1, "user", "tie"), (6, 1, "assistant", "tie")] * 2
    turns += [(None, 0, "user", "no id")]
    got = {r.conv_id: r for r in chat.preference(chat.with_last_of_partner(chat.conversations(spark.createDataFrame(turns, kind)))).collect()}
    assert got[4].n_prompt_turns == 1999 and got[4].rejected == f"<|assistant|>\n{long}<|end|>\n"
    a, b = map(int, got[4].rejected_mask.split("-"))
    assert got[4].rejected[a:b] == long
    assert got[6].n_prompt_turns == 3 and None in got


# --- sampling --------------------------------------------------------------------


def test_weighted_sampling_estimates_generalised_jaccard(spark):
    random = np.random.default_rng(4)
    vocabulary = [f"t{i}" for i in range(60)]
    rows = [(n, " ".join(random.choice(vocabulary, random.integers(20, 200), p=np.arange(1, 61) / 1830))) for n in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    got = {r.doc_id: r.fingerprint for r in sampling.fingerprints(docs, 128).collect()}
    bags = {i: Counter(t.split()) for i, t in rows}
    errors = []
    for i in range(40):
        for j in range(i):
            want = sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values())
            same = np.mean([got[i][k : k + 8] == got[j][k : k + 8] for k in range(0, 1024, 8)])
            errors.append(same - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_production_samples_tell_half_alike_texts_from_near_ones(spark):
    # pairs that share 20 of 30 words each: a Jaccard similarity of 0.5; the deviation is 0.125 with 16 samples, 0.088 with 32
    pairs = [([f"p{n}s{k}" for k in range(20)], n) for n in range(600)]
    rows = [(2 * n + side, " ".join(shared + [f"p{n}o{side}x{k}" for k in range(10)]), "x") for shared, n in pairs for side in (0, 1)]
    got = {r.doc_id: r.fingerprint for r in sampling.fingerprints(spark.createDataFrame(rows, DOC)).collect()}
    alike = [np.mean([got[2 * n][k : k + 8] == got[2 * n + 1][k : k + 8] for k in range(0, len(got[0]), 8)]) for n in range(600)]
    assert abs(np.mean(alike) - 0.5) < 0.02 and np.sqrt(np.mean((np.array(alike) - 0.5) ** 2)) < 0.1


def test_edited_fingerprints(spark, empty):
    rows = [(n, f"text {n} " + " ".join(f"w{(n * 7 + k) % 50}" for k in range(n % 60))) for n in range(0, 300, 3)] + [(7, None), (8, ""), (11, "ä" * 10)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    got = {r.doc_id: r for r in sampling.edited_fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    own = {r.doc_id: r.fingerprint for r in sampling.fingerprints(docs).collect()}
    import hashlib

    assert len(got) == len(rows)
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[i].fingerprint == own[i]
        same = np.mean([own[i][x : x + 8] == own[j][x : x + 8] for x in range(0, len(own[i]), 8)])
        assert got[i].near_next == pytest.approx(same)
    assert sampling.edited_fingerprints(empty).count() == 0


def brute_sample(text, n):
    """The samples of a text by their definition, in plain Python."""
    import re
    import struct

    mask = (1 << 64) - 1

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def uniform(h, shift):
        return ((h >> shift & (1 << 25) - 1) + 0.5) * 2.0**-25

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    counts = Counter(xxhash.xxh64_intdigest(w.encode(), 42) & ~1 for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w)
    out = []
    for k in range(n):
        best = None
        for h, count in counts.items():
            first = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
            a, b = (xxhash.xxh64_intdigest(struct.pack("<i", 2 * k + x), first) for x in (0, 1))
            r, c = -math.log(uniform(a, 0) * uniform(a, 25)), math.log(-math.log(uniform(b, 0) * uniform(b, 25)))
            beta = ((a >> 50 ^ b >> 50 << 14) + 0.5) * 2.0**-28
            t = math.floor(math.log(count) / r + beta)
            name = (a ^ b >> 13 ^ (t << 9 & mask) ^ (t << 23 & mask)) & 0xFFFFFFFF
            best = min(x for x in (best, (signed(int((c - r * (t - beta) - r + 1000) * 2**20) << 32 & mask), name)) if x)
        out.append(best[1] if best else 0xFFFFFFFF)
    return out


def test_edited_fingerprints_are_those_of_their_definition(spark):
    """With null, repeated and outlying ids, one id with a third of the rows, and empty and long texts."""
    random = np.random.default_rng(3)

    def words():
        return " ".join(f"W{x}" for x in random.integers(0, 40, random.integers(1, 30)))

    rows = [(n, words()) for n in range(40)] + [(7, words()) for _ in range(40)] + [(None, words()), (None, None), (2**61, words()), (-5, ""), (50, LONG), (51, " \t "), (3, "same"), (3, "same")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).withColumn("_bucket", F.lit(1)).withColumn("n_chars", F.lit("x"))
    texts = [(i, t or "") for i, t in rows]

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return (1, 0) if row[0] is None else (0, -row[0]), h - (1 << 64) if h >> 63 else h

    order = sorted(texts, key=place)
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        own, edited, after = (brute_sample(x, sampling.SAMPLES) for x in (t, t[: len(t) - k] + nxt[:k], nxt))
        want[i, len(t), "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in edited), float(np.mean(np.equal(own, edited))), float(np.mean(np.equal(own, after)))] += 1
    got = Counter((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in sampling.edited_fingerprints(docs).collect())
    assert got == want


def test_edited_fingerprint_of_one_row(spark):
    one = sampling.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f", "x")], DOC)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# --- neighbours ------------------------------------------------------------------


def test_neighbours_recall_and_edges(spark, monkeypatch):
    random = np.random.default_rng(6)
    x = random.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    rows += [(3000 + n, x[7].tolist(), 1) for n in range(100)]  # copies
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9020, [math.nan] * 16, 1), (9040, [1.0, None] * 8, 1), (9060, [1.0], 1), (None, x[1].tolist(), 1), (5, x[5].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(table, search=1500).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.concatenate([np.arange(3000), 3000 + np.arange(100)])
    y = np.concatenate([x, np.repeat(x[7:8], 100, axis=0)]).astype(np.float64)
    hit = 0
    queries = ids[ids % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        s = y @ y[np.nonzero(ids == q)[0][0]]
        s[ids == q] = -9
        top = ids[np.lexsort((ids, -s))[:20]]
        assert sorted(got[q]) == list(range(1, 21))
        hit += len(set(top) & {v for v, _ in got[q].values()})
    assert hit / (20 * len(queries)) >= 0.9
    assert [v for v, _ in (got[3000][k] for k in range(1, 21))] == [7, *range(3001, 3020)]
    monkeypatch.setattr(neighbours, "BUCKET", 40)  # leaves are split, and queries take turns
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    again = {}
    for r in neighbours.nearest(table, search=1500).collect():
        again.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert again == got
    few = neighbours.nearest(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_neighbours_of_double_vectors_of_two_dimensions_and_of_repeated_ids(spark):
    random = np.random.default_rng(16)
    rows = [(n, (1 + 1e-9 * random.normal(size=8)).tolist(), "a") for n in range(60)] + [(100 + n, random.normal(size=5).tolist(), "b") for n in range(30)]
    rows.append((0, (-np.ones(8)).tolist(), "c"))  # id 0 has two vectors
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rep string").withColumn("leaf", F.lit(1)).withColumn("rank", F.lit("x"))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table).collect())
    want = Counter()
    for q, v, _ in rows:
        if q % 20 == 0:
            others = {(-float(np.dot(v, w)), i) for i, w, _ in rows if i != q and len(w) == len(v)}
            once = sorted(others)[:20]
            for n, (s, i) in enumerate(once):
                want[q, n + 1, i] += 1
                assert any(k[:3] == (q, n + 1, i) and abs(k[3] + s) < 1e-12 for k in got), (q, n, i)
    assert Counter(k[:3] for k in got.elements()) == want


def test_neighbours_of_ids_with_several_near_vectors(spark):
    random = np.random.default_rng(17)
    rows = [(n, random.normal(size=6).tolist()) for n in range(60)]
    rows += [(0, (np.array(rows[0][1]) + 1e-3 * j).tolist()) for j in (1, 2)] + [(7, random.normal(size=6).tolist()), (20, rows[3][1])]
    got = Counter((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    want = Counter()
    for q, v in rows:
        if q % 20 == 0:
            others = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
            want.update((q, n + 1, i) for n, (_, i) in enumerate(others[:20]))
    assert got == want


def clustered(n):
    """Unit vectors of 64 dimensions around 20 means, with a spread that falls from axis to axis."""
    random = np.random.default_rng(8)
    x = random.normal(size=(20, 64))[random.integers(20, size=n)] + random.normal(size=(n, 64)) * np.linspace(2.0, 0.2, 64)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("n", [20_000, 100_000, 200_000])  # 200,000 had 0.91 with a fixed budget
def test_neighbours_recall_does_not_fall_with_the_table(spark, tmp_path, n):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x, every = clustered(n), n // 100
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = {}
    for r in neighbours.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), every=every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, n, every):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -9
        hit += len(got[q] & set(np.argpartition(s, n - 20)[n - 20 :].tolist()))
    assert hit / 2000 >= 0.94


# --- Katz ------------------------------------------------------------------------


def brute_katz(rows, held, order, trained=None):
    """By row: (n_tokens, n_known, train_tokens, base_score, score); ``trained``: other rows to learn from."""
    tokens = {n: (t or "").encode().lower().split() + ["/"] for n, (_, t) in enumerate(rows)}
    learnt = [tokens[n] for n in tokens if not held[n]] if trained is None else [(t or "").encode().lower().split() + ["/"] for _, t in trained]
    counts = {k: Counter(g for t in learnt for g in zip(*((["^"] * (k - 1) + t)[i:] for i in range(k)))) for k in range(1, order + 1)}
    c1 = counts[1]
    total = sum(c1.values())
    d = {k: katz.discounts(np.array([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)])) for k, c in counts.items()}

    def less(k, v):
        return (d[k][v] if v <= katz.K else 1) * v

    freed = sum(v - less(1, v) for v in c1.values())
    of = total if freed > 0 else total + 1
    unknown = (freed if freed > 0 else 1) / of
    followers = {k: {} for k in range(2, order + 1)}
    for k in followers:
        for g, v in counts[k].items():
            followers[k].setdefault(g[:-1], {})[g[-1]] = v

    def p(k, ctx, w):
        if k == 1:
            v = c1.get((w,), 0)
            return less(1, v) / of if v else unknown
        f = followers[k].get(ctx)
        if f is None:
            return p(k - 1, ctx[1:], w)
        size, free = sum(f.values()), sum(v - less(k, v) for v in f.values())
        size, free = (size, free) if free > 0 else (size + 1, 1)
        if w in f:
            return less(k, f[w]) / size
        return free / size / (1 - sum(p(k - 1, ctx[1:], x) for x in f)) * p(k - 1, ctx[1:], w)

    words = [*(g[0] for g in c1), None]
    for k in followers:
        for ctx in list(followers[k])[:5]:
            assert sum(p(k, ctx, w) for w in words) == pytest.approx(1)
    out = {}
    for n, t in tokens.items():
        padded = ["^"] * (order - 1) + t
        score = sum(math.log10(p(order, tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(t))
        out[n] = (len(t), sum((w,) in c1 for w in t), total, sum(math.log10((c1.get((w,), 0) + 0.5) / (total + 0.5 * (len(c1) + 1))) for w in t), score)
    return out


def katz_rows(size, seed=8):
    random = np.random.default_rng(seed)
    rows = [(n, " ".join(f"w{int(x)}" for x in random.zipf(1.5, random.integers(0, 30)) if x < 500)) for n in range(size)]
    return rows + [(9999, None), (10000, "never seen"), (5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (10001, "w1 w2 w3 " * (150 if size else 0))]


def check_katz(got, rows, held, want):
    left = Counter()
    for r in got:
        left[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)] += 1
    for n, (i, _) in enumerate(rows):
        left[i, held[n], *want[n][:3], round(want[n][3], 6), round(want[n][4], 6)] -= 1
    assert not any(left.values()), [x for x in left.items() if x[1]][:6]


@pytest.mark.parametrize(("size", "order"), [(0, 3), (3, 3), (200, 1), (200, 2), (200, 3), (120, 4)])
def test_katz_matches_brute_force(spark, size, order, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_TOKENS", 500)
    rows = katz_rows(size)
    held = [n is None or n % 5 == 1 for n, _ in rows]
    docs = spark.createDataFrame([(n, t, "x") for n, t in rows], DOC)
    tables = len(spark.catalog.listTables())
    got = katz.fit_and_score(docs, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(True)), order).collect()
    assert len(spark.catalog.listTables()) == tables
    check_katz(got, rows, held, brute_katz(rows, held, order))


def test_katz_counts_above_32_bits_stay_whole():
    from types import SimpleNamespace

    import pandas as pd

    many = 2**33 + 5
    one = lambda *x: np.array(x, dtype=np.uint64)
    wide = np.full((2, katz.K), float(2**34 + 1))
    level = katz.Level(0, 1, one(7, 9), np.array([1, 1]), one(11, 12), np.array([many, 3]), wide, wide + 2, np.array([2.0**35, 1.0]))
    again = katz.Level.of_table(0, 1, pd.DataFrame([level.row()]))
    assert again.n.tolist() == [many, 3] and (again.small == wide).all() and (again.low == wide + 2).all()
    asked = SimpleNamespace(block=0, ctx=katz.packed_rising(one(7, 9)), runs=katz.packed(np.array([1, 1], np.uint32)), fol=katz.packed(one(11, 12)))
    reply = again.reply(asked, True)
    assert katz.unpacked(reply["n"], "<u8").tolist() == [many, 3] and katz.unpacked(reply["small"], "<u8").max() == 2**34 + 1


def test_a_stored_katz_model_scores_other_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_TOKENS", 500)
    known, other = katz_rows(150), katz_rows(60, seed=9)
    katz.fit(spark.createDataFrame([(n, t, "x") for n, t in known], DOC), path=str(tmp_path / "model"))
    model = katz.load(spark, str(tmp_path / "model"))
    got = katz.score(model, spark.createDataFrame([(n, t, "x") for n, t in other], DOC)).collect()
    held = [True] * len(other)
    check_katz(got, other, held, brute_katz(other, held, katz.ORDER, known))


def test_katz_sends_a_batch_a_block_however_many_parts_there_are():
    import pandas as pd

    words = np.unique(np.random.default_rng(3).integers(0, 2**63, 500, dtype=np.uint64))
    row = {"block": 7, "words": katz.packed_rising(words), "tokens": katz.packed(np.arange(len(words), dtype=np.uint32)), "lens": katz.packed(np.array([len(words)], np.int32)), "held": [False]}
    batches = list(katz.sent_words(iter([pd.DataFrame([row, row | {"block": 8}])]), 90, True))
    assert [set(b["block"]) for b in batches] == [{7}, {8}]  # a batch a message took most of the time of a corpus with many parts
    sent = batches[0]
    part = katz.mixed(words) % np.uint64(90)
    assert sorted(sent["part"]) == sorted(set(part.tolist())) and sum(len(katz.unpacked(x, "<u4")) for x in sent["n"]) == len(words)
    assert all((katz.unpacked_rising(r.words) == words[part == r.part]).all() for r in sent.itertuples())


def test_katz_of_an_empty_table(spark, empty):
    assert katz.fit_and_score(empty, F.lit(False)).count() == 0


def test_places_among_cuts_by_binary_search(spark):
    random = np.random.default_rng(5)
    values = [-(2**63), -1, 0, 1, 2**63 - 1, *random.integers(-50, 50, 60).tolist()]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for n in (0, 1, 2, 3, 7, 8, 33):
        cuts = sorted(random.integers(-40, 40, n).tolist()) + [2**63 - 1] * (n == 33)
        rows = frame.select("v", sampling.below(cuts, F.col("v")).alias("less"), sampling.below(cuts, F.col("v"), among=True).alias("upto")).collect()
        assert all(r.less == sum(c < r.v for c in cuts) and r.upto == sum(c <= r.v for c in cuts) for r in rows), n


def test_noisy_or_gradient_is_that_of_its_likelihood():
    random = np.random.default_rng(8)
    docs = [(int(n % 3 == 0), int(random.integers(0, 4)), [random.choice(9, random.integers(1, 5), replace=False).astype(np.int32) for _ in range(random.integers(0, 4))]) for n in range(40)]
    share, w = np.array([0.3, 0.7]), np.concatenate([random.normal(size=9), [-1.0, -2.0]])

    def loss(w):
        total = 0.0
        for y, plain, sentences in docs:
            odds = [w[-1], *[w[-2]] * plain, *(sum(w[f] for f in s) + w[-2] for s in sentences)]
            clean = math.prod(1 - 1 / (1 + math.exp(-o)) for o in odds)
            total -= share[y] * math.log(1 - clean if y else clean)
        return total

    got = toxicity.Bags(docs).slope(w, share)
    for k, step in enumerate(np.eye(len(w)) * 1e-5):
        assert abs((loss(w + step) - loss(w - step)) / 2e-5 - got[k]) < 1e-6, k


def test_toxicity_is_fitted_alike_in_the_driver_and_in_spark(spark):
    rows = [(n, ("a foul vile word here. " if n % 3 == 0 else "a fine kind word here. ") + "and more\n" * (n % 4), "x") for n in range(60)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(n, n % 3 == 0) for n in range(60)], "doc_id bigint, toxic boolean")
    one, other = (toxicity.fit(docs, labels, rounds=5, most_bytes=b) for b in (1 << 20, 0))
    assert one.weights.any() and np.allclose(one.weights, other.weights, atol=1e-5) and abs(one.bias - other.bias) + abs(one.leak - other.leak) < 1e-6


def test_short_words_merge_as_long_ones(monkeypatch):
    import random

    from graphloom.llm import bpe

    with open(bpe.default_path(), encoding="utf-8") as f:
        model = bpe.Bpe(f.read())
    r = random.Random(3)
    words = ["".join(r.choice("aeiourstnlé啊") for _ in range(r.randint(1, 30))) for _ in range(400)] + ["a" * 31, "ab" * 16, "international", "x"]
    short = [model.word_ids(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [model.word_ids(w) for w in words]
