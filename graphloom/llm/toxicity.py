"""Toxicity by multiple-instance learning: only documents have labels, sentences are scored.

A sentence's probability is a logistic function of the features of its words; a
document is toxic unless every sentence is clean (noisy-or, with a leak term
that stands for a document without sentences). The likelihood of the document
labels trains the sentence weights, and the sentence scores then show where the
offending sentences are.

Features of a word: the word itself and its beginnings of three, four and five
letters, hashed to 2**18 weights, so that inflected forms share evidence.

Training takes a bounded sample of the labelled rows: at most TRAIN_TOXIC toxic
and TRAIN_CLEAN clean documents, those with the smallest hash of their id, with all
sentences of their whole texts. Two passes over them keep what reaches the driver small:
the first counts, in Spark, in how many toxic and clean documents each feature is (2**18
counts), which tells the features that will have weights; the second finds the sentences
that have such features, and for each document the number of those that have none. They go to the driver
where they fit MOST_BYTES; else each of the ROUNDS steps adds up its gradient in Spark. The steps are the same.
Scoring always takes all sentences of the whole text.

Defined cases: null and empty texts have no sentence and score the leak
probability; a null label is unlabelled; several labels of one id count as toxic
if any is; of rows that repeat an id one is trained on (that with the smallest hash
of its text), and each is scored; a null id is scored and never trained on; where toxic
or clean labels are missing altogether every text scores the same, 0.018.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored
from graphloom.sources.storage import dropped

BITS = 18
TRAIN_TOXIC, TRAIN_CLEAN = 1_500, 3_000
LEAST_DOCS, LEAST_Z = 3, 4.0
ROUNDS, MOST_BYTES = 150, 128 << 20
THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 500_000
CLAMP = 30.0


def word_features(word: str) -> tuple[int, ...]:
    found = {"=" + word, *(word[:n] for n in (3, 4, 5) if len(word) >= n)}
    return tuple(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in found}))


def sentence_features(sentence: str) -> np.ndarray:
    return np.array([f for w in sorted(set(WORD.findall(sentence.lower()))) for f in word_features(w)], dtype=np.int32)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


class Model:
    """weights[feature], the bias of a sentence and the leak, all as log-odds."""

    def __init__(self, weights: np.ndarray, bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def word_weight(self, word: str) -> float:
        return float(self.weights[list(word_features(word))].sum())


def untrained() -> Model:
    return Model(np.zeros(1 << BITS, np.float32), -CLAMP, -4.0)


def telling(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Which features are in a share of the toxic documents that differs from their share of the clean ones beyond chance."""
    share = (in_toxic + in_clean) / (toxic + clean)
    z = (in_toxic / toxic - in_clean / clean) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / toxic + 1 / clean))
    return (in_toxic + in_clean >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)


class Bags:
    """Labelled documents as columns: of each sentence its document, how often it stands there, and its features."""

    def __init__(self, docs: list[tuple[int, int, list[np.ndarray]]]):
        """``docs``: (label, number of sentences without features, features of each other sentence)."""
        self.label = np.array([y for y, _, _ in docs], dtype=int)
        sentences = [np.zeros(0, np.int32) for _ in docs] + [s for _, _, ss in docs for s in ss]
        self.times = np.concatenate([[n for _, n, _ in docs], np.ones(len(sentences) - len(docs))])
        self.of_doc = np.concatenate([np.arange(len(docs)), np.repeat(np.arange(len(docs)), [len(ss) for _, _, ss in docs])]).astype(int)
        self.of_sentence = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        self.features = np.concatenate([np.zeros(0, np.int32), *sentences])

    def slope(self, w: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The gradient of the negative log-likelihood of the labels by ``w`` (weights, bias, leak); a document counts ``share[label]``."""
        s = np.clip(np.bincount(self.of_sentence, w[self.features], len(self.of_doc)) + w[-2], -CLAMP, CLAMP)
        clean = np.exp(-np.bincount(self.of_doc, self.times * softplus(s), len(self.label)) - softplus(w[-1]))
        d_total = share[self.label] * np.where(self.label == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        d_s = self.times * d_total[self.of_doc] / (1 + np.exp(-s))
        return np.concatenate([np.bincount(self.features, d_s[self.of_sentence], len(w) - 2), [d_s.sum(), d_total.sum() / (1 + np.exp(-w[-1]))]])


def descend(slope: Callable[[np.ndarray], np.ndarray], rounds: int, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """The model that Adam finds in ``rounds`` steps of the whole gradient."""
    w = np.concatenate([np.zeros(1 << BITS), [-4.0, -4.0]])  # the last two: bias and leak
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        g = slope(w)
        g[:-2] += decay * w[:-2]
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(w[:-2].astype(np.float32), float(w[-2]), float(w[-1]))


def unpacked(y: int, plain: int, n: bytes, f: bytes) -> tuple[int, int, list[np.ndarray]]:
    cuts = np.cumsum(np.frombuffer(n, dtype=np.int32))
    return y, plain, np.split(np.frombuffer(f, dtype=np.int32), cuts[:-1]) if len(cuts) else []


def summed(found: DataFrame, w: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The gradient over a table of documents, added up in Spark; at most 2**18 sums reach the driver."""
    sent = found.sparkSession.sparkContext.broadcast((w, share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, shares = sent.value
        total = np.zeros(len(weights))
        for b in batches:
            total += Bags([unpacked(*r) for r in zip(b["y"], b["plain"], b["n"], b["f"])]).slope(weights, shares)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"at": at.astype(np.int32), "g": total[at]})

    out = np.zeros(len(w))
    sums = found.mapInPandas(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toPandas()
    out[sums["at"].to_numpy()] = sums["g"].to_numpy()
    sent.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rounds: int = ROUNDS, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from the labelled documents; ``allowed`` is a condition on doc_id that training rows meet."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    if allowed is not None:
        known = known.where(allowed)
    dealt = known.select("doc_id", "_y", F.xxhash64("doc_id").alias("_h"))
    chosen = dealt.where("_y = 1").orderBy("_h", "doc_id").limit(TRAIN_TOXIC).unionAll(dealt.where("_y = 0").orderBy("_h", "doc_id").limit(TRAIN_CLEAN))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "_y", "_h").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = stored(once.select("_y", "_h", "text"), "toxicity-training")  # at most TRAIN_TOXIC + TRAIN_CLEAN rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)  # the last one: documents
        for b in batches:
            for y, text in zip(b["_y"], b["text"]):
                seen[y, np.unique(sentence_features(text or ""))] += 1
                seen[y, -1] += 1
        y, f = np.nonzero(seen)
        yield pd.DataFrame({"y": y.astype(np.int32), "f": f.astype(np.int32), "n": seen[y, f]})

    seen = np.zeros((2, (1 << BITS) + 1))
    for r in rows.mapInPandas(count, "y int, f int, n bigint").groupBy("y", "f").agg(F.sum("n").alias("n")).toPandas().itertuples():  # 2 * 2**18 rows at most
        seen[r.y, r.f] = r.n
    if not seen[0, -1] or not seen[1, -1]:
        dropped(rows)
        return untrained()
    sent = spark.sparkContext.broadcast(telling(seen[1, :-1], seen[0, :-1], int(seen[1, -1]), int(seen[0, -1])))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                parts = [f[sent.value[f]] for f in map(sentence_features, SENTENCE.findall(text or ""))]
                some = [f for f in parts if len(f)]
                out.append((len(parts) - len(some), np.array([len(p) for p in some], dtype=np.int32).tobytes(), np.concatenate([np.zeros(0, np.int32), *some]).astype(np.int32).tobytes()))
            yield pd.DataFrame({"y": b["_y"], "h": b["_h"], "plain": [x[0] for x in out], "n": [x[1] for x in out], "f": [x[2] for x in out]})

    found = stored(rows.mapInPandas(gather, "y int, h bigint, plain int, n binary, f binary"), "toxicity-sentences")
    share = 0.5 / np.array([seen[0, -1], seen[1, -1]])  # clean and toxic documents weigh the same as a whole
    if found.agg(F.sum(F.octet_length("n") + F.octet_length("f"))).first()[0] <= most_bytes:
        bags = Bags([unpacked(r.y, r.plain, r.n, r.f) for r in sorted(found.collect(), key=lambda r: (r.h, r.f))])
        model = descend(lambda w: bags.slope(w, share), rounds)
    else:
        model = descend(lambda w: summed(found, w, share), rounds)
    dropped(rows)
    dropped(found)
    return model


class Scorer(dict):
    """Scores texts; remembers the weights of up to CACHE_WORDS words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.leak = model, float(softplus(np.array(model.leak)))

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = self.model.word_weight(word)
        return got

    def sentences(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The log-odds and the place of each sentence."""
        low = text.lower()
        low = low if len(low) == len(text) else text  # the places must be those of the text itself
        odds, places, of = [], [], self.__getitem__
        for match in SENTENCE.finditer(low):
            odds.append(sum(map(of, set(WORD.findall(match[0] if low is not text else match[0].lower())))))
            places.append(match.span())
        return np.clip(np.array(odds, dtype=float) + self.model.bias, -CLAMP, CLAMP), places

    def document(self, odds: np.ndarray) -> float:
        return float(-np.expm1(-(softplus(odds).sum() + self.leak)))


def score(docs: DataFrame, model: Model, sentence_threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences: array of (start, end, probability), in text order.

    ``start`` and ``end`` are character offsets; the text ``text[start:end]`` is the sentence.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))  # 2**18 floats, 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*sent.value))
        bar = np.log(sentence_threshold / (1 - sentence_threshold))
        for b in batches:
            scores, counts, spans = [], [], []
            for text in b["text"]:
                odds, places = scorer.sentences(text or "")
                scores.append(scorer.document(odds))
                counts.append(len(odds))
                spans.append([{"start": places[i][0], "end": places[i][1], "probability": float(1 / (1 + np.exp(-odds[i])))} for i in np.nonzero(odds >= bar)[0]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "n_sentences": counts, "offending": spans})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, score double, n_sentences int, offending array<struct<start:int,end:int,probability:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*sent.value))
        for texts in batches:
            yield pd.Series([scorer.document(scorer.sentences(t or "")[0]) for t in texts], dtype=float)

    return docs.where(probability(F.col("text").cast("string")) < threshold)
