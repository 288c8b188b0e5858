"""SimHash fingerprints, and all links within a Hamming distance by the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits share a group. If the thresholds
t_i of the groups add up to t - m + 1 (a group may have -1: not probed), two
fingerprints within distance t agree within t_i in some group i. Each fingerprint
gets its own thresholds: dynamic programming picks those with the least estimated
cost, which is the number of candidates behind its probes, counted on the
histograms of all group values, plus the probes themselves. How many groups there
are is chosen from GROUPS by the same estimate on a sample, so that small tables
have few probes and large ones few candidates. A fingerprint lies in its own bucket
of each group, meets there those whose probes come by, and is verified on all 64 bits.

Equal fingerprints are one node. A bucket never emits all its pairs: where they
would be over DENSE a row it is searched breadth first and gives one link per
node; buckets that the histogram shows as hot are cut into blocks of about BLOCK
own fingerprints, each a bucket of its own that all others visit.

``keep_one_each`` finds near copies: documents whose sets of shingles have a Jaccard
similarity of ``share``. It fingerprints the distinct words, which a few changed words
disturb less than shingles, takes links within ``most`` bits for candidates, and
verifies each by the exact similarity (after a sketch of the sets has put the plainly
different ones aside). The nodes of dense buckets are linked through central ones first;
only those that this leaves apart are compared in pairs.

What reaches the driver is bounded: the 64 x 64 bit counts, the histograms (a count a
value of each group of each number of groups, 320,000 at most) and SAMPLE fingerprints;
the tables that are broadcast are no larger.

Defined cases: null and empty texts have no shingle and the fingerprint zero,
which links like any other; a text with fewer words than a shingle is one
shingle; a null id gets its fingerprint but takes no part in links (component
null); rows that repeat share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored
from graphloom.llm.components import components

#: The numbers of groups that are weighed.
GROUPS = (4, 5, 6, 8)
SEED = 42
#: Own fingerprints of one bucket that a task compares with all visitors.
BLOCK = 8_000
#: Buckets of up to so many rows are compared by shifting, larger ones as matrices.
SMALL = 32
#: Links a linked row that a bucket may emit before it is searched instead.
DENSE = 8
#: What a probe costs, in candidates: some microseconds against some nanoseconds.
PROBE_COST = 1_000.0
#: Fingerprints on which the number of groups is chosen.
SAMPLE = 2_000


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes (big-endian)."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    return majority(hashes_of(text, shingle))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": found.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, fp bigint")


def bit_groups(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits by correlation: ``both[i, j]`` of ``n`` fingerprints have the bits i and j set."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = set(range(64)), []
    for size in (64 // groups + (g < 64 % groups) for g in range(groups)):
        first = max(sorted(left), key=lambda i: tie[i, sorted(left)].sum())
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda i: tie[i, group].sum())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def values_of(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group as a number; bit 0 is the lowest of the fingerprint."""
    out = np.zeros(len(fps), dtype=np.int64)
    for n, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << n
    return out


def balls(counts: np.ndarray, bits: int, most: int) -> np.ndarray:
    """[r, v]: how many fingerprints have a group value within distance r of v, for r up to ``most``."""
    exact = np.zeros((most + 1, len(counts)))
    exact[0] = counts
    at = np.arange(len(counts))
    for bit in range(bits):  # after each bit: values that differ in r of the bits so far
        flipped = exact[:, at ^ (1 << bit)]
        exact[1:] += flipped[:-1]
    return np.cumsum(exact, axis=0)


def masks_within(bits: int, radius: int) -> np.ndarray:
    out = [0]
    ring = {0}
    for _ in range(radius):
        ring = {m | 1 << b for m in ring for b in range(bits) if not m >> b & 1}
        out += sorted(ring)
    return np.array(out, dtype=np.int64)


def allocate(cost: list[np.ndarray], total: int) -> np.ndarray:
    """For each row the units (threshold + 1) of each group, adding up to ``total``, with the least cost.

    ``cost[g][u, row]`` is what u units in group g cost; no units cost nothing.
    """
    rows = cost[0].shape[1]
    best = np.full((total + 1, rows), np.inf)
    best[0] = 0
    chosen = []
    for c in cost:
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, dtype=np.int8)
        for have in range(total + 1):
            for u in range(min(have, c.shape[0] - 1) + 1):
                value = best[have - u] + c[u]
                better = value < new[have]
                new[have][better] = value[better]
                pick[have][better] = u
        best = new
        chosen.append(pick)
    left = np.full(rows, total)
    units = np.zeros((len(cost), rows), dtype=np.int64)
    for g in range(len(cost) - 1, -1, -1):
        units[g] = chosen[g][left, np.arange(rows)]
        left = left - units[g]
    return units


def _links_of_small(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``most`` bits among rows of one key, all buckets at once; ``key`` is sorted."""
    a, b = [], []
    for shift in range(1, SMALL):
        same = np.nonzero(key[shift:] == key[:-shift])[0]
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + shift]) <= most]
        a.append(near)
        b.append(near + shift)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def search(fp: np.ndarray, most: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect, and only connect, what steps of up to ``most`` bits connect: a forest.

    With ``own`` (a mask) only those rows start a search; others that none reaches stay apart.
    """
    left, reached = np.arange(len(fp)), np.zeros(len(fp), dtype=bool)
    parents, children = [], []
    for seed in range(len(fp)) if own is None else np.nonzero(own)[0]:
        if reached[seed]:
            continue
        reached[seed] = True
        frontier, left = np.array([seed]), left[left != seed]
        while len(frontier) and len(left):
            found = []
            step = max(1, 2_000_000 // len(left))
            for at in range(0, len(frontier), step):
                some = frontier[at : at + step]
                near = np.bitwise_count(fp[some][:, None] ^ fp[left][None, :]) <= most
                hit = near.any(axis=0)
                if hit.any():
                    new = left[hit]
                    parents.append(some[near[:, hit].argmax(axis=0)])
                    children.append(new)
                    found.append(new)
                    reached[new] = True
                    left = left[~hit]
                    if not len(left):
                        break
            frontier = np.concatenate(found) if found else left[:0]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


class Probing:
    """How fingerprints are probed: groups of bits, and how many fingerprints lie within each radius of each value."""

    def __init__(self, grouped: list[list[int]], counts: list[np.ndarray], most: int):
        self.grouped, self.most = grouped, most
        self.within = [balls(c, len(bits), min(most, len(bits))).astype(np.float32) for c, bits in zip(counts, grouped)]
        self.masks = [[masks_within(len(bits), r) for r in range(len(w))] for bits, w in zip(grouped, self.within)]

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [values_of(fps, bits) for bits in self.grouped]

    def costs(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """[units, row] of each group."""
        return [np.concatenate([np.zeros((1, len(v)), np.float32), w[:, v] + PROBE_COST * np.array([len(x) for x in m])[:, None]]) for w, v, m in zip(self.within, values, self.masks)]

    def units(self, values: list[np.ndarray]) -> np.ndarray:
        return allocate(self.costs(values), self.most + 1)

    def mean_cost(self, fps: np.ndarray) -> float:
        values = self.values(fps)
        cost = self.costs(values)
        units = allocate(cost, self.most + 1)
        return PROBE_COST * len(self.grouped) + float(sum(c[u, np.arange(len(fps))].sum() for c, u in zip(cost, units))) / max(1, len(fps))

    def rows(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, block, own, row): where each fingerprint lies, and where it looks."""
        values = self.values(fps)
        for g, (v, u) in enumerate(zip(values, self.units(values))):
            for radius in range(max(0, int(u.max()) - 1) + 1):
                # every fingerprint lies in its own bucket; those with a wider radius probe the others
                rows = np.arange(len(fps)) if radius == 0 else np.nonzero(u - 1 >= radius)[0]
                ring = self.masks[g][radius][0 if radius == 0 else len(self.masks[g][radius - 1]) :]
                keys = (v[rows][:, None] ^ ring[None, :]).ravel()
                at = np.repeat(rows, len(ring))
                there = self.within[g][0][keys]
                if radius:  # no one lies in an empty bucket
                    keys, at, there = keys[there > 0], at[there > 0], there[there > 0]
                blocks = np.ceil(there / BLOCK).astype(np.int64)  # a function of the key alone
                bucket = (np.int64(g) << 40) | keys
                one = blocks <= 1
                yield bucket[one], np.zeros(int(one.sum()), np.int64), np.full(int(one.sum()), radius == 0), at[one]
                for k in np.unique(blocks[~one]):
                    some = np.nonzero(blocks == k)[0]
                    mine = ((fps[at[some]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
                    for block in range(k):
                        yield bucket[some], np.full(len(some), block), (mine == block) & (radius == 0), at[some]


def probing(nodes: DataFrame, most: int, groups: tuple[int, ...] | None = None) -> Probing:
    """The groups of bits and their histograms for the fingerprints ``fp`` of ``nodes``, a stored table."""
    groups = groups or GROUPS

    def bit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((65, 64))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total[:64] += bits.T @ bits
            total[64, 0] += len(b)
        yield pd.DataFrame({"cell": np.arange(65 * 64), "n": total.ravel().astype(np.int64)})

    cells = nodes.select("fp").mapInPandas(bit_counts, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect()  # 65 * 64 rows
    flat = np.zeros(65 * 64)
    for cell, count in cells:
        flat[cell] = count
    both, n = flat.reshape(65, 64)[:64], int(flat[64 * 64])
    grouped = {m: bit_groups(both, n, m) for m in groups}

    def group_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64)
            for m, of in grouped.items():
                for g, bits in enumerate(of):
                    v, c = np.unique(values_of(fps, bits), return_counts=True)
                    yield pd.DataFrame({"m": np.full(len(v), m, dtype=np.int32), "g": np.full(len(v), g, dtype=np.int32), "v": v, "n": c})

    seen = nodes.select("fp").mapInPandas(group_counts, "m int, g int, v bigint, n bigint").groupBy("m", "g", "v").agg(F.sum("n").alias("n")).toPandas()
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    found = []
    for m, of in grouped.items():
        counts = [np.zeros(1 << len(bits)) for bits in of]
        for (g,), own in seen[seen["m"] == m].groupby(["g"]):
            counts[g][own["v"].to_numpy()] = own["n"].to_numpy()
        found.append(Probing(of, counts, most))
    return min(found, key=lambda p: p.mean_cost(sample)) if len(sample) else found[0]


def bucketed(nodes: DataFrame, most: int, groups: tuple[int, ...] | None = None) -> DataFrame:
    """(key, block, own, node, fp) sorted by bucket: each node in its own buckets and in those that it probes."""
    sent = nodes.sparkSession.sparkContext.broadcast(probing(nodes, most, groups))

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 20_000):
                node, fp = b["node"].to_numpy()[at : at + 20_000], b["fp"].to_numpy()[at : at + 20_000]
                for key, block, own, rows in sent.value.rows(fp.view(np.uint64)):
                    if len(rows):
                        yield pd.DataFrame({"key": key, "block": block, "own": own, "node": node[rows], "fp": fp[rows]})

    buckets = nodes.select("node", "fp").mapInPandas(framed, "key bigint, block bigint, own boolean, node bigint, fp bigint")
    return buckets.repartition("key", "block").sortWithinPartitions("key", "block")


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that end where a bucket ends."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b.iloc[-1]
        whole = (b["key"] != last["key"]) | (b["block"] != last["block"])
        if whole.any():
            yield pd.concat([*kept, b[whole]], ignore_index=True)
            kept = [b[~whole]]
        else:
            kept.append(b)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def near_pairs(own: np.ndarray, fp: np.ndarray, most: int, bound: int) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Index pairs of an own row and any other within ``most`` bits; the rows that have one instead, where they are over ``bound`` a row."""
    a, b, found, hit = [], [], 0, np.zeros(len(fp), dtype=bool)
    step = max(1, 2_000_000 // max(1, len(fp)))
    for at in range(0, len(own), step):
        some = own[at : at + step]
        near = np.bitwise_count(fp[some][:, None] ^ fp[None, :]) <= most
        near[np.arange(len(some)), some] = False
        hit |= near.any(axis=0)
        hit[some] |= near.any(axis=1)
        n = int(near.sum())
        found += n
        if found <= bound * len(fp):
            x, y = np.nonzero(near)
            a.append(some[x])
            b.append(y)
    if found > bound * hit.sum():
        return np.nonzero(hit)[0]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def central_first(fp: np.ndarray) -> np.ndarray:
    """The order of rows by their distance to the bits that most have."""
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    usual = np.frombuffer(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fp)).tobytes(), dtype=">u8")[0]
    return np.argsort(np.bitwise_count(fp ^ np.uint64(usual)), kind="stable")


LINKS = "a bigint, b bigint, dense boolean, own boolean"


def bucket_links(buckets: DataFrame, most: int) -> DataFrame:
    """(a, b, dense, own): links that join what all within ``most`` bits would join; and, with ``dense``, the rows
    (a: node, b: bucket) that have links in buckets that gave a forest in place of all of them."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_buckets(batches):
            fp, node, mine = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy(), rows["own"].to_numpy()
            change = (np.diff(rows["key"].to_numpy()) != 0) | (np.diff(rows["block"].to_numpy()) != 0)
            bucket = np.concatenate([[0], np.cumsum(change)])
            sizes = np.bincount(bucket)
            ends = np.cumsum(sizes)
            small = sizes[bucket] <= SMALL
            a, b = _links_of_small(bucket[small], fp[small], most)
            out = [(node[small][a], node[small][b])]
            for big in np.nonzero(sizes > SMALL)[0]:
                where = np.arange(ends[big] - sizes[big], ends[big])
                own = np.nonzero(mine[where])[0]
                if not len(own):
                    continue
                found = near_pairs(own, fp[where], most, DENSE)
                if isinstance(found, np.ndarray):
                    where = where[found]
                    order = where[central_first(fp[where])]
                    x, y = search(fp[order], most, mine[order])
                    out.append((node[order[x]], node[order[y]]))
                    yield pd.DataFrame({"a": node[where], "b": rows["key"].to_numpy()[where] * 8191 + rows["block"].to_numpy()[where], "dense": True, "own": mine[where]})
                else:
                    out.append((node[where[found[0]]], node[where[found[1]]]))
            a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
            pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "dense": False, "own": False})
            yield pairs[pairs["a"] != pairs["b"]].drop_duplicates()

    return buckets.mapInPandas(verify, LINKS)


def links(nodes: DataFrame, most: int, groups: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): links between nodes within ``most`` bits that join the same nodes as all such links would.

    ``nodes``: (node long, fp long), each fp once; a stored table.
    """
    return bucket_links(bucketed(nodes, most, groups), most).where("NOT dense").select("a", "b")


def near_components(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of up to ``most`` bits reach."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("node")), "nodes")
    roots = components(links(nodes, most), "simhash-links")
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = marked.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- near copies -----------------------------------------------------------------

#: Bits of the distinct words' fingerprints in which candidates may differ.
MOST = 8
#: Bytes of a sketch: the lowest byte of the least of as many hashes of the shingles.
SKETCH = 192
#: How far below the similarity asked for a sketch's estimate may lie: five standard errors at 0.8.
SLACK = 0.145
_ODD = np.random.default_rng(11).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(hashes_of(text, shingle).astype(np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096, None] * _ODD[None, :]
        least = np.minimum(least, ((some ^ (some >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; empty ones are like no other set."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set, fp, sketch): a digest of the set of shingles, the fingerprint of the distinct words, and the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            fps = np.array([majority(shingle_set(t, 1).astype(">u8")) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "set": [digest_of(s) for s in sets], "fp": fps.view(np.int64), "sketch": [sketch(s) for s in sets]})

    return docs.mapInPandas(run, "doc_id bigint, set binary, fp bigint, sketch binary")


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def texts_of(docs: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(node, text) of ``ends`` (node, doc_id, set): of an id's rows the one with that set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [digest_of(shingle_set(t, shingle)) == s for t, s in zip(b["text"], b["set"])]
            yield b.loc[keep, ["node", "text"]]

    return docs.join(ends, "doc_id").select("node", "set", "text").mapInPandas(run, "node bigint, text string").dropDuplicates(["node"])


def matches(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of equal bytes of each row's two sketches, some 2**-8 above the similarity that they estimate."""
    return (one == other).mean(axis=1)


def likely(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches do not rule out a similarity of ``share``."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        one, other = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, SKETCH) for v in (x, y))
        return pd.Series(matches(one, other) >= share - SLACK)

    sketched = nodes.select("node", "sketch")
    first = pairs.join(sketched.select(F.col("node").alias("a"), F.col("sketch").alias("_x")), "a").join(sketched.select(F.col("node").alias("b"), F.col("sketch").alias("_y")), "b")
    return first.where(alike("_x", "_y")).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have a similarity of at least ``share``."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            for a, x, y in zip(b["a"], b["x"], b["y"]):
                if a != last:
                    last, known = a, shingle_set(x, shingle)
                keep.append(similarity(known, shingle_set(y, shingle)) >= share - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    named = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes, "node").select("node", "doc_id", "set")
    ends = stored(texts_of(docs, named, shingle), "likely-texts")
    full = pairs.join(ends.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return full.mapInPandas(exact, "a bigint, b bigint")


def apart(dense: DataFrame, nodes: DataFrame, roots: DataFrame, most: int, share: float) -> DataFrame:
    """(a, b): all likely pairs within ``most`` bits in dense buckets whose nodes no verified link has joined yet."""
    rooted = dense.join(nodes.select("node", "fp", "sketch"), "node").join(roots, "node", "left").select("key", "own", "node", "fp", "sketch", F.coalesce("root", "node").alias("root"))
    several = dense.select("key", "node").join(roots, "node", "left").groupBy("key").agg(F.min(F.coalesce("root", "node")).alias("x"), F.max(F.coalesce("root", "node")).alias("y"))
    some = rooted.join(several.where("x < y").select("key"), "key", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_buckets(b.assign(block=0) for b in batches):
            key = rows["key"].to_numpy()
            cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
            for at, end in zip(cuts[:-1], cuts[1:]):
                one = rows.iloc[at:end]
                fp, node, root = one["fp"].to_numpy().view(np.uint64), one["node"].to_numpy(), one["root"].to_numpy()
                sketches = np.frombuffer(b"".join(one["sketch"]), np.uint8).reshape(-1, SKETCH)
                own = np.nonzero(one["own"].to_numpy())[0]
                step = max(1, 500_000 // (end - at))
                for n in range(0, len(own), step):
                    mine = own[n : n + step]
                    near = (np.bitwise_count(fp[mine][:, None] ^ fp[None, :]) <= most) & (root[mine][:, None] != root[None, :])
                    x, y = np.nonzero(near)
                    x = mine[x]
                    alike = [matches(sketches[x[k : k + 50_000]], sketches[y[k : k + 50_000]]) >= share - SLACK for k in range(0, len(x), 50_000)]
                    keep = np.concatenate([np.zeros(0, dtype=bool), *alike])
                    a, b = node[x[keep]], node[y[keep]]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return some.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a bigint, b bigint").distinct()


def keep_one_each(docs: DataFrame, shingle: int, share: float, most: int = MOST) -> DataFrame:
    """``docs`` without those that links of a similarity of at least ``share`` join to one of a smaller id; rows with a null id stay.

    Rows that repeat one doc_id are one document: they stay or go together.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stored(marks(known, shingle), "near-marks")
    first = marked.groupBy("set").agg(F.min(F.struct("doc_id", "fp", "sketch")).alias("m"))
    nodes = stored(first.select("set", F.monotonically_increasing_id().alias("node"), "m.*"), "near-nodes")  # a number a set, fixed by the table
    found = stored(bucket_links(bucketed(nodes.select("node", "fp"), most), most), "near-links")
    pairs = found.where("NOT dense").select("a", "b").distinct()
    links = stored(verified(stored(likely(pairs, nodes, share), "near-likely"), nodes, known, shingle, share), "near-verified")
    roots = components(links, "near-roots")
    dense = found.where("dense").select(F.col("a").alias("node"), F.col("b").alias("key"), "own")
    if not dense.isEmpty():
        rest = stored(apart(dense, nodes, roots, most, share).join(links, ["a", "b"], "left_anti"), "near-apart")
        roots = components(links.unionAll(verified(rest, nodes, known, shingle, share)), "near-roots")
    grouped = nodes.join(roots, "node", "left").select("set", "doc_id", F.coalesce("root", "node").alias("root"))
    least = grouped.join(grouped.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select("set", "least")
    gone = marked.select("doc_id", "set").join(least, "set").where("least < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
