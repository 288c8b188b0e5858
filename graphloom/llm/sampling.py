"""Document fingerprints by improved consistent weighted sampling.

Terms are words, weighted by how often the text has them. For each term and each
of SAMPLES samples, hashes of the term give two Gamma(2, 1) variates r and c and a
uniform b; with t = floor(ln(weight) / r + b) the term's race value is
ln c - r (t - b) - r, and the smallest value wins the sample. The pair (term, t)
of the winner is the sample, so that two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger.

Only DataFrame functions are used. The two versions of a text, itself and the edited
one, are sampled together: a term's variates are drawn once for both weights. A term's race
value (2**-20 steps) and 32 bits of its sample share one long, so that the race is a plain
``min`` that hash aggregation keeps in place.

Defined cases: null and empty texts, and texts of blanks, have no term and the
fingerprint ``ffffffff`` in each sample, alike among themselves; A-Z are
lower-cased; rows that repeat get a fingerprint each; a null id sorts last; rows of one id
follow one another by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower

SAMPLES = 32
NONE = 0xFFFFFFFF
_BITS = 25
#: Samples that one row of the aggregation holds: so few that its generated code stays small enough to be compiled well.
TOGETHER = 8
#: Tasks of the race for each shuffle partition, so that a task's table of (row, term) pairs stays in memory, and ranges of ids a task.
TASKS, RANGES = 4, 2


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("double") + 0.5) * F.lit(2.0**-_BITS)


def race(term: Column, log_weight: Column, sample: Column) -> Column:
    """The race value of a term in the high bits, its sample (term, t) in the low 32; null without a weight."""
    a, b = F.xxhash64(term, sample * 2), F.xxhash64(term, sample * 2 + 1)
    r = -F.log(_uniform(a, 0) * _uniform(a, _BITS))
    c = F.log(-F.log(_uniform(b, 0) * _uniform(b, _BITS)))
    beta = (F.shiftrightunsigned(a, 50).bitwiseXOR(F.shiftleft(F.shiftrightunsigned(b, 50), 14)).cast("double") + 0.5) * F.lit(2.0**-28)
    name = a.bitwiseXOR(F.shiftrightunsigned(b, 13))
    t = F.floor(log_weight / r + beta)
    low = name.bitwiseXOR(F.shiftleft(t, 9)).bitwiseXOR(F.shiftleft(t, 23)).bitwiseAND(F.lit(NONE))
    high = F.shiftleft(((c - r * (t - beta) - r + 1000.0) * F.lit(2.0**20)).cast("bigint"), 32)
    return high.bitwiseOR(low)


def term_digests(text: Column) -> Column:
    """The words of a text as digests, repeats included; empty for a null text."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def marks_of(version: str, mark: Column, number: int) -> Column:
    return F.transform(term_digests(F.col(version)), lambda h: h.bitwiseAND(mark).bitwiseOR(F.lit(number)))


def samples(texts: DataFrame, keys: list[str], versions: list[str], n: int = SAMPLES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carry, _s0, _s1, ...: array<long>): the samples of each row's texts, a column for each of the one or two ``versions``.

    ``keys`` name a row, ``carry`` are numbers that it keeps. The rows must lie in one
    partition by a hash on some of the keys for this to add no shuffle. A digest's lowest bit says which version it is of.
    """
    mark, rest = F.lit(~1), F.lit(1)
    marked = F.concat(*(marks_of(v, mark, k) for k, v in enumerate(versions)))
    words = texts.select(*keys, *carry, F.explode_outer(marked).alias("_d"))
    version = F.col("_d").bitwiseAND(rest)
    found = words.select(*keys, *carry, F.col("_d").bitwiseAND(mark).alias("_h"), version.alias("_v"))
    counts = (F.sum(F.when(F.col("_v") == k, 1).otherwise(0)).alias(f"_n{k}") for k in range(len(versions)))
    counted = found.groupBy(*keys, "_h").agg(*(F.max(c).alias(c) for c in carry), *counts)
    groups = -(-n // TOGETHER)
    logs = [F.log(F.col(f"_n{k}").cast("double")).alias(f"_l{k}") for k in range(len(versions))]
    weighted = counted.select(*keys, *carry, "_h", *logs, (F.explode(F.array(*map(F.lit, range(groups)))) if groups > 1 else F.lit(0)).alias("_g"))
    best = (F.min(race(F.col("_h"), F.col(f"_l{k}"), F.col("_g") * TOGETHER + i)).alias(f"_{k}_{i}") for k in range(len(versions)) for i in range(TOGETHER))
    raced = weighted.groupBy(*keys, "_g").agg(*(F.max(c).alias(c) for c in carry), *best)
    low = [F.array(*(F.coalesce(F.col(f"_{k}_{i}").bitwiseAND(F.lit(NONE)), F.lit(NONE)) for i in range(TOGETHER))).alias(f"s{k}") for k in range(len(versions))]
    gathered = raced.select(*keys, *carry, F.struct("_g", *low).alias("_x")).groupBy(*keys).agg(*(F.max(c).alias(c) for c in carry), F.sort_array(F.collect_list("_x")).alias("_x"))  # a row a group
    return gathered.select(*keys, *carry, *(F.slice(F.flatten(F.col(f"_x.s{k}")), 1, n).alias(f"_s{k}") for k in range(len(versions))))


def hex_of(sampled: Column) -> Column:
    return F.array_join(F.transform(sampled, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x).cast("double") / F.size(a)


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    return samples(rows, ["_row", "doc_id"], ["text"], n=n).select("doc_id", hex_of(F.col("_s0")).alias("fingerprint"))


def below(cuts: list[int], value: Column, among: bool = False) -> Column:
    """How many of the ascending ``cuts`` are smaller than the value (with ``among``: or equal), by a binary search; the cuts are one literal of the plan."""
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))

    def further(at: Column, step: Column) -> Column:
        cut = F.get(array, at + step - 1)  # null beyond the end
        return F.when(cut <= value if among else cut < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further) if cuts else F.lit(0)


def dealt_with_next(docs: DataFrame) -> DataFrame:
    """(_bucket, _rn, _ghost, doc_id, text, next): each row with the text of the next, by descending doc_id; the first follows the last.

    Rows of one id follow one another by their text's hash. Rows are dealt by ranges of ids, cut at approximate quantiles, so that
    outlying ids do no harm; an id that fills several ranges is dealt by the hash. The first row of each bucket is copied, as a
    ghost, to the bucket before it, so that one shuffle brings every row next to its follower. What reaches the driver
    is a row a range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_i"))
    tasks = TASKS * parts
    ranges = RANGES * tasks
    shares = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    cuts = rows.agg(F.expr(f"percentile_approx(_i, array({shares}), {100 * ranges})")).first()[0] or []
    hashed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_less", below(cuts, F.col("_i"))).withColumn("_upto", below(cuts, F.col("_i"), among=True))
    less, same = F.col("_less"), F.col("_upto") - F.col("_less")
    # of an id with several ranges, texts with small hashes come first, that is in the last range
    turn = F.floor((F.col("_h").cast("double") + 2.0**63) * 2.0**-64 * (same + 1)).cast("int")
    celled = hashed.withColumn("_cell", less + same - F.least(turn, same))
    tops = celled.groupBy("_cell").agg(F.max(F.struct("_i", (-F.col("_h")).alias("h"))).alias("t")).orderBy("_cell").collect()  # a row a range
    plan = [(r._cell, n, r.t._i, -r.t.h, (n + 1) % len(tops), n + 1 == len(tops)) for n, r in enumerate(tops)]
    cells = spark.createDataFrame(plan, "_cell int, _own int, _top bigint, _top_h bigint, _above int, _wraps boolean")
    placed = celled.join(F.broadcast(cells), "_cell")
    own = F.struct(F.col("_own").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("_above").alias("b"), F.when(F.col("_wraps"), 2).otherwise(1).alias("g"))
    first = (F.col("_i") == F.col("_top")) & (F.col("_h") == F.col("_top_h"))
    dealt = placed.select("doc_id", "text", "_i", "_h", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("_x"))
    dealt = dealt.select("doc_id", "text", "_i", "_h", F.col("_x.b").alias("_bucket"), F.col("_x.g").alias("_ghost")).repartition(tasks, "_bucket")
    order = Window.partitionBy("_bucket").orderBy(F.col("_ghost"), F.col("_i").desc(), "_h")
    return dealt.select("_bucket", F.row_number().over(order).alias("_rn"), "_ghost", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited_fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike it is to the edited and to the next text.

    The edited text has its last third replaced by the beginning of the next document.
    """
    rows = dealt_with_next(docs)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    digest = F.sha2("_edited", 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("bigint").alias(f"_q{k}") for k in range(4)]  # as longs, which an aggregate keeps in place
    texts = rows.withColumn("_edited", F.when(F.col("_ghost") == 0, edited)).select("_bucket", "_rn", "_ghost", "doc_id", "text", "_edited", size.cast("bigint").alias("n_chars"), *quarters)
    sampled = samples(texts, ["_bucket", "_rn"], ["text", "_edited"], n=n, carry=("_ghost", "doc_id", "n_chars", "_q0", "_q1", "_q2", "_q3"))
    sha = F.concat(*(F.lower(F.lpad(F.hex(f"_q{k}"), 16, "0")) for k in range(4)))
    following = F.lead("_s0").over(Window.partitionBy("_bucket").orderBy("_rn"))
    return (
        sampled.withColumn("_next", following)
        .where("_ghost = 0")
        .select("doc_id", "n_chars", sha.alias("edited_sha256"), hex_of(F.col("_s0")).alias("fingerprint"), hex_of(F.col("_s1")).alias("edited_fingerprint"), likeness(F.col("_s0"), F.col("_s1")).alias("near_edited"), likeness(F.col("_s0"), F.col("_next")).alias("near_next"))
    )
