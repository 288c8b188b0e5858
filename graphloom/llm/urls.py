"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the pairs of its host's suffixes (at label bounds) and
its path's prefixes that a rule could have; the expressions meet the rules by an equi-join on a
short prefix of their SHA-256, which brings all rules of that prefix; the full digests then
confirm the match, and the longest rule wins. The rules are broadcast where they are at
most BROADCAST, else the join is left to Spark. The expansion is bounded by the rules: suffixes have at most
as many labels as the longest rule, prefixes only the lengths of rule paths.

URLs are judged once each, so that a URL that many pages share is one row, and
the verdicts join the pages by the URL itself.

Rules are (host, path, verdict); a rule fits its host and all subdomains if the
URL's path starts with its path. The longest rule (host and path together) wins,
then the one with the longer host. Without a rule the verdict is ``allow``.

Defined cases: a null URL or one without ``://`` has an empty host and path,
which fit no rule; rows that repeat are judged each; the columns of ``pages`` are
kept but for those that this operator adds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower

#: The rules of the site list, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: Hex digits of a digest that the join is on.
SHORT = 8
#: Rules that are sent to every executor, some 200 bytes each.
BROADCAST = 50_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = {}
    for host, path, verdict in rules:
        digest = hashlib.sha256(f"{host}\n{path}".encode()).hexdigest()
        rows[digest] = (digest[:SHORT], digest, host + path, len(host) + len(path), len(host), verdict)
    return spark.createDataFrame(list(rows.values()), "short string, digest string, rule string, size int, host_size int, verdict string")


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    added = ("host", "path", "rule", "verdict")
    base = pages.drop(*(c for c in pages.columns if c.lower() in added and c != url))
    link = F.col(url).cast("string")
    distinct = base.select(link.alias("_u")).where("_u IS NOT NULL").distinct()
    parts = F.split("_h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_p")), lambda n: F.substring(F.col("_p"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    expressions = (
        distinct.select("_u", host_of(F.col("_u")).alias("_h"), path_of(F.col("_u")).alias("_p"))
        .select("_u", F.explode(pairs).alias("_e"))
        .select("_u", F.sha2("_e", 256).alias("_d"))
        .withColumn("_s", F.substring("_d", 1, SHORT))
    )
    known = rule_table(pages.sparkSession, rules).groupBy("short").agg(F.collect_list(F.struct("digest", "size", "host_size", "rule", "verdict")).alias("_rules"))  # a short prefix's rules
    met = expressions.join(F.broadcast(known) if len(rules) <= BROADCAST else known, F.col("_s") == F.col("short"))
    confirmed = met.select("_u", F.explode(F.filter("_rules", lambda r: r["digest"] == F.col("_d"))).alias("_r"))
    hits = confirmed.select("_u", "_r.*")
    best = hits.groupBy("_u").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("_r"))
    found = best.select("_u", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))
    keyed = base.select(F.struct(*(base[c] for c in base.columns)).alias("_row"), link.alias("_link"))  # no other column's name can clash
    joined = keyed.join(found, F.col("_link") == F.col("_u"), "left")
    own = [host_of(F.col("_link")), path_of(F.col("_link")), F.col("rule"), F.coalesce("verdict", F.lit(DEFAULT))]
    return joined.select("_row.*", *(c.alias(n) for c, n in zip(own, added)))
