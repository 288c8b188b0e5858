"""A stored positional inverted index of text columns, kept in step with upserts.

A posting is a row (token, word, col, pos, id, version): ``token`` a word in lower case without accents, ``word`` the same with them, or null if
it has none. A segment is sorted runs: each task writes the postings of the texts that it reads by token, so that the statistics of the stored pages prune a token, or a
beginning of one, to a range of each run; no posting is moved, and a very common token is in many runs. A phrase is postings of its words that agree in document, column and starting place: an aggregation of the postings
that match, not a scan of the texts.

Changes are further segments: an upsert writes the postings of the new texts alone, with the next version, and notes the ids; a
deletion notes ids alone. Postings of an id older than its last note are dead, and are left out after matching, so that the
matches and not the index are joined with the notes. ``compact`` makes one segment again.

A null text has no postings; a null id belongs to no document and is left out; of rows with one id all texts count. A query without a word finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.sources.storage import stored

SEARCHED = ("name", "qualified_name", "code_snippet")
#: Of the columns of SEARCHED those in which a keyword also counts within a word.
NAMES = 2
#: Terms a 64-bit mask holds.
MASK = 60


def postings(rows: DataFrame, columns: tuple[str, ...], key: str, version: int) -> DataFrame:
    """(token, word, col, pos, id, version) of the texts in ``columns``; places count from 0 in each column."""
    texts = F.array(*(F.struct(F.lit(n).alias("col"), T.words(c).alias("words")) for n, c in enumerate(columns)))
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.inline(texts)).select("id", "col", F.posexplode("words").alias("pos", "word"))
    token = T.folded_word("word")
    return each.select(token.alias("token"), F.when(token != F.col("word"), F.col("word")).alias("word"), "col", "pos", "id", F.lit(version).alias("version"))


def sorted_segment(df: DataFrame) -> DataFrame:
    """Written as runs, each in the order of tokens. The order within a token is left open, since no search reads it."""
    return stored(df.sortWithinPartitions("token"), "postings")


class TextIndex:
    """``segments`` of postings, and ``changes`` (id, version): since when an id's older postings are dead."""

    def __init__(self, segments: list[DataFrame], changes: DataFrame | None, version: int, columns: tuple[str, ...], key: str):
        self.segments, self.changes, self.version, self.columns, self.key = segments, changes, version, columns, key

    @classmethod
    def build(cls, rows: DataFrame, columns: tuple[str, ...] = SEARCHED, key: str = "id") -> TextIndex:
        return cls([sorted_segment(postings(rows, columns, key, 0))], None, 0, columns, key)

    # --- upkeep ----------------------------------------------------------------

    def upsert(self, rows: DataFrame) -> TextIndex:
        """The index with the texts of ``rows`` in the place of those of the same ids."""
        version = self.version + 1
        segment = sorted_segment(postings(rows, self.columns, self.key, version))
        return TextIndex([*self.segments, segment], self._noted(rows.select(F.col(self.key).alias("id")), version), version, self.columns, self.key)

    def delete(self, ids: DataFrame) -> TextIndex:
        """The index without the documents of ``ids`` (id)."""
        version = self.version + 1
        return TextIndex(self.segments, self._noted(ids.select("id"), version), version, self.columns, self.key)

    def compact(self) -> TextIndex:
        """The same index as one segment without notes."""
        return TextIndex([sorted_segment(self._live(self._all()).withColumn("version", F.lit(0)))], None, 0, self.columns, self.key)

    def tables(self) -> dict[str, DataFrame]:
        """Tables for a catalog's batch, from which ``of_tables`` makes the index again."""
        out = {"postings": self._all(), "posting_changes": self.changes}
        return {k: v for k, v in out.items() if v is not None}

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame], columns: tuple[str, ...] = SEARCHED, key: str = "id") -> TextIndex:
        changes = tables.get("posting_changes")
        newest = tables["postings"].agg(F.max("version")).first()[0] or 0
        if changes is not None:
            newest = max(newest, changes.agg(F.max("version")).first()[0] or 0)
        return cls([tables["postings"]], changes, newest, columns, key)

    def _noted(self, ids: DataFrame, version: int) -> DataFrame:
        fresh = ids.where("id IS NOT NULL").distinct().withColumn("version", F.lit(version))
        every = fresh if self.changes is None else self.changes.unionByName(fresh)
        return stored(every.groupBy("id").agg(F.max("version").alias("version")), "posting-changes")

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.segments)

    def _live(self, found: DataFrame) -> DataFrame:
        if self.changes is None:
            return found
        since = self.changes.select("id", F.col("version").alias("_since"))
        return found.join(since, "id", "left").where(F.col("_since").isNull() | (F.col("version") >= F.col("_since"))).drop("_since")

    # --- search ----------------------------------------------------------------

    def search(self, query: str) -> DataFrame:
        """(id) of the documents with all phrases of the query, each within one column; the last word of the last phrase is a beginning."""
        phrases = T.fts_terms(query)
        if not phrases:
            return self._all().select("id").limit(0)
        slots = [(p, k, _token(w, prefix and k == len(words) - 1)) for p, (words, prefix) in enumerate(phrases) for k, w in enumerate(words)]
        hits = self._all().where(reduce(Column.__or__, [c for _, _, c in slots]))
        if all(len(words) == 1 for words, _ in phrases):
            whole = hits.select("id", "version", F.explode(_where([(F.lit(p), c) for p, _, c in slots])).alias("p"))
        else:
            placed = hits.select("id", "version", "col", "pos", F.explode(_where([(F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(len(phrases[p][0])).alias("n")), c) for p, k, c in slots])).alias("s"))
            begun = placed.select("id", "version", "col", (F.col("pos") - F.col("s.k")).alias("start"), "s.p", "s.n", "s.k")
            whole = begun.groupBy("id", "version", "col", "start", "p", "n").agg(F.count_distinct("k").alias("_k")).where("_k = n")
        return self._live(whole.groupBy("id", "version").agg(F.size(F.collect_set("p")).alias("_p")).where(F.col("_p") == len(phrases))).select("id").distinct()

    def seeds(self, task: str) -> DataFrame:
        """(id, keywords_matched, typed_matched): how many stems of a task's keywords, and how many keywords as typed, begin a word or lie in a name."""
        pairs = T.keyword_stems(self.segments[0].sparkSession, task)
        stems, typed = sorted({s for _, s in pairs}), sorted({w for w, _ in pairs})
        if not pairs:
            return self._all().select("id", F.lit(0).alias("keywords_matched"), F.lit(0).alias("typed_matched")).limit(0)
        counts = _matched(stems, "keywords_matched") + _matched(typed, "typed_matched")
        hits = self._all().where(reduce(Column.__or__, [_seeded(t) for t in stems]))  # a typed word begins with its stem
        found = self._live(hits.groupBy("id", "version").agg(*(F.bit_or(mask).alias(name) for name, mask in counts)))
        total = {out: reduce(Column.__add__, [F.bit_count(name) for name, _ in counts if name.startswith(out)]) for out in ("keywords_matched", "typed_matched")}
        return found.select("id", total["keywords_matched"].cast("int").alias("keywords_matched"), total["typed_matched"].cast("int").alias("typed_matched")).where("keywords_matched > 0")

    def has_seed(self, task: str) -> bool:
        return not self.seeds(task).isEmpty()


def _token(word: str, prefix: bool) -> Column:
    return F.col("token").startswith(word) if prefix else F.col("token") == word


def _seeded(term: str) -> Column:
    return F.col("token").startswith(term) | ((F.col("col") < NAMES) & F.coalesce("word", "token").contains(term))


def _where(options: list[tuple[Column, Column]]) -> Column:
    """The values whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, value) for value, c in options)))


def _matched(terms: list[str], name: str) -> list[tuple[str, Column]]:
    """Columns of 64-bit masks, a bit a term."""
    out = []
    for at in range(0, len(terms), MASK):
        bits = [F.when(_seeded(t), F.lit(1 << n).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for n, t in enumerate(terms[at : at + MASK])]
        out.append((f"{name}_{at}", reduce(Column.bitwiseOR, bits)))
    return out
