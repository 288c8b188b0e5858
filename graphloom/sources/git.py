"""Histories and diffs as git writes them, read as tables.

``git log -m --first-parent --name-only --format=%x01%H%x09%ct`` gives a history, in which a merge changes what it brings to its first
parent, and ``git diff -U0 <ref>`` the changes of a working tree; both are text that Spark splits at a commit or a file, so that a long history
is many tasks. Git puts unusual paths in quotes and writes their bytes as octal numbers; they are read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import impact

_HUNK = r"(?m)^@@ -\d+(?:,\d+)? (\+\d+(?:,\d+)?) @@"


_ESCAPE = r"(\\[0-7]{3}|\\.|[^\\]+)"
# What git writes for these bytes within quotes.
_SHORT = {"\\a": "07", "\\b": "08", "\\t": "09", "\\n": "0A", "\\v": "0B", "\\f": "0C", "\\r": "0D", '\\"': "22", "\\\\": "5C"}


def _plain(path: Column) -> Column:
    """A path as it is: without quotes, and with the bytes that octal numbers and escapes stand for."""
    inner = F.regexp_extract(path, '^"(.*)"$', 1)

    def as_hex(part: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(part, 2, 3), 8, 16), 2, "0")
        short = F.coalesce(*(F.when(part == k, F.lit(v)) for k, v in _SHORT.items()), F.hex(F.encode(part, "UTF-8")))
        return F.when(part.rlike(r"^\\[0-7]{3}$"), octal).otherwise(short)

    read = F.decode(F.unhex(F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(_ESCAPE), F.lit(1)), as_hex), "")), "UTF-8")
    return F.when(path.rlike('^".*"$'), read).otherwise(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(commit, seq, file): a row a file that a commit changed; ``seq`` is the commit's time. A commit without files has no row."""
    records = spark.read.option("lineSep", "\x01").text(path).where("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    files = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x != "")
    each = records.select(F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).cast("bigint").alias("seq"), F.explode(files).alias("file"))
    return each.select("commit", "seq", _plain(F.col("file")).alias("file"))


def diff(spark: SparkSession, path: str) -> DataFrame:
    """(path, state, hunks): a row a file of a diff; state is added, deleted or changed, hunks an array of (begin_b, end_b).

    Lines count from 0 on the new side and the end is left out; a hunk that only deletes has equal ends. A renamed file has its new
    path. Binary files have no hunks.
    """
    records = spark.read.option("lineSep", "\ndiff --git ").text(path).where("trim(value) <> ''")
    header = F.concat(F.lit("\n"), F.substring_index(F.concat(F.lit("\n"), F.col("value")), "\n@@", 1))
    sides = (_plain(F.regexp_extract(header, rf'\n{mark} ("[ab]/[^\n]*"|[ab]/[^\n\t]*)\t?(?:\n|$)', 1)) for mark in ("---", r"\+\+\+"))
    old, new = (F.regexp_replace(side, "^[ab]/", "") for side in sides)
    renamed = _plain(F.regexp_extract(header, r"\nrename to ([^\n]*)", 1))
    named = F.regexp_extract("value", r'^(?:diff --git )?"?a/(.*?)"? "?b/', 1)
    state = F.when(header.contains("\ndeleted file mode"), "deleted").when(header.contains("\nnew file mode"), "added").otherwise("changed")
    name = F.when(new != "", new).when(renamed != "", renamed).when(old != "", old).otherwise(named)

    def lines(found):
        at = F.split(F.substring(found, 2, 100), ",")
        first, n = F.get(at, F.lit(0)).cast("int"), F.coalesce(F.get(at, F.lit(1)).cast("int"), F.lit(1))
        begin = F.when(n == 0, first).otherwise(first - 1)
        return F.struct(begin.alias("begin_b"), (begin + n).alias("end_b"))

    hunks = F.transform(F.regexp_extract_all("value", F.lit(_HUNK), F.lit(1)), lines)
    return records.select(name.alias("path"), state.alias("state"), hunks.alias("hunks"))


def hunks(files: DataFrame) -> DataFrame:
    """(path, begin_b, end_b) of a diff's files, as ``impact.changed_spans`` takes them."""
    return files.select("path", F.inline("hunks"))


def changed_symbols(files: DataFrame, nodes: DataFrame, spans: DataFrame, types: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """(id, reason) of the symbols that a diff touches; ``spans`` and ``types``: (id, path, begin, end) of methods and of types, lines from 1.

    All symbols of a deleted file are ``removed``, and so are, with ``parsed`` (id), the indexed methods of a changed Java file that it no longer has.
    Of a Java file the methods that a hunk touches are ``modified``. Where a line of a hunk lies in no method, the innermost type around the hunk's first line
    is too, or, around none, all types of the file; of other files all types. Files without a symbol give no row.
    """
    own = nodes.select("id", "type", F.col("file_path").alias("path"))
    gone = own.join(files.where("state = 'deleted'").select("path"), "path", "left_semi").select("id")
    left = files.where("state <> 'deleted'")
    java = left.where(F.col("path").endswith(".java"))
    own_methods, own_types = own.where("type = 'METHOD'"), own.where("type <> 'METHOD'")
    if parsed is not None:
        gone = gone.unionAll(own_methods.join(java.select("path"), "path", "left_semi").select("id").join(parsed.select("id"), "id", "left_anti"))
    touched = hunks(java)
    methods = impact.changed_spans(touched, spans).join(own_methods.select("id"), "id", "left_semi").select("id")
    outside = impact.covered_hunks(touched, spans).where("NOT covered").select("path", (F.col("begin_b") + 1).alias("line")).distinct()
    if types is not None:
        around = impact.innermost(outside, types.join(own_types.select("id"), "id", "left_semi"))
        methods = methods.unionAll(around.select("id"))
        outside = outside.join(around, ["path", "line"], "left_anti")
    by_file = outside.select("path").unionAll(left.where(~F.col("path").endswith(".java")).select("path")).distinct()
    whole = own_types.join(by_file, "path", "left_semi").select("id")
    changed = methods.unionAll(whole).distinct().join(gone, "id", "left_anti")
    return gone.distinct().withColumn("reason", F.lit("removed")).unionAll(changed.withColumn("reason", F.lit("modified")))
