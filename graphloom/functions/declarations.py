"""Declarations cut out of snippets, as column functions. Brackets and quotes are followed in batches in Python, once a snippet."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.ids import fence_language

#: Languages whose snippets are whole bodies.
WHOLE = ("bash", "sql", "python")
# Words before a type's name, and those that begin a clause of its header.
TYPE_WORDS = ("class", "interface", "record", "enum", "trait", "mixin")
CLAUSE_WORDS = ("extends", "implements", "permits", "with")


#: A line that is blank or a comment of its own, and lines from one that begins with a block comment to the one that ends it.
_NOT_CODE = r"(?md)^[\s&&[^\n]]*+(?:/(?=\*)(?s:.*?\*/[^\n]*+|.*+)|//[^\n]*+)?(?:\n|\z)"


def without_comments(snippet: Column) -> Column:
    """The lines that are neither blank nor comments of their own, each without blanks at its end and with a line end."""
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace(snippet, r"\r\n?", "\n"), _NOT_CODE, ""), r"(?<!\s)[\s&&[^\n]]++(?=\n|\z)", "")
    return F.regexp_replace(code, r"([^\n])\z", "$1\n")


_CUTS = re.compile(r"""(?s)"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[(){;]""")


def cut_at(text: str) -> int:
    """Where a text's first ``{``, or what follows its first ``;``, lies in no parenthesis and no quotes; -1 if nowhere."""
    depth = 0
    for m in _CUTS.finditer(text):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth <= 0 and c in ("{", ";"):
            return m.start() + (c == ";")
    return -1


@F.pandas_udf(StringType())
def _cut(texts: pd.Series) -> pd.Series:
    """Each text up to its cut."""
    return pd.Series([None if t is None else t if (at := cut_at(t)) < 0 else t[:at] for t in texts], dtype=object)


def marked(text: str) -> str:
    """What lies in angle brackets or parentheses, and they themselves, with a mark after each character; commas there as another character."""
    depth, out, last = 0, [], 0
    for m in re.finditer(r"[<(>)]", text):
        part, c = text[last : m.start()], m[0]
        last = m.end()
        out.append(part if depth == 0 else "".join(f"{x}\x03" for x in part.replace(",", "\x02")))
        if c in "<(":
            depth += 1
        out.append(c if depth == 0 else c + "\x03")
        if c in ">)":
            depth = max(depth - 1, 0)
    part = text[last:]
    out.append(part if depth == 0 else "".join(f"{x}\x03" for x in part.replace(",", "\x02")))
    return "".join(out)


@F.pandas_udf(StringType())
def _marked(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else marked(t) for t in texts], dtype=object)


def declaration(snippet: Column, path: Column) -> Column:
    """Annotations and signature of a stored snippet, without comments and body; snippets of languages without braces stay, a null is empty."""
    return F.when(snippet.isNull(), "").when(fence_language(F.coalesce(path, F.lit(""))).isin(*WHOLE), snippet).otherwise(F.regexp_replace(_cut(without_comments(snippet)), r"^\s+|\s+$", ""))


def supertype_clause(snippet: Column, path: Column, word: str) -> Column:
    """The names after the first ``word`` (extends or implements) of a type's header, as written, in order.

    Only the top level of the header counts: what lies in angle brackets or parentheses is marked, so that neither its words nor its commas are read.
    """
    head = r"(?s)\b(?:" + "|".join(TYPE_WORDS) + r")\s+\w+(.*)$"
    tail = F.when(fence_language(F.coalesce(path, F.lit(""))).isin(*WHOLE), "").otherwise(F.regexp_extract(declaration(snippet, path), head, 1))

    clause = F.regexp_extract(_marked(tail), rf"(?s)\b{word}\b(.*?)(?:\b(?:{'|'.join(CLAUSE_WORDS)})\b|$)", 1)
    names = F.transform(F.split(clause, ","), lambda n: F.trim(F.regexp_replace(F.translate(n, "\x02\x03", ","), r"\s+", " ")))
    return F.filter(names, lambda n: n != "")
