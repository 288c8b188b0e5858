"""Identities of types and methods, and what can be read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTRUCTOR = "<init>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def type_id(package: Column | str, names: Column | str) -> Column:
    """Package and the simple names from the outermost type inwards; the default package adds nothing."""
    return F.concat_ws(".", F.when(_c(package) != "", _c(package)), _c(names))


def method_id(owner: Column | str, name: Column | str, params: Column | str) -> Column:
    return F.concat(_c(owner), F.lit("#"), _c(name), F.lit("("), F.array_join(F.transform(_c(params), simplify_type), ","), F.lit(")"))


def is_method_id(c: Column | str) -> Column:
    return F.instr(_c(c), "#") > 0


def declaring_class(c: Column | str) -> Column:
    return F.substring_index(_c(c), "#", 1)


def method_name(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"#([^(]*)", 1)


def is_constructor(c: Column | str) -> Column:
    return method_name(c) == CONSTRUCTOR


def short_label(c: Column | str) -> Column:
    """The simple class name with the member, without the package."""
    head = F.regexp_extract(declaring_class(c), r"([^.]*)$", 1)
    return F.when(is_method_id(c), F.concat(head, F.regexp_extract(_c(c), r"(?s)(#.*)$", 1))).otherwise(head)


def simplify_type(c: Column | str) -> Column:
    """A parameter's type without package, type arguments, array marks and blanks."""
    t = F.trim(_c(c))
    cut = F.regexp_replace(F.substring_index(t, "<", 1), r"\.\.\.|\[\]", "")
    last = F.regexp_replace(F.substring_index(cut, ".", -1), r"\s+", "")
    return F.when(t.isNull() | (t == ""), F.lit("?")).when(t.startswith("{"), F.lit("object")).when(F.instr(t, "=>") > 0, F.lit("fn")).otherwise(last)


def arity(c: Column | str) -> Column:
    """How many parameters a method id has; -1 if it has no parentheses."""
    inside = F.regexp_extract(_c(c), r"(?s)\((.*)\)", 1)
    return F.when(~_c(c).rlike(r"(?s)\(.*\)"), F.lit(-1)).when(F.trim(inside) == "", F.lit(0)).otherwise(F.size(F.split(inside, ",")))


def mermaid_id(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "[^a-zA-Z0-9]", "_")


def sql_object_id(c: Column | str) -> Column:
    return F.concat(F.lit("sql:"), F.lower(F.substring_index(_c(c), ".", -1)))


def snake_case(c: Column | str) -> Column:
    """OrderLineItem to order_line_item, HTTPServer to http_server."""
    # The two patterns, in this order.
    words = F.regexp_replace(_c(c), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(words, "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """The dotted names that two qualified names start with, joined by dots; empty if there are none."""
    left, right = F.split(_c(a), r"\."), F.split(_c(b), r"\.")
    same = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.array_join(F.slice(left, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")), ".")


#: The label of a code block by file extension.
FENCES = {"java": "java", "ts": "typescript", "groovy": "groovy", "dart": "dart", "py": "python", "sh": "bash", "sql": "sql"}


def fence_language(path: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))
    return F.coalesce(F.get(F.array(table[F.regexp_extract(_c(path), r"\.([^./]*)$", 1)]), 0), F.lit("java"))


def first_lines(text: Column | str, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(_c(text), "\n"), 1, n), "\n")


def line_at(text: Column | str, offset: Column | int) -> Column:
    """The line number, from 1, at a character offset from 0."""
    head = F.substring(_c(text), F.lit(1), offset if isinstance(offset, Column) else F.lit(offset))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
