"""What the scanners share: rows, blanking of strings and comments, bracket matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A scanner's row. ``kind``: node, method, ref, call, import, wildcard, package, super, entry, table_ref, shape.
ROWS = "kind string, language string, file_path string, id string, type string, name string, qualified_name string, line int, snippet string, source_id string, target string, owner string, n int"
FIELDS = [x.strip().split(" ")[0] for x in ROWS.split(",")]


def row(kind: str, **values) -> dict:
    return {f: None for f in FIELDS} | {"kind": kind} | values


def blank(text: str, line: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", triple: bool = False, strings: bool = True) -> str:
    """The text with comments, and the inside of strings, as spaces of the same length; line ends stay."""
    parts = [re.escape(x) + r"[^\n]*" for x in line]
    if block:
        parts.append(re.escape(block[0]) + r"(?s:.*?)(?:" + re.escape(block[1]) + r"|\Z)")
    if triple:
        parts.append(r"(?s:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))")
    body = [re.escape(q) + r"(?:\\.|[^\\" + re.escape(q) + (r"\n" if q != "`" else "") + r"])*(?:" + re.escape(q) + r")?" for q in quotes]
    find = re.compile("|".join(f"(?P<c{n}>{p})" for n, p in enumerate(parts)) + ("|" if parts and body else "") + "|".join(f"(?P<s{n}>{p})" for n, p in enumerate(body)))

    def keep(m: re.Match) -> str:
        s = m[0]
        if m.lastgroup and m.lastgroup.startswith("s"):
            if not strings:
                return s
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s
        return re.sub(r"[^\n]", " ", s)

    return find.sub(keep, text)


def match(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at ``at`` closes; the end of the text if it does not. ``text`` is blanked."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that lie in no bracket."""
    out, depth, last = [], 0, 0
    for n, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}" and not (c == ">" and n and text[n - 1] in "-="):
            depth -= 1
        elif c == separator and depth <= 0:
            out.append(text[last:n])
            last = n + 1
    out.append(text[last:])
    return [x.strip() for x in out if x.strip()]


def simple(written: str) -> str:
    """A parameter's type as method ids show it."""
    t = (written or "").strip()
    if not t:
        return "?"
    if t.startswith("{"):
        return "object"
    if "=>" in t:
        return "fn"
    t = t.split("<", 1)[0].replace("...", "").replace("[]", "")
    return re.sub(r"\s+", "", t.rsplit(".", 1)[-1])


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def snippet(text: str, at: int, lines: int = 10) -> str:
    start = text.rfind("\n", 0, at) + 1
    return "\n".join(text[start:].split("\n", lines)[:lines])


def table_names(sql: str) -> Iterator[str]:
    for m in re.finditer(r"(?i)\b(?:from|join|into|update)\s+[\"`]?([a-z_][\w.]*)", sql):
        yield m[1].lower().rsplit(".", 1)[-1]
