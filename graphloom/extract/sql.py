"""SQL migrations: the schema that is left after all of them, in version order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from graphloom.extract.scan import line_of, row, snippet

_NAME = r"((?:[\w]+|\"[^\"]+\"|`[^`]+`)(?:\.(?:[\w]+|\"[^\"]+\"|`[^`]+`))*)"
_CREATE = re.compile(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?(?:materialized\s+)?(table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?" + _NAME)
_DROP = re.compile(r"(?is)^\s*drop\s+(?:materialized\s+)?(table|view|function|procedure)\s+(?:if\s+exists\s+)?(.+)$")
_RENAME = re.compile(r"(?is)^\s*alter\s+(table|view)\s+(?:if\s+exists\s+)?" + _NAME + r"\s+rename\s+to\s+" + _NAME)
_ALTER = re.compile(r"(?is)^\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?" + _NAME)
_REFERENCES = re.compile(r"(?is)\breferences\s+" + _NAME)


def bare(name: str) -> str:
    return name.rsplit(".", 1)[-1].strip('"`').lower()


def version_key(path: str) -> tuple:
    """Versioned migrations by number, missing parts as zero, before all others by path."""
    m = re.match(r"[vV]([\d._]+?)__", path.rsplit("/", 1)[-1])
    if not m:
        return (1, (), path)
    parts = [int(x) for x in re.split(r"[._]", m[1]) if x]
    while parts and parts[-1] == 0:
        parts.pop()
    return (0, tuple(parts), path)


def statements(text: str) -> list[tuple[int, str]]:
    """(offset, statement) with comments as spaces; quotes and dollar quotes are kept whole."""
    find = re.compile(r"--[^\n]*|/\*(?s:.*?)\*/|'(?:''|[^'])*'|(\$\w*\$)(?s:.*?)\1|;")
    out, last, clean = [], 0, []
    at = 0
    for m in find.finditer(text):
        clean.append(text[at : m.start()])
        s = m[0]
        if s == ";":
            out.append((last, "".join(clean)))
            clean, last = [], m.end()
        elif s.startswith(("--", "/*")):
            clean.append(re.sub(r"[^\n]", " ", s))
        else:
            clean.append(s)
        at = m.end()
    clean.append(text[at:])
    out.append((last, "".join(clean)))
    return [(o, s) for o, s in out if s.strip()]


#: A change of a schema, as ``changes`` reads it from a file.
CHANGES = "op string, name string, other string, type string, line int, snippet string, refs array<string>"


def sort_key(path: str) -> tuple[int, list[str], str]:
    """``version_key`` in types that a table can be sorted by: numbers as text with their length before it."""
    late, parts, path = version_key(path)
    return late, [f"{len(str(x)):05d}{x}" for x in parts], path


def changes(text: str) -> Iterator[tuple]:
    """What the statements of a file change, in order: rows of ``CHANGES``. A reference is its kind and the bare name, after a blank."""
    for offset, s in statements(text):
        if m := _CREATE.match(s):
            kind, at = m[1].lower(), offset + len(s) - len(s.lstrip())
            type_ = {"table": "SQL_TABLE", "view": "SQL_VIEW"}.get(kind, "SQL_ROUTINE")
            if kind == "table":
                refs = {f"REFERENCES_FK {bare(x)}" for x in _REFERENCES.findall(s)}
            else:
                refs = {f"DERIVES_FROM {bare(x)}" for x in re.findall(r"(?is)\b(?:from|join)\s+" + _NAME, s)}
            yield "create", bare(m[2]), None, type_, line_of(text, at), snippet(text, at), sorted(refs)
        elif m := _RENAME.match(s):
            yield "rename", bare(m[2]), bare(m[3]), None, 0, None, []
        elif m := _DROP.match(s):
            for x in re.split(r",", re.sub(r"(?i)\b(cascade|restrict)\b.*", "", m[2])):
                yield "drop", bare(re.sub(r"\(.*", "", x.strip())), None, None, 0, None, []
        elif m := _ALTER.match(s):
            yield "alter", bare(m[1]), None, None, 0, None, sorted({f"REFERENCES_FK {bare(x)}" for x in _REFERENCES.findall(s)})


class Schema:
    """The objects that exist after the changes so far, what they refer to, and where renamed names went.

    A change touches its own names alone, so that names that no renaming joins can be kept in different schemas.
    """

    def __init__(self):
        self.live: dict[str, dict] = {}
        self.refs: dict[str, set[str]] = {}
        self.alias: dict[str, str] = {}

    def apply(self, path: str, op: str, name: str, other: str | None, type_: str | None, line: int, text: str | None, refs: Iterable[str]) -> None:
        if op == "create":
            self.live[name] = row("node", language="sql", file_path=path, id=f"sql:{name}", type=type_, name=name, qualified_name=name, line=int(line), snippet=text)
            self.alias.pop(name, None)
            self.refs[name] = set(refs)
        elif op == "drop":
            self.live.pop(name, None)
            self.refs.pop(name, None)
        elif name in self.live and op == "rename":
            self.live[other] = self.live.pop(name) | {"id": f"sql:{other}", "name": other, "qualified_name": other}
            self.refs[other] = self.refs.pop(name, set())
            self.alias[name] = other
            self.alias.pop(other, None)
        elif name in self.live:
            self.refs.setdefault(name, set()).update(refs)

    def current(self, name: str) -> str | None:
        seen = set()
        while name not in self.live and name in self.alias and name not in seen:
            seen.add(name)
            name = self.alias[name]
        return name if name in self.live else None

    def rows(self) -> Iterator[dict]:
        """The objects; their references by the names that were written (kind ``wanted``); names that are those of other objects now (``now``)."""
        yield from self.live.values()
        for name, found in self.refs.items():
            if name in self.live:
                for kind, target in (x.split(" ", 1) for x in sorted(found)):
                    yield row("wanted", language="sql", file_path=self.live[name]["file_path"], source_id=f"sql:{name}", type=kind, target=target)
        for name in self.alias:
            now = self.current(name)
            if now and name not in self.live:
                yield row("now", language="sql", name=name, target=f"sql:{now}")


def fold(files: list[tuple[str, str]]) -> list[dict]:
    """Rows of the objects that exist after all files, each where it was last created."""
    schema = Schema()
    for path, text in sorted(files, key=lambda f: version_key(f[0])):
        for change in changes(text):
            schema.apply(path, *change)
    made = list(schema.rows())
    now = {r["name"]: r["id"] for r in made if r["kind"] == "node"} | {r["name"]: r["target"] for r in made if r["kind"] == "now"}
    edges = [r | {"kind": "edge", "target": now[r["target"]]} for r in made if r["kind"] == "wanted" and r["target"] in now]
    return [r for r in made if r["kind"] == "node"] + [r for r in edges if r["source_id"] != r["target"]]
