"""Java: types, methods, and the names that they refer to."""

from __future__ import annotations

import re

from graphloom.extract.scan import blank, line_of, match, row, simple, snippet, split_top, table_names

_TYPE = re.compile(r"(?P<notes>(?:@[\w.]+\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)(?P<mods>(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)")
_METHOD = re.compile(
    r"(?P<notes>(?:@[\w.]+\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)(?P<mods>(?:(?:public|protected|private|static|final|abstract|default|synchronized|native)\s+)*)(?:<[^>{};]*>\s*)?(?:(?P<ret>[\w.]+(?:<[^(){};=]*>)?(?:\s*\[\])*)\s+)?(?P<name>\w+)\s*\("
)
_FIELD = re.compile(r"(?:@[\w.]+\s*(?:\([^()]*\))?\s*)*(?:(?:public|protected|private|static|final|volatile|transient)\s+)+(?P<type>[\w.]+(?:<[^(){};=]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?=[;=,])")
_CALL = re.compile(r"(?:(?P<recv>\b[\w]+)\s*(?:\.|(?P<ref>::))\s*)?(?P<new>\bnew\s+)?(?P<name>\b[A-Za-z_]\w*)\s*(?P<args>\(|(?<=::)\b)")
_LOCAL = re.compile(r"\b(?P<type>[A-Z][\w.]*(?:<[^(){};=]*>)?(?:\[\])*)\s+(?P<name>[a-z_]\w*)\s*(?=[=;:,)])")
# Words before a parenthesis that are no calls.
WORDS = ("if", "for", "while", "switch", "catch", "return", "synchronized", "new", "super", "this", "throw", "else", "try", "assert", "do", "case", "instanceof")
# Bases that a framework provides and that make no EXTENDS edge.
FRAMEWORK_BASES = ("AggregateRoot", "EventApplier", "AbstractEntity", "BaseEntity")
# What marks a project as domain-driven, or as one of a web framework.
DDD_MARKERS = r"CommandBus|AggregateRoot|implements\s+Command<|implements\s+CommandHandler<|implements\s+QueryHandler<"
SPRING_MARKERS = r"@RestController|@Service|@Repository|@Entity|@SpringBootApplication"
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}


def annotation_names(notes: str) -> list[str]:
    return [x.rsplit(".", 1)[-1] for x in re.findall(r"@([\w.]+)", notes or "")]


def annotation_text(notes: str, name: str) -> str:
    m = re.search(r"@" + name + r"\s*\(([^)]*)\)", notes or "")
    return (re.search(r'"([^"]*)"', m[1]) or [None, ""])[1] if m else ""


def classify(kind: str, name: str, notes: str, extends: list[str], implements: list[str], body: str, tier: str) -> str:
    """The node type of a declaration; the first rule that fits."""
    marks = annotation_names(notes)
    if kind == "enum":
        return "ENUM"
    if kind == "record":
        for x in implements if tier == "DDD" else []:
            if simple(x) in ("Command", "Query"):
                return simple(x).upper()
        return "RECORD"
    if tier == "DDD":
        for base in map(simple, extends):
            if base == "AggregateRoot":
                return "AGGREGATE"
            if base == "EventApplier":
                return "EVENT_APPLIER"
            if base.endswith("Event"):
                return "DOMAIN_EVENT"
            if kind == "interface" and base.endswith("Repository"):
                return "REPOSITORY"
        for base in map(simple, implements):
            if base in ("CommandHandler", "QueryHandler"):
                return "COMMAND_HANDLER" if base == "CommandHandler" else "QUERY_HANDLER"
        if "Component" in marks and "@EventHandler" in body:
            if "viewRepository.save" in body:
                return "PROJECTION_HANDLER"
            if "commandBus.dispatch" in body:
                return "EVENT_LISTENER"
    if tier in ("CRUD", "DDD"):
        for mark, type_ in (("RestController", "CONTROLLER"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Mapper", "MAPPER")):
            if mark in marks:
                return type_
        if "Entity" in marks:
            return "VIEW" if annotation_text(notes, "Table").endswith("_view") else "ENTITY"
        if "Configuration" in marks or "Component" in marks:
            return "CONFIGURATION"
    for suffix in ("Controller", "Service", "Repository"):
        if name.endswith(suffix):
            return suffix.upper()
    return "INTERFACE" if kind in ("interface", "@interface") else "CLASS"


def header(text: str) -> tuple[list[str], list[str], list[str]]:
    """(extends, implements, record components) of what lies between a type's name and its body."""
    parts = {"extends": [], "implements": []}
    at = text.find("(")
    components = split_top(text[at + 1 : match(text, at, "()")]) if at >= 0 else []
    for m in re.finditer(r"\b(extends|implements|permits)\b((?:(?!\b(?:extends|implements|permits)\b)[^{])*)", text):
        if m[1] in parts:
            parts[m[1]] = split_top(m[2])
    return parts["extends"], parts["implements"], components


def parameter(text: str) -> tuple[str, str]:
    """(type, name) of a written parameter."""
    t = re.sub(r"@[\w.]+(?:\([^)]*\))?\s*|\bfinal\s+", "", text).strip()
    m = re.match(r"(?s)(.*\S)\s+(\w+)((?:\[\])*)$", t)
    return (m[1] + m[3], m[2]) if m else ("", t)


def extract(path: str, text: str, tier: str = "GENERIC", entry_types: bool = True) -> list[dict]:
    """All rows of one file."""
    code = blank(text)
    plain = blank(text, strings=False)
    rows: list[dict] = []
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code) or ["", ""])[1]
    rows.append(row("package", name=package))
    for m in re.finditer(r"(?m)^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", code):
        kind = ("static_" if m[1] else "") + ("wildcard" if m[3] else "import")
        rows.append(row(kind, name=m[2].rsplit(".", 1)[-1], target=m[2]))
    _types(rows, path, text, code, plain, 0, len(code), package, "", tier)
    for r in rows:
        r.update(language="java", file_path=path)
    return rows


def _types(rows, path, text, code, plain, start, end, package, outer, tier) -> list[tuple[int, int]]:
    spans = []
    at = start
    while m := _TYPE.search(code, at, end):
        open_at = code.find("{", m.end())
        if open_at < 0 or open_at >= end:
            break
        close = match(code, open_at)
        name = m["name"]
        id_ = f"{outer}.{name}" if outer else (f"{package}.{name}" if package else name)
        notes = plain[m.start("notes") : m.end("notes")]
        extends, implements, components = header(code[m.end() : open_at])
        if m["kind"] == "interface":
            supers = [("EXTENDS", x) for x in extends]
        else:
            supers = [("EXTENDS", x) for x in extends] + [("IMPLEMENTS", x) for x in implements]
        body = text[open_at:close]
        type_ = classify(m["kind"], name, notes, extends, implements, body, tier)
        first = m.start("notes") if m["notes"] else m.start("mods") if m["mods"] else m.start("kind")
        rows.append(row("node", id=id_, type=type_, name=name, qualified_name=id_, line=line_of(text, m.start("kind")), snippet=snippet(text, first), owner=outer or None))
        for kind, x in supers:
            rows.append(row("super", source_id=id_, type=kind, target=x.split("<")[0].strip()))
            if x.split("<")[0].strip() not in FRAMEWORK_BASES:
                rows.append(row("ref", source_id=id_, type=kind, target=x.split("<")[0].strip(), owner=id_))
        if "Command" in annotation_names(notes) and any(r["kind"] == "import" and r["target"] == "picocli.CommandLine.Command" for r in rows):
            rows.append(row("entry", id=id_))
        nested = _types(rows, path, text, code, plain, open_at + 1, close, package, id_, tier)
        _members(rows, text, code, plain, open_at + 1, close, nested, id_, name, type_, notes, components, tier)
        for t in [annotation_text(notes, "Table")] if "Table" in annotation_names(notes) else []:
            rows.append(row("table_ref", source_id=id_, target=t.lower()))
        if "Entity" in annotation_names(notes) and "Table" not in annotation_names(notes):
            # The two patterns, in this order.
            snake = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"Entity$", "", name)))
            rows.append(row("table_ref", source_id=id_, target=snake.lower()))
        spans.append((m.start(), close + 1))
        at = close + 1
    return spans


def _members(rows, text, code, plain, start, end, nested, id_, name, type_, notes, components, tier) -> None:
    chars = list(code[start:end])
    for a, b in nested:
        chars[a - start : b - start] = " " * (b - a)
    body = "".join(chars)
    fields = {m["name"]: m["type"] for m in _FIELD.finditer(body)}
    for c in components:
        t, n = parameter(c)
        fields[n] = t
        rows.append(row("field", source_id=id_, name=n, target=t))
    base = annotation_text(notes, "RequestMapping")
    at = 0
    while m := _METHOD.search(body, at):
        close = match(body, m.end() - 1, "()")
        after = re.match(r"\s*(?:throws\s+[\w.,\s]+)?\s*(?:default\s+[^;]*)?([{;])", body[close + 1 :])
        if not after or m["name"] in WORDS or (m["ret"] in WORDS) or (m["ret"] is None and m["name"] != name):
            at = m.end()
            continue
        brace = close + 1 + after.end(1) - 1
        stop = match(body, brace) if after[1] == "{" else brace
        params = [parameter(p) for p in split_top(body[m.end() : close])]
        constructor = m["ret"] is None
        method = "<init>" if constructor else m["name"]
        mid = f"{id_}#{method}({','.join(simple(t) for t, _ in params)})"
        line = line_of(text, start + m.start("name"))
        marks = plain[start + m.start("notes") : start + m.end("notes")]
        if type_ not in ("RECORD", "ENUM", "ENTITY", "VIEW", "COMMAND", "QUERY", "DOMAIN_EVENT"):
            verb = next((f"{v} {base}{annotation_text(marks, a)}" for a, v in VERBS.items() if a in annotation_names(marks)), None)
            visibility = next((v for v in ("public", "protected", "private") if v in m["mods"]), "package")
            rows.append(row("method", id=mid, type="METHOD", name=method, qualified_name=mid, line=line, snippet=snippet(text, start + m.start("name")), owner=id_, target=m["ret"], source_id=visibility, n=line_of(text, start + stop)))
            if verb:
                rows.append(row("endpoint", id=mid, name=verb))
        if re.search(r"\bstatic\b", m["mods"]) and method == "main" and [simple(t) for t, _ in params] == ["String"]:
            rows.append(row("entry", id=id_))
        if constructor:
            for t, _ in params:
                rows.append(row("ref", source_id=id_, type="INJECTS", target=t.split("<")[0], owner=id_))
        elif m["ret"] and m["ret"][:1].isupper():
            rows.append(row("ref", source_id=id_, type="RETURNS_TYPE", target=m["ret"].split("<")[0].replace("[]", "").strip(), owner=id_))
            rows.append(row("returns", source_id=mid, target=m["ret"].split("<")[0].replace("[]", "").strip(), owner=id_, n=int("<" in m["ret"])))
        if after[1] == "{":
            _calls(rows, body[brace:stop], id_, mid, fields | {n: t for t, n in params})
            _ddd(rows, body[brace:stop], marks, params, id_, type_, tier, method)
        at = stop + 1
    for literal in re.findall(r'"((?:\\.|[^"\\])*)"', text[start:end]):
        for t in table_names(literal):
            rows.append(row("table_ref", source_id=id_, target=t))


def _calls(rows, body, owner, mid, scope) -> None:
    """A row a call; ``line`` is its number in the method, and ``id`` the number of the call whose result it is made on."""
    names = dict(scope)
    opening, opened_by, pending = {}, {}, []
    for at, c in enumerate(body):
        if c == "(":
            pending.append(at)
        elif c == ")" and pending:
            opening[at] = pending.pop()
    for m in _LOCAL.finditer(body):
        names[m["name"]] = m["type"]
    for pos, m in enumerate(_CALL.finditer(body)):
        name, recv = m["name"], m["recv"]
        if name in WORDS or (recv in ("return", "else", "throw") and not m["new"]):
            continue
        opened = body.find("(", m.start("args")) if m["args"] == "(" else -1
        arity = len(split_top(body[opened + 1 : match(body, opened, "()")])) if opened >= 0 else -1
        if opened >= 0:
            opened_by[opened] = pos
        before = body[: m.start()].rstrip()
        chained = before.endswith(".")
        if m["new"] or re.search(r"\bnew\s+$", body[: m.start()]):
            rows.append(row("call", source_id=mid, owner=owner, target=name, name="<init>", n=arity, line=pos, type="new"))
            rows.append(row("ref", source_id=owner, type="CALLS_METHOD", target=name, owner=owner))
        elif recv is None and not chained:
            rows.append(row("call", source_id=mid, owner=owner, target=None, name=name, n=arity, line=pos, type="own"))
        elif recv == "this":
            rows.append(row("call", source_id=mid, owner=owner, target=None, name=name, n=arity, line=pos, type="own"))
        elif recv == "super":
            rows.append(row("call", source_id=mid, owner=owner, target=None, name=name, n=arity, line=pos, type="super"))
        elif recv in names:
            t = names[recv].split("<")[0]
            rows.append(row("call", source_id=mid, owner=owner, target=t, name=name, n=arity, line=pos, type="typed"))
            if recv in scope:
                rows.append(row("ref", source_id=owner, type="CALLS_METHOD", target=t, owner=owner))
        elif recv and recv[:1].isupper():
            rows.append(row("call", source_id=mid, owner=owner, target=recv, name=name, n=arity, line=pos, type="static"))
            rows.append(row("ref", source_id=owner, type="CALLS_METHOD", target=recv, owner=owner))
        elif chained:
            # the call whose arguments end before the dot
            parent = opened_by.get(opening.get(len(before[:-1].rstrip()) - 1))
            rows.append(row("call", id=None if parent is None else str(parent), source_id=mid, owner=owner, target=None, name=name, n=arity, line=pos, type="chain"))


def _ddd(rows, body, marks, params, owner, type_, tier, method) -> None:
    if tier != "DDD":
        return

    def ref(kind: str, target: str) -> None:
        rows.append(row("ref", source_id=owner, type=kind, target=target, owner=owner))

    for bus, kind in (("commandBus", "DISPATCHES_COMMAND"), ("queryBus", "DISPATCHES_QUERY")):
        for m in re.finditer(bus + r"\s*\.\s*\w+\s*\(\s*new\s+(\w+)", body):
            ref(kind, m[1])
    if type_ in ("COMMAND_HANDLER", "QUERY_HANDLER") and method == "handle" and params:
        ref("HANDLES", simple(params[0][0]))
    if type_ == "COMMAND_HANDLER":
        for m in re.finditer(r"(\w+)Repository\s*\.\s*(?:load|find|get)\w*\s*\(|(?:load|rehydrate)\w*\s*\(\s*(\w+)\.class", body):
            rows.append(row("aggregate_ref", source_id=owner, target=(m[1] or m[2]).lower()))
    if type_ == "AGGREGATE":
        for m in re.finditer(r"\b(?:apply|emit|raise|register)\w*\s*\(\s*new\s+(\w+)", body):
            ref("EMITS_EVENT", m[1])
    kind = {"EVENT_APPLIER": "APPLIES_EVENT", "PROJECTION_HANDLER": "PROJECTS_EVENT", "EVENT_LISTENER": "LISTENS_TO"}.get(type_)
    if kind and params and ("EventHandler" in marks or type_ == "EVENT_APPLIER"):
        ref(kind, simple(params[0][0]))
    view = re.sub(r"(Projection|Query)?Handler$|Projection$", "", owner.rsplit(".", 1)[-1]) + "View"
    if type_ == "PROJECTION_HANDLER" and re.search(r"\.\s*save\s*\(", body):
        ref("UPDATES_VIEW", view)
    if type_ == "QUERY_HANDLER" and re.search(r"\.\s*find\w*\s*\(", body):
        ref("READS_VIEW", view)


def shape_lines(rows: list[dict]) -> list[str]:
    """The canonical lines of a file's declarations, which do not change with its bodies."""
    out = []
    for r in rows:
        if r["kind"] in ("package", "import", "wildcard", "static_import", "static_wildcard"):
            out.append(f"{r['kind']} {r['target'] or r['name']}")
        elif r["kind"] in ("node", "super"):
            out.append(f"{r['kind']} {r['id'] or r['source_id']} {r['type']} {r['target'] or ''}")
        elif r["kind"] == "method":
            out.append(f"method {r['id']} {r['target']} {r['source_id']}")
    return sorted(out)
