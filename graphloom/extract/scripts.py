"""TypeScript, Dart, Groovy, Python and shell: declarations, calls and references of one file."""

from __future__ import annotations

import re

from graphloom.extract.scan import blank, line_of, match, row, simple, snippet, split_top, table_names

# --- TypeScript ------------------------------------------------------------------

_TS_CLASS = re.compile(r"export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>{]*>)?([^{]*)\{")
_MEMBER = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(\w+)\s*(?:<[^>(]*>)?\s*\(")
_CONTROL = ("if", "for", "while", "switch", "catch", "return", "function", "super", "constructor", "else", "new", "await", "assert")


def _ts_kind(name: str, before: str, rest: str) -> str:
    """The first rule that fits an exported class."""
    if "HttpInterceptor" in rest or name.endswith("Interceptor"):
        return "FE_INTERCEPTOR"
    if "CanActivate" in rest or name.endswith("Guard"):
        return "FE_GUARD"
    for mark, kind in (("@Injectable", "FE_SERVICE"), ("@Component", "FE_COMPONENT"), ("@Pipe", "FE_PIPE")):
        if mark in before:
            return kind
    return "FE_CLASS"


def typescript(path: str, text: str) -> list[dict]:
    code = blank(text)
    rows: list[dict] = []
    decorated = "@" in code and re.search(r"@(Injectable|Component|Pipe|Directive|NgModule)\b", code)

    def node(name: str, kind: str, at: int) -> None:
        if not any(r["kind"] == "node" and r["id"] == name for r in rows):
            rows.append(row("node", id=name, type=kind, name=name, qualified_name=name, line=line_of(text, at), snippet=snippet(text, at)))

    last = 0
    for m in _TS_CLASS.finditer(code):
        kind = _ts_kind(m[1], code[last : m.start()], m[2])
        close = match(code, m.end() - 1)
        if kind != "FE_CLASS" or not decorated:
            node(m[1], kind, m.start())
            _ts_members(rows, text, code, m.end(), close, m[1])
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            for x in split_top((re.search(word + r"\s+([^{]*?)(?=\bimplements\b|$)", m[2]) or ["", ""])[1]):
                rows.append(row("ref", source_id=m[1], type=edge, target=x.split("<")[0].strip(), owner=m[1]))
        last = close
    for pattern, kind in ((r"export\s+interface\s+(\w+)", "FE_MODEL"), (r"export\s+type\s+(\w+)\s*=", "FE_MODEL"), (r"export\s+(?:const\s+)?enum\s+(\w+)", "FE_ENUM")):
        for m in re.finditer(pattern, code):
            node(m[1], kind, m.start())
    for m in re.finditer(r"export\s+(?:const|function)\s+(\w+)([^\n;]*)", code):
        validator = "ValidatorFn" in m[2] or "ValidationErrors" in m[2] or m[1].endswith("Validator")
        guard = "CanActivateFn" in m[2]
        interceptor = "HttpInterceptorFn" in m[2]
        if interceptor or guard or validator:
            node(m[1], "FE_INTERCEPTOR" if interceptor else "FE_GUARD" if guard else "FE_VALIDATOR", m.start())
        elif m[0].startswith("export const"):
            node(m[1], "FE_CONSTANT", m.start())
    for m in re.finditer(r"\binject\s*\(\s*(\w+)", code):
        rows.append(row("inject", target=m[1]))
    return rows


def _ts_members(rows, text, code, start, end, owner) -> None:
    body = code[start:end]
    fields = {m[1]: m[2] for m in re.finditer(r"(\w+)\s*[:=]\s*(?:inject\s*\(\s*)?([A-Z]\w*)", body)}
    at = 0
    while m := _MEMBER.search(body, at):
        close = match(body, m.end() - 1, "()")
        opened = re.match(r"\s*(?::\s*[^{;=]+(?:\{[^}]*\})?[^{;=]*)?\{", body[close + 1 :])
        if m[1] in _CONTROL or not opened:
            at = m.end()
            continue
        types = [simple(p.partition(":")[2].partition("=")[0]) for p in split_top(body[m.end() : close])]
        mid = f"{owner}#{m[1]}({','.join(types)})"
        brace = close + opened.end()
        stop = match(body, brace)
        rows.append(row("method", id=mid, type="METHOD", name=m[1], qualified_name=mid, line=line_of(text, start + m.start(1)), snippet=snippet(text, start + m.start(1)), owner=owner, n=line_of(text, start + stop)))
        for pos, c in enumerate(re.finditer(r"\bthis\s*\.\s*(?:(\w+)\s*\.\s*)?(\w+)\s*\(", body[brace:stop])):
            target = fields.get(c[1]) if c[1] else None
            if c[1] is None or target:
                opened_at = brace + c.end() - 1
                rows.append(row("call", source_id=mid, owner=owner, target=target, name=c[2], n=len(split_top(body[opened_at + 1 : match(body, opened_at, "()")])), line=pos, type="typed" if target else "own"))
        at = stop + 1


# --- Dart ------------------------------------------------------------------------


# The node type that a Dart base gives, and the name endings of services.
DART_BASES = {
    "CommandHandler": "COMMAND_HANDLER", "QueryHandler": "QUERY_HANDLER", "Command": "COMMAND", "Query": "QUERY",
    "StatelessWidget": "FE_COMPONENT", "StatefulWidget": "FE_COMPONENT", "State": "FE_COMPONENT",
}
DART_SERVICES = ("Repository", "Reads", "Writes", "Store", "Bus", "Client")


def dart(path: str, text: str) -> list[dict]:
    code = blank(text, quotes="\"'", triple=True)
    rows: list[dict] = []
    claimed: set[str] = set()
    for m in re.finditer(r"(?m)^((?:(?:abstract|final|base|interface|sealed|mixin)\s+)*)(class|enum)\s+(\w+)([^{]*)\{", code):
        name, rest = m[3], m[4]
        if name.startswith("_") or name in claimed:
            continue
        claimed.add(name)
        bases = re.findall(r"\b(?:extends|implements|with)\s+([\w<>,\s]+?)(?=\bextends\b|\bimplements\b|\bwith\b|$)", rest)
        base = re.search(r"\bextends\s+(\w+)", rest)
        known = DART_BASES.get(base[1]) if base else None
        service = "interface" in m[1] or name.endswith(DART_SERVICES)
        kind = "FE_ENUM" if m[2] == "enum" else known or ("FE_SERVICE" if service else "FE_MODEL")
        rows.append(row("node", id=name, type=kind, name=name, qualified_name=name, line=line_of(text, m.start()), snippet=snippet(text, m.start())))
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS"), ("with", "IMPLEMENTS")):
            found = re.search(r"\b" + word + r"\s+(.*?)(?=\bextends\b|\bimplements\b|\bwith\b|$)", rest, re.S)
            for x in split_top(found[1]) if found else []:
                rows.append(row("ref", source_id=name, type=edge, target=x.split("<")[0].strip(), owner=name))
        close = match(code, m.end() - 1)
        body = code[m.end() : close]
        fields = {f[2]: f[1] for f in re.finditer(r"(?:final|late|var)?\s*\b([A-Z]\w*)[?]?\s+(\w+)\s*;", body)}
        at = 0
        for d in re.finditer(r"(?m)^\s+(?:(?:static|@override|Future<[^>]*>|[\w<>?,\[\]]+)\s+)+(\w+)\s*\(", body):
            if d.start() < at or d[1] in _CONTROL or d[1].startswith("_"):
                continue
            shut = match(body, d.end() - 1, "()")
            opened = re.match(r"\s*(?:async\*?|sync\*)?\s*(\{|=>)", body[shut + 1 :])
            if not opened:
                continue
            start = shut + opened.end()
            stop = match(body, start) if opened[1] == "{" else body.find(";", start)
            types = [simple(" ".join(re.sub(r"\b(required|final)\b|[{}\[\]]", "", p).split()[:-1])) for p in split_top(body[d.end() : shut].strip("{}[] "))]
            mid = f"{name}#{d[1]}({','.join(types)})"
            rows.append(row("method", id=mid, type="METHOD", name=d[1], qualified_name=mid, line=line_of(text, m.end() + d.start(1)), snippet=snippet(text, m.end() + d.start(1)), owner=name, n=line_of(text, m.end() + stop)))
            for pos, c in enumerate(re.finditer(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(", body[start:stop])):
                if c[2] in _CONTROL or (c[1] and c[1] not in fields and c[1] != "this"):
                    continue
                rows.append(row("call", source_id=mid, owner=name, target=fields.get(c[1]), name=c[2], n=-1, line=pos, type="typed" if c[1] in fields else "own"))
            at = stop
    return rows


# --- Groovy ----------------------------------------------------------------------


def groovy(path: str, text: str) -> list[dict]:
    code = blank(text, quotes="\"'", triple=True)
    found = [(m[1], m.start()) for m in re.finditer(r"(?m)^\s*(?:(?:public|abstract|final)\s+)*(?:class|interface|enum|trait)\s+(\w+)", code)]
    if not found:
        found = [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 0)]
    return [row("node", id=n, type="GROOVY_SCRIPT", name=n, qualified_name=n, line=line_of(text, at), snippet=snippet(text, at)) for n, at in dict(reversed(found)).items()][::-1]


# --- Python ----------------------------------------------------------------------


def python(path: str, text: str) -> list[dict]:
    code = blank(text, line=("#",), block=None, quotes="\"'", triple=True)
    rows = [row("node", id=path, type="PY_MODULE", name=path.rsplit("/", 1)[-1], qualified_name=path[:-3].replace("/", ".").removesuffix(".__init__"), line=1, snippet=snippet(text, 0))]
    scopes: list[tuple[int, str, str]] = []  # (indent, kind, id) of what is open
    imported: dict[str, str] = {}
    offset = 0
    lines = code.split("\n")
    for number, line in enumerate(lines, 1):
        indent = len(line) - len(line.lstrip())
        if line.strip():
            while scopes and scopes[-1][0] >= indent:
                scopes.pop()
        m = re.match(r"\s*(?:async\s+)?(class|def)\s+(\w+)\s*(\(?[^:]*)", line)
        if m and m[1] == "class" and indent == 0:
            id_ = f"{path}::{m[2]}"
            rows.append(row("node", id=id_, type="PY_CLASS", name=m[2], qualified_name=id_, line=number, snippet=snippet(text, offset)))
            for base in split_top(m[3].strip("() ")):
                rows.append(row("py_base", source_id=id_, target=base))
            scopes.append((indent, "class", id_))
        elif m and m[1] == "def" and (indent == 0 or (scopes and scopes[-1][1] == "class")):
            owner = scopes[-1][2] if scopes else path
            mid = f"{owner}#{m[2]}()"
            rows.append(row("method", id=mid, type="METHOD", name=m[2], qualified_name=mid, line=number, snippet=snippet(text, offset), owner=owner))
            scopes.append((indent, "def", mid))
        elif m:
            scopes.append((indent, "inner", scopes[-1][2] if scopes else path))
        f = re.match(r"\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)", line)
        i = re.match(r"\s*import\s+([\w.,\s]+)", line)
        if f:
            base = path.rsplit("/", 1)[0] if "/" in path else ""
            for _ in range(len(f[1]) - 1):
                base = base.rsplit("/", 1)[0] if "/" in base else ""
            module = (base + "/" if f[1] and base else "") + f[2].replace(".", "/")
            for x in split_top(f[3].strip("() ")):
                name, _, alias = x.partition(" as ")
                imported[(alias or name).strip()] = f"{module}|{name.strip()}"
                rows.append(row("py_import", source_id=path, target=module.rstrip("/"), name=name.strip()))
        elif i and not line.lstrip().startswith("from"):
            for x in split_top(i[1]):
                rows.append(row("py_import", source_id=path, target=x.partition(" as ")[0].strip().replace(".", "/"), name=None))
        inside = next((s for s in reversed(scopes) if s[1] == "def"), None)
        if inside and not m:
            klass = next((s[2] for s in reversed(scopes) if s[1] == "class"), None)
            for c in re.finditer(r"(?:\b(self|cls)\s*\.\s*)?(?<![.\w])(\w+)\s*\(", line):
                if c[1] and klass:
                    rows.append(row("py_call", source_id=inside[2], target=f"{klass}#{c[2]}()", name=c[2]))
                elif not c[1]:
                    rows.append(row("py_call", source_id=inside[2], target=f"{path}#{c[2]}()", name=c[2], owner=imported.get(c[2])))
            for c in re.finditer(r"\b(?:self|cls)\s*\.\s*(\w+)\s*\(", line):
                if klass:
                    rows.append(row("py_call", source_id=inside[2], target=f"{klass}#{c[1]}()", name=c[1]))
        raw = text[offset : offset + len(line)]
        for t in table_names(raw) if raw != line else []:
            rows.append(row("table_ref", source_id=inside[2] if inside else scopes[-1][2] if scopes else path, target=t))
        offset += len(line) + 1
    return rows


# --- shell -----------------------------------------------------------------------

# Programs whose call makes a RUNS edge; a longer name goes before its beginning.
PROGRAMS = (
    "docker-compose", "docker", "./gradlew", "gradlew", "gradle", "mvn", "npm", "npx", "node", "python3", "python",
    "pip3", "pip", "psql", "ssh", "scp", "rsync", "kubectl", "terraform", "git", "claude", "jq", "curl", "java",
)
_PROGRAM = re.compile("(?:" + "|".join(map(re.escape, PROGRAMS)) + r")\b")


def _shell_code(text: str) -> str:
    """Comments outside quotes and the bodies of here-documents as spaces."""
    out, waiting = [], None
    for line in text.split("\n"):
        if waiting is not None:
            if line.strip() == waiting:
                waiting = None
            out.append(" " * len(line))
            continue
        kept = re.sub(r"""((?:"(?:\\.|[^"\\])*"|'[^']*'|\\.|[^"'\\#]|(?<=\S)#)*)(#.*)?""", lambda m: m[1] + " " * len(m[2] or ""), line, count=1)
        heredoc = re.search(r"<<-?\s*[\"']?(\w+)[\"']?", kept)
        if heredoc:
            waiting = heredoc[1]
        out.append(kept)
    return "\n".join(out)


def shell(path: str, text: str) -> list[dict]:
    code = _shell_code(text)
    rows = [row("node", id=path, type="SHELL_SCRIPT", name=path.rsplit("/", 1)[-1], qualified_name=path, line=1, snippet=snippet(text, 0))]
    functions: dict[str, tuple[int, int]] = {}
    for m in re.finditer(r"(?m)^[ \t]*(?:function\s+([\w:-]+)\s*(?:\(\s*\))?|([\w:-]+)\s*\(\s*\))\s*\{", code):
        name = m[1] or m[2]
        if name not in functions:
            functions[name] = (m.end(), match(code, m.end() - 1))
            mid = f"{path}#{name}()"
            rows.append(row("method", id=mid, type="METHOD", name=name, qualified_name=mid, line=line_of(text, m.start()), snippet=snippet(text, m.start()), owner=path))
    own = {n: f"{path}#{n}()" for n in functions}

    def inside(at: int) -> str:
        return next((own[n] for n, (a, b) in functions.items() if a <= at < b), path)

    for m in re.finditer(r"(?m)(?:^|[;&|({]|\bthen\b|\bdo\b|\belse\b)[ \t]*(?:sudo\s+|exec\s+|time\s+)?([\w./:-]+)", code):
        word, source = m[1], inside(m.start(1))
        if word in own and source != own[word] and not re.match(r"\s*\(\s*\)", code[m.end() :]):
            rows.append(row("edge", source_id=source, type="CALLS", target=own[word]))
        program = _PROGRAM.match(word)
        if program:
            rows.append(row("edge", source_id=source, type="RUNS", target=program[0]))
    # a script is drawn in by source or a dot, given to a shell, or run from its own folder
    drawn = re.finditer(r"""(?m)(?:^|[;&|(\s])(?:(?:source|\.|\b(?:ba)?sh)[ \t]+["']?([^\s"';]+)|(\./[\w./-]+\.sh))""", code)
    for named in dict.fromkeys(m[1] or m[2] for m in drawn):
        if not named.endswith(".sh"):
            continue
        base = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
        target = re.sub(r"^(\$\{?\w+\}?/|\$\([^)]*\)/|\./)", "", named)
        rows.append(row("sources", source_id=path, target=base + target, name=target))
    return rows
