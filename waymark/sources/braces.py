"""Extractors for brace languages: TypeScript/JavaScript, Java, C# and Rust.

An outline pass blanks strings and comments and follows the braces, so every line knows its type and
callable. Declarations are collected first (calls may look ahead); the second pass emits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from waymark.sources.extract import FIRST_VERB, Emitter, ends, extractor, line_at, sql_tables

# Words before a parenthesis that are no calls.
NO_CALLS = frozenset(
    "if for foreach while switch catch return new throw assert super else do try synchronized lock using nameof typeof function const let var class"
    " await yield match loop fn vec Some None Ok Err panic import package record interface enum constructor sizeof".split()
)
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')


def blanked(text: str) -> str:
    """The text with strings and comments as blanks; line ends and offsets stay."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"//[^\n]*|/\*.*?\*/|" + _STRING.pattern, keep, text, flags=re.S)


@dataclass
class Line:
    number: int
    raw: str
    code: str
    owner: str | None = None
    callable: str | None = None
    declares: tuple[str, str] | None = None  # (keyword, name) of a type
    defines: str | None = None  # name of a callable
    notes: list[str] = field(default_factory=list)  # annotations since the declaration before


@dataclass
class Language:
    types: re.Pattern  # groups: keyword, name
    method: re.Pattern  # group: name; inside a type
    function: re.Pattern | None  # group(s): name; outside of types
    note: re.Pattern  # a line that annotates what follows


def outline(text: str, lang: Language) -> list[Line]:
    raws, codes = text.split("\n"), blanked(text).split("\n")
    scopes: list[tuple[str, str, int]] = []  # (type or callable, name, depth outside)
    waiting: tuple[str, str] | None = None  # declared, brace not seen yet
    depth, notes, out = 0, [], []
    for n, (raw, code) in enumerate(zip(raws, codes, strict=True), 1):
        line = Line(n, raw, code)
        owner = next((name for kind, name, _ in reversed(scopes) if kind == "type"), None)
        inside = any(kind == "callable" for kind, _, _ in scopes)
        if lang.note.match(raw):
            notes.append(raw.strip())
        t = lang.types.match(code) if not inside else None
        m = None
        if not t and not inside:
            pattern = lang.method if owner else lang.function
            m = pattern.match(code) if pattern else None
            name = next((g for g in m.groups() if g), None) if m else None
            m = name if name and name not in NO_CALLS else None
        if t:
            line.declares, line.notes, notes = (t[1], t[2]), notes, []
            waiting = ("type", t[2])
        elif m:
            line.defines, line.notes, notes = m, notes, []
            waiting = ("callable", m)
        line.owner = owner
        line.callable = m or next((name for kind, name, _ in reversed(scopes) if kind == "callable"), None)
        for c in code:
            if c == "{":
                if waiting:
                    scopes.append((*waiting, depth))
                    waiting = None
                depth += 1
            elif c == "}":
                depth -= 1
                while scopes and scopes[-1][2] >= depth:
                    scopes.pop()
            elif c == ";" and waiting and waiting[0] == "callable":
                waiting = None
        out.append(line)
    return out


def calls(line: Line) -> Iterator[tuple[str | None, str]]:
    """(receiver or None, name) of the calls on a line; of a definition only its body."""
    code = line.code.partition("{")[2] if line.defines else line.code
    for m in re.finditer(r"(?:\b([A-Za-z_]\w*)\s*(?:\.|::)\s*)?\b([A-Za-z_]\w*)\s*\(", code):
        if m[2] not in NO_CALLS and not re.search(r"\bnew\s+$", code[: m.start()]):
            yield m[1], m[2]


def walk(out: Emitter, text: str, lang: Language, kind_of: Callable[[Line, str], str], type_id: Callable[[str, str], str],
         method_id: Callable[[str, str], str], function_id: Callable[[str], str], name: str,
         typed: Callable[[str], str | None] = lambda _: None) -> list[Line]:
    """Types, callables and calls; returns the outline for what a language adds. ``typed`` names the
    type of a receiver that is a variable."""
    fid = f"file:{out.path}"
    lines = outline(text, lang)
    kinds: dict[str, str] = {}
    members: dict[str, set[str]] = {}
    free: set[str] = set()
    for x in lines:
        if x.declares:
            kinds[x.declares[1]] = kind_of(x, text)
        elif x.defines and x.owner:
            members.setdefault(x.owner, set()).add(x.defines)
        elif x.defines:
            free.add(x.defines)
    for x in lines:
        if x.declares:
            tid = out.node(type_id(kinds[x.declares[1]], x.declares[1]), kinds[x.declares[1]], x.declares[1], x.number, "HIGH", lang=name)
            out.edge(fid, tid, "defines", x.number, "HIGH")
        elif x.defines:
            mid = out.node(method_id(x.owner, x.defines) if x.owner else function_id(x.defines), "method" if x.owner else "function", x.defines, x.number, "HIGH", lang=name)
            out.edge(fid, mid, "defines", x.number, "HIGH")
            if x.owner:
                out.edge(type_id(kinds.get(x.owner, "class"), x.owner), mid, "defines", x.number, "HIGH")
    for x in lines:
        if not x.callable:
            continue
        src = method_id(x.owner, x.callable) if x.owner else function_id(x.callable)
        for receiver, target in calls(x):
            own = members.get(x.owner or "", set())
            if receiver in (None, "this", "self", "Self") and target in own:
                dst, conf, via = method_id(x.owner, target), "HIGH", "same-file"
            elif receiver is None and target in free:
                dst, conf, via = function_id(target), "HIGH", "same-file"
            elif receiver is None:
                dst, conf, via = f"unresolved:call:{target}", "LOW", "textual"
            elif receiver in members and target in members[receiver]:
                dst, conf, via = method_id(receiver, target), "HIGH", "same-file"
            elif receiver[:1].isupper() and receiver not in ("Self",):
                dst, conf, via = f"unresolved:method:{receiver}#{target}", "LOW", "static"
            elif of := typed(receiver):
                dst, conf, via = f"unresolved:method:{of}#{target}", "MEDIUM", "receiver"
            else:
                continue
            if dst != src:
                out.edge(src, dst, "calls", x.number, conf, via=via)
    return lines


def literal_sql(out: Emitter, text: str, lines: list[Line], src_of: Callable[[Line], str], conf: str) -> None:
    """Table access from string literals with a verb."""
    for m in _STRING.finditer(text):
        if not FIRST_VERB.match(m[0][1:].lstrip()):
            continue
        n = line_at(text, m.start())
        kind, tables = sql_tables(m[0][1:-1])
        for t in tables:
            out.edge(src_of(lines[n - 1]), f"table:{t}", kind, n, conf, via="sql-string")


# --- TypeScript and JavaScript

_TS = Language(
    re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:const[ \t]+)?(class|interface|enum)[ \t]+(\w+)"),
    re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*(\w+)[ \t]*(?:<[^>]*>)?\([^;{}]*\)[ \t]*(?::[^{;]*)?\{"),
    re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function[ \t*]+(\w+)[ \t]*[<(]|(?:const|let|var)[ \t]+(\w+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^)]*\)|\w+)[ \t]*(?::[^=]*)?=>)"),
    re.compile(r"^[ \t]*@\w+"),
)
_METHOD_KEY = re.compile(r"[{,]\s*method\s*(?::\s*(?:['\"`](\w+)['\"`])?|[,}])")
_BRACKET = re.compile(_STRING.pattern + r"|[()]", re.S)
_HOOK = re.compile(r"\b(useQuery|useMutation)\b")
_SENDS = (
    re.compile(r"\.http\s*\.\s*(get|post|put|delete|patch)\s*(?:<[^>\n]*>)?\(\s*['\"`]([^'\"`\n]*)['\"`]"),
    re.compile(r"\.http\s*\.\s*request\s*\(\s*['\"`](\w+)['\"`]\s*,\s*['\"`]([^'\"`\n]*)['\"`]"),
    re.compile(r"(?:\baxios|(?<![\w$])\$http)\s*\.\s*(get|post|put|patch|delete|head|options)\s*\(\s*['\"`]([^'\"`\n]*)['\"`]"),
)


#: In the order in which they are looked for.
TS_FRAMEWORKS = (
    ("angular", r"@angular/|@Component|loadComponent"), ("react", r"from ['\"]react['\"]|react-router"),
    ("vue", r"from ['\"]vue['\"]|vue-router|(?s:<template>.*<script|<script.*<template>)"), ("svelte", r"svelte"),
)


def framework_of(text: str) -> str:
    """The first of the known frameworks that a source names."""
    return next((name for name, pattern in TS_FRAMEWORKS if re.search(pattern, text)), "")


def _url(url: str) -> str | None:
    """A literal path for matching, as functions.text.norm_url; longer ones are none."""
    url = re.split(r"\?|\$\{|\{", url)[0]
    if not url.startswith("/"):
        return None
    url = re.sub(r"/\d+$", "/{id}", url.rstrip("/") or "/")
    return url if len(url) <= 400 else None


def _options(text: str, at: int) -> str:
    """What stands between ``at`` and the parenthesis that closes the call."""
    depth = 1
    for m in _BRACKET.finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return text[at : m.start()]
    return text[at:]


@extractor("typescript", lambda p: ends(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte")(p) and not p.endswith(".d.ts"))
def typescript(out: Emitter, text: str) -> None:
    fid = out.file("test" if ".spec" in out.path or ".test" in out.path else "source", lang="typescript", framework=framework_of(text))

    def kind_of(x: Line, _: str) -> str:
        word, name = x.declares
        notes = " ".join(x.notes)
        if word != "class":
            return word
        if "@Component" in notes:
            return "component"
        if re.search(r"implements\b.*\b(?:CanActivate|CanMatch)\b", x.raw):
            return "guard"
        if re.search(r"implements\b.*\bHttpInterceptor\b", x.raw):
            return "interceptor"
        return "service" if "@Injectable" in notes or name.endswith("Service") else "class"

    lines = walk(out, text, _TS, kind_of, lambda k, n: f"ts:{k}:{n}", lambda c, m: f"ts:class:{c}#{m}", lambda f: f"ts:func:{f}", "typescript")
    for m in re.finditer(r"^[ \t]*import\b[^'\"`;]*['\"`](\.[^'\"`\n]*)['\"`]", text, re.M):
        out.edge(fid, f"unresolved:module:{m[1]}", "imports", line_at(text, m.start(1)), "MEDIUM")
    if re.search(r"react|jsx", text) or out.path.endswith(("x",)):
        for x in lines:
            if x.defines and not x.owner and x.defines[:1].isupper():
                out.edge(fid, out.node(f"ts:component:{x.defines}", "component", x.defines, x.number, "MEDIUM", framework="react"), "defines", x.number, "MEDIUM")
    if re.search(r"react-router|vue-router|@angular/router|svelte-routing|createBrowserRouter|useRoutes", text):
        for m in re.finditer(r"\bpath\s*:\s*['\"`]([^'\"`\n]*)['\"`]", text):
            n = line_at(text, m.start())
            rid = out.node(f"route:/{m[1].lstrip('/')}", "route", f"/{m[1].lstrip('/')}", n, "HIGH")
            near = "\n".join(text.split("\n")[n - 1 : n + 2])
            for guard in re.findall(r"\w+", " ".join(re.findall(r"can(?:Activate|Match)\s*:\s*\[([^\]]*)\]", near))):
                out.edge(rid, f"unresolved:guard:{guard}", "guarded-by", n, "MEDIUM")
            for comp in re.findall(r"loadComponent\s*:.*?\bm\.(\w+)|\bcomponent\s*:\s*(\w+)", near):
                out.edge(rid, f"unresolved:component:{comp[0] or comp[1]}", "navigates", n, "HIGH")
    sent: list[tuple[int, int, str, str, str]] = []  # start, end, verb, path, hook
    for pattern in _SENDS:
        sent += [(m.start(), m.end(), m[1].upper(), m[2], "") for m in pattern.finditer(text)]
    for m in re.finditer(r"\bfetch\s*\(\s*['\"`]([^'\"`\n]*)['\"`]", text):
        rest = _options(text, m.end())
        end, rest = m.end() + len(rest), rest.lstrip(", \n\t")
        verb = "GET"
        if rest:
            key = _METHOD_KEY.search(rest)
            verb = (key[1] or "*").upper() if key else "GET" if rest.startswith("{") else "*"
        hooks = _HOOK.findall(text, max(0, m.start() - 500), m.start())
        sent.append((m.start(), end, verb, m[1], hooks[-1] if hooks else ""))
    for m in re.finditer(r"(?:\baxios|(?<![\w$])\$http)\s*\(\s*(\{)", text):
        body = _options(text, m.start(1))
        url, key = re.search(r"\burl\s*:\s*['\"`]([^'\"`\n]*)['\"`]", body), _METHOD_KEY.search(body)
        if url:
            sent.append((m.start(), m.start(1) + len(body), (key[1] or "*").upper() if key else "GET", url[1], ""))
    done = 0
    for at, end, verb, url, hook in sorted(sent):
        if at < done:  # inside a call that is told already
            continue
        done = end
        if path := _url(url):
            n = line_at(text, at)
            eid = out.node(f"endpoint:{verb} {path}", "endpoint", f"{verb} {path}", n, "LOW", via="http-client", hook=hook)
            out.edge(fid, eid, "consumes", n, "LOW", via="http-client", hook=hook)


# --- Java

_JAVA = Language(
    re.compile(r"^\s*(?:(?:public|protected|private|abstract|final|sealed|static)\s+)*(class|interface|enum|record)\s+(\w+)"),
    re.compile(r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|synchronized|abstract|default)\s+)*(?:[\w<>\[\]?.,]+\s+)+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w,. ]+)?\s*[{;]?\s*.*$|^\s*(?:public|protected|private)\s+(\w+)\s*\([^;{}]*\)\s*\{"),
    None,
    re.compile(r"^\s*@\w+"),
)
_STEREOTYPES = {"RestController": "controller", "Controller": "controller", "Service": "service", "Repository": "service", "Component": "service", "Configuration": "configuration"}
_JDK = frozenset("String int long double boolean float short byte char Integer Long Double Boolean Float List Map Set Optional Object BigDecimal UUID".split())
_MAPPING = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b(?:[^\"]*\"([^\"]*)\")?")


def _mapped(notes: list[str]) -> tuple[str, str] | None:
    for note in notes:
        if m := _MAPPING.search(note):
            verb = re.search(r"RequestMethod\.(\w+)", note)
            return (verb[1] if verb else "GET" if m[1] == "Request" else m[1].upper()), m[2] or ""
    return None


@extractor("java", ends(".java"))
def java(out: Emitter, text: str) -> None:
    test = "/test/" in f"/{out.path}"
    package = (re.search(r"^\s*package\s+([\w.]+)", text, re.M) or [None, ""])[1]
    fid = out.file("test" if test else "source", lang="java", package=package)
    full = lambda n: f"{package}.{n}" if package else n

    def kind_of(x: Line, _: str) -> str:
        found = [_STEREOTYPES[s] for s in re.findall(r"@(\w+)", " ".join(x.notes)) if s in _STEREOTYPES]
        return found[0] if found else x.declares[0] if x.declares[0] in ("interface", "enum") else "class"

    type_id = lambda _, n: f"java:class:{full(n)}"
    method_id = lambda c, m: f"java:method:{full(c)}#{m}"
    fields = {m[2]: m[1] for m in re.finditer(r"(?m)^\s*private\s+(?:static\s+)?(?:final\s+)?([A-Z]\w*)(?:<[^>]*>)?\s+(\w+)\s*[;=]", blanked(text))}
    lines = walk(out, text, _JAVA, kind_of, type_id, method_id, lambda f: f"java:method:{full('')}#{f}", "java", fields.get)
    base = ""
    for x in lines:
        notes = " ".join(x.notes)
        if x.declares:
            word, name = x.declares
            cid = type_id("", name)
            base = (_mapped(x.notes) or ("", ""))[1]
            for s in re.findall(r"@(\w+)", notes):
                if s in _STEREOTYPES:
                    out.edge(cid, out.node(f"stereotype:spring:{s}", "stereotype", s, x.number, "HIGH"), "references", x.number, "HIGH")
            if "@Entity" in notes:
                named = re.search(r"@Table\b[^)]*?name\s*=\s*\"([^\"]+)\"", notes)
                table = named[1] if named else name.lower()
                tid = out.node(f"table:{table}", "table", table, x.number, "HIGH" if named else "LOW")
                out.edge(fid, tid, "defines", x.number, "HIGH")
                out.edge(cid, tid, "maps-to", x.number, "HIGH" if named else "LOW")
            if m := re.search(r"extends\s+JpaRepository\s*<\s*(\w+)", " ".join(y.raw for y in lines[x.number - 1 : x.number + 1])):
                out.edge(cid, f"entity:{m[1]}", "reads", x.number, "HIGH")
                out.edge(cid, f"entity:{m[1]}", "writes", x.number, "MEDIUM")
                out.edge(cid, f"entity:{m[1]}", "queries", x.number, "MEDIUM")
                out.edge(cid, f"table:{m[1].lower()}", "reads", x.number, "LOW")
        elif x.defines and x.owner:
            mid = method_id(x.owner, x.defines)
            if test and re.match(r"test|\w*Test", x.defines):
                out.edge(fid, out.node(f"test:{full(x.owner)}#{x.defines}", "test-case", x.defines, x.number, "MEDIUM"), "defines", x.number, "MEDIUM")
            if mapped := _mapped(x.notes):
                route = f"{mapped[0]} /{'/'.join(p.strip('/') for p in (base, mapped[1]) if p.strip('/'))}"
                eid = out.node(f"endpoint:{route}", "endpoint", route, x.number, "HIGH", lang="java")
                out.edge(eid, mid, "handled-by", x.number, "HIGH")
                out.edge(fid, eid, "defines", x.number, "HIGH")
            if x.defines == x.owner:
                for t in re.findall(r"(?:[(,]\s*(?:final\s+)?)([A-Z]\w*)(?:<[^>]*>)?\s+\w+", x.raw):
                    if t not in _JDK:
                        out.edge(type_id("", x.owner), f"unresolved:class:{t}", "injects", x.number, "HIGH")
        elif x.owner and not x.callable:
            if (m := re.match(r"\s*private\s+(?:final\s+)?([A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*[;=]", x.code)) and m[1] not in _JDK:
                out.edge(type_id("", x.owner), f"unresolved:class:{m[1]}", "injects", x.number, "MEDIUM")
        src = method_id(x.owner, x.callable) if x.owner and x.callable else type_id("", x.owner) if x.owner else fid
        for m in re.finditer(r"\bnew\s+([A-Z]\w*)\s*\(", x.code):
            if m[1] != x.owner:
                out.edge(src, f"unresolved:class:{m[1]}", "references", x.number, "LOW")
        # Annotations on the line of a declaration; those on lines of their own are notes.
        if not x.raw.lstrip().startswith("@"):
            if x.defines and x.owner and (m := re.search(r"@Scheduled\s*(\([^)]*\))?", x.raw)):
                out.node("schedule:cron", "schedule", "cron", x.number, "MEDIUM", lang="java", framework="spring")
                out.edge(src, "schedule:cron", "triggered-by", x.number, "HIGH", schedule=m[1] or "")
            if m := re.search(r"@Value\s*\(\s*\"([^\"]+)\"", x.raw):
                out.edge(src, f"config-key:{m[1]}", "configures", x.number, "HIGH", lang="java")
        for seq in re.findall(r"nextval\s*\(\s*'([^']+)'", x.raw):
            out.edge(src, f"sequence:{seq}", "invokes", x.number, "MEDIUM")
    literal_sql(out, text, lines, lambda x: method_id(x.owner, x.callable) if x.owner and x.callable else fid, "MEDIUM")


# --- C#

_CS = Language(
    re.compile(r"^\s*(?:(?:public|private|protected|internal|sealed|abstract|static|partial)\s+)*(class|interface|enum|record|struct)\s+(\w+)"),
    re.compile(r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+(?:[\w<>\[\]?.,]+\s+)*(\w+)\s*(?:<[^>]*>)?\([^;{}]*\)"),
    None,
    re.compile(r"^\s*\["),
)


@extractor("csharp", ends(".cs"))
def csharp(out: Emitter, text: str) -> None:
    space = (re.search(r"^\s*namespace\s+([\w.]+)", text, re.M) or [None, ""])[1]
    fid = out.file(lang="csharp", namespace=space)
    full = lambda n: f"{space}.{n}" if space else n

    def kind_of(x: Line, _: str) -> str:
        word, name = x.declares
        if word in ("interface", "enum"):
            return word
        return next((k for end, k in (("Controller", "controller"), ("Service", "service"), ("Handler", "handler")) if name.endswith(end)), "class")

    type_id = lambda _, n: f"cs:class:{full(n)}"
    method_id = lambda c, m: f"cs:method:{full(c)}#{m}"
    variable = lambda r: r if r[:1].islower() else None
    lines = walk(out, text, _CS, kind_of, type_id, method_id, lambda f: f"cs:method:{full('')}#{f}", "csharp", variable)
    for m in re.finditer(r"^\s*using\s+([\w.]+)\s*;", text, re.M):
        out.edge(fid, f"unresolved:module:{m[1]}", "imports", line_at(text, m.start(1)), "MEDIUM")
    for m in re.finditer(r"app\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]+)\"", text):
        n = line_at(text, m.start())
        out.edge(fid, out.node(f"endpoint:* {m[2]}", "endpoint", f"* {m[2]}", n, "MEDIUM", lang="csharp"), "defines", n, "MEDIUM")
    owner = None
    for x in lines:
        notes = " ".join(x.notes)
        if x.declares:
            owner = owner or x.declares[1]
            if m := re.search(r"\[Table\s*\(\s*\"([^\"]+)\"", notes):
                tid = out.node(f"table:{m[1].lower()}", "table", m[1].lower(), x.number, "HIGH")
                out.edge(type_id("", x.declares[1]), tid, "reads", x.number, "MEDIUM")
                out.edge(type_id("", x.declares[1]), tid, "writes", x.number, "MEDIUM")
            if m := re.search(r":\s*[\w.]*?(\w+)\.\1Base\b|:\s*(\w+)\.\w+Base\b", x.raw):
                service = m[1] or m[2]
                out.edge(fid, out.node(f"endpoint:gRPC {service}", "endpoint", f"gRPC {service}", x.number, "MEDIUM"), "exposes", x.number, "MEDIUM")
        for m in re.finditer(r"DbSet\s*<\s*(\w+)\s*>\s+(\w+)", x.code):
            tid = out.node(f"table:{m[2].lower()}", "table", m[2].lower(), x.number, "HIGH", via="ef")
            for kind in ("reads", "writes"):
                out.edge(type_id("", x.owner) if x.owner else fid, tid, kind, x.number, "HIGH", via="ef")
            out.edge(type_id("", x.owner) if x.owner else fid, f"entity:{m[1]}", "reads", x.number, "MEDIUM")
        if x.defines and x.owner and re.search(r"RecurringJob\.AddOrUpdate|BackgroundJob\.(?:Enqueue|Schedule)", x.raw):
            out.edge(method_id(x.owner, x.defines), "schedule:cron", "triggered-by", x.number, "MEDIUM", lang="csharp")
        if x.defines and x.owner and (m := re.search(r"\[Http(Get|Post|Put|Delete|Patch)(?:\s*\(\s*\"([^\"]*)\")?", notes)):
            route = f"{m[1].upper()} /{(m[2] or '').lstrip('/')}"
            out.edge(out.node(f"endpoint:{route}", "endpoint", route, x.number, "HIGH", lang="csharp"), method_id(x.owner, x.defines), "handled-by", x.number, "HIGH")
    literal_sql(out, text, lines, lambda x: method_id(x.owner, x.callable) if x.owner and x.callable else fid, "MEDIUM")


# --- Rust

_RUST_FN = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"
_RUST = Language(
    re.compile(r"^\s*(impl|struct|enum|trait|type)\b(?:\s*<[^>]*>)?\s+(?:\w+(?:<[^>]*>)?\s+for\s+)?(\w+)"),
    re.compile(_RUST_FN), re.compile(_RUST_FN), re.compile(r"^\s*#\["),
)


@extractor("rust", ends(".rs"))
def rust(out: Emitter, text: str) -> None:
    fid = out.file(lang="rust")
    text = re.sub(r"^(\s*(?:pub(?:\([^)]*\))?\s+))(struct|enum|trait|type)\b", lambda m: " " * len(m[1]) + m[2], text, flags=re.M)
    kind_of = lambda x, _: {"enum": "enum", "trait": "interface"}.get(x.declares[0], "class")
    lines = walk(out, text, _RUST, kind_of, lambda _, n: f"rs:type:{n}", lambda c, m: f"rs:method:{c}#{m}", lambda f: f"rs:fn:{f}", "rust")
    for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([\w:{},* \t]+);", text, re.M):
        if not m[1].startswith("std"):
            out.edge(fid, f"unresolved:module:{m[1]}", "imports", line_at(text, m.start(1)), "MEDIUM")
    for x in lines:
        for verb, path in re.findall(r"#\[(get|post|put|delete|patch)\s*\(\s*\"([^\"]+)\"", " ".join(x.notes)):
            if x.defines:
                route = f"{verb.upper()} {path}"
                eid = out.node(f"endpoint:{route}", "endpoint", route, x.number, "HIGH", lang="rust")
                out.edge(eid, f"rs:method:{x.owner}#{x.defines}" if x.owner else f"rs:fn:{x.defines}", "handled-by", x.number, "HIGH")
        for path in re.findall(r"\.(?:route|service|nest)\s*\(\s*\"([^\"]+)\"", x.raw):
            eid = out.node(f"endpoint:* {path}", "endpoint", f"* {path}", x.number, "MEDIUM", lang="rust")
            out.edge(fid, eid, "exposes", x.number, "MEDIUM")
            for handler in re.findall(r"\b(?:get|post|put|delete|patch)\s*\(\s*([\w:]+)", x.raw):
                out.edge(eid, f"unresolved:handler:{handler.split('::')[-1]}", "handled-by", x.number, "LOW")
        if re.search(r"tokio::time::interval|cron::|job_scheduler", x.raw):
            out.edge(fid, "schedule:cron", "triggered-by", x.number, "LOW")
    literal_sql(out, text, lines, lambda _: fid, "LOW")
