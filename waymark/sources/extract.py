"""Extractors: source text to node and edge rows.

One Arrow pass turns (path, text) into emissions; a file whose extractor fails yields an error row
and what it had emitted before, never a failed job. Emissions become nodes and edges by first-wins
over (place of the file in the walk, place in the file).

Here: Python (syntax tree), SQL, Go, and the textual fallback for languages without an extractor
(nothing above LOW there). Brace languages are in braces.py, configuration files in configs.py.
"""

from __future__ import annotations

import ast
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import walk_key
from waymark.operators.build import first_wins
from waymark.operators.scopes import global_rank
from waymark.plans.lineage import dealt

Extractor = Callable[["Emitter", str], None]
REGISTRY: list[tuple[str, Callable[[str], bool], Extractor]] = []

# Words after FROM, JOIN, INTO or UPDATE that are grammar, not tables.
NOT_TABLES = frozenset(
    "select where set values order group limit offset returning on using lateral left right inner outer full cross natural".split()
)
#: Names of Python modules that are no architecture.
PLAIN_MODULES = frozenset(("os", "sys", "re", "json", "datetime", "typing", "pathlib"))
#: In the order in which they are looked for.
PYTHON_FRAMEWORKS = {
    "fastapi": ("fastapi", "FastAPI"), "flask": ("flask", "Flask"), "django": ("django", "DJANGO"), "celery": ("celery", "Celery"), "click": ("click",),
}
TABLE_AFTER = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(?:ONLY\s+)?[\"'`]?([A-Za-z_][\w.]*)", re.I)
FIRST_VERB = re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE)\b", re.I)


@dataclass
class Emitter:
    """Collects the rows of one file, in order."""

    path: str
    rows: list[dict] = field(default_factory=list)

    def node(self, id_: str, kind: str, name: str, line: int, conf: str = "HIGH", **meta) -> str:
        self._add("node", id=_clean(id_), kind=kind, name=name, line=line, confidence=conf, meta=meta)
        return _clean(id_)

    def edge(self, src: str, dst: str, type_: str, line: int, conf: str = "MEDIUM", **meta) -> None:
        self._add("edge", src=_clean(src), dst=_clean(dst), type=type_, line=line, confidence=conf, meta=meta)

    def file(self, role: str = "source", **meta) -> str:
        return self.node(f"file:{self.path}", "file", os.path.basename(self.path), 1, "HIGH", role=role, **meta)

    def _add(self, row: str, meta: dict, **cells) -> None:
        meta = {k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items() if v not in (None, "", [])}
        self.rows.append({"row": row, "file": self.path, "meta": list(meta.items()), **cells})


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()[:512]


def extractor(name: str, claims: Callable[[str], bool]) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        REGISTRY.append((name, claims, f))
        return f

    return add


def ends(*suffixes: str) -> Callable[[str], bool]:
    return lambda path: path.lower().endswith(suffixes)


def line_at(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def sql_tables(statement: str) -> tuple[str | None, list[str]]:
    """(reads or writes, tables) of a statement; (None, []) without a verb."""
    verb = FIRST_VERB.search(statement)
    if not verb:
        return None, []
    names = [m[1].split(".")[-1].lower() for m in TABLE_AFTER.finditer(statement)]
    return "reads" if verb[1].upper() == "SELECT" else "writes", list(dict.fromkeys(n for n in names if n not in NOT_TABLES))


# --- Python


class _Python(ast.NodeVisitor):
    """One walk over the tree; ids carry no module path, so first-wins applies across files."""

    ROUTERS = frozenset(("app", "router", "api", "bp", "blueprint"))
    VERBS = frozenset(("get", "post", "put", "delete", "patch", "head", "options"))
    SINKS = frozenset(("execute", "executemany", "raw", "query", "text", "createQuery"))

    def __init__(self, out: Emitter, tree: ast.Module, framework: str = ""):
        self.out, self.fid, self.framework = out, f"file:{out.path}", framework
        self.owner: list[str] = []
        self.scope: list[str] = []
        self.functions = {n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
        self.classes = {n.name: n for n in tree.body if isinstance(n, ast.ClassDef)}

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._module(a.name, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for name in [node.module] if node.module else [a.name for a in node.names]:
            self._module(name, node.lineno)

    def _module(self, name: str, line: int) -> None:
        if name.split(".")[0] not in PLAIN_MODULES:
            self.out.edge(self.fid, f"unresolved:module:{name}", "imports", line, "MEDIUM", lang="python")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        kind = "test" if "Test" in node.name or "test" in self.out.path else "class"
        cid = self.out.node(f"py:class:{node.name}", kind, node.name, node.lineno, "HIGH", lang="python", bases=[ast.unparse(b) for b in node.bases])
        self.out.edge(self.fid, cid, "defines", node.lineno, "HIGH")
        for inner in ast.walk(node):
            named = isinstance(inner, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in inner.targets)
            if named and isinstance(inner.value, ast.Constant) and isinstance(inner.value.value, str):
                tid = self.out.node(f"table:{inner.value.value}", "table", inner.value.value, inner.lineno, "HIGH", via="orm")
                self.out.edge(cid, tid, "writes", inner.lineno, "MEDIUM", via="orm")
                break
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        owner = self.owner[-1] if self.owner and not self.scope else None
        fid = f"py:class:{owner}#{node.name}" if owner else f"py:function:{node.name}"
        kind = "method" if owner else "function"
        for d in node.decorator_list:
            text = ast.unparse(d)
            if re.search(r"\b(task|shared_task|periodic_task|scheduled?)\b", text):
                kind = "job"
            if re.search(r"\bclick\.(?:command|group)\b", text):
                at = d.lineno
                hid = self.out.node(f"handler:{self.out.path}:{at}", "handler", f"cli@{os.path.basename(self.out.path)}:{at}", at, "MEDIUM", lang="python", framework="click")
                self.out.edge(self.fid, hid, "defines", at, "HIGH")
        self.out.node(fid, kind, node.name, node.lineno, "HIGH", lang="python", framework=self.framework)
        self.out.edge(self.fid, fid, "defines", node.lineno, "HIGH")
        if owner:
            self.out.edge(f"py:class:{owner}", fid, "defines", node.lineno, "HIGH")
        for d in node.decorator_list:
            for route in self._routes(d):
                eid = self.out.node(f"endpoint:{route}", "endpoint", route, node.lineno, "HIGH", lang="python")
                self.out.edge(eid, fid, "handled-by", node.lineno, "HIGH")
        self.scope.append(fid)
        self.generic_visit(node)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _routes(self, d: ast.expr) -> Iterator[str]:
        """'VERB path' of a routing decorator."""
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name)):
            return
        path = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else None
        if d.func.value.id not in self.ROUTERS or not isinstance(path, str):
            return
        if d.func.attr in self.VERBS:
            yield f"{d.func.attr.upper()} {path}"
        elif d.func.attr == "route":
            verbs = next((k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), [])
            yield f"{'/'.join(v.value.upper() for v in verbs if isinstance(v, ast.Constant)) or 'GET'} {path}"

    def visit_Call(self, node: ast.Call) -> None:
        src = self.scope[-1] if self.scope else self.fid
        f = node.func
        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
        if name in self.SINKS and node.args:
            self._sql(src, node)
        if name == "path" and len(node.args) > 1 and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self._django(node.args[0].value, node.args[1], node.lineno)
        if isinstance(f, ast.Name) and f.id in self.functions and self.scope:
            if (dst := f"py:function:{f.id}") != src:
                self.out.edge(src, dst, "calls", node.lineno, "HIGH", via="same-file")
        made = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name)
        if made and f.value.func.id in self.classes:
            self.out.edge(src, f"py:class:{f.value.func.id}#{f.attr}", "calls", node.lineno, "MEDIUM", via="constructor")
        if isinstance(f, ast.Attribute) and f.attr == "query" and node.args and isinstance(node.args[0], ast.Name) and node.args[0].id[:1].isupper():
            self.out.edge(src, f"entity:{node.args[0].id}", "queries", node.lineno, "MEDIUM", via="orm")
        self.generic_visit(node)

    def _django(self, route: str, handler: ast.expr, line: int) -> None:
        """path(route, handler) with a handler by (dotted) name."""
        short = handler.attr if isinstance(handler, ast.Attribute) else handler.id if isinstance(handler, ast.Name) else ""
        if short:
            name = f"GET /{route.strip('/')}"
            eid = self.out.node(f"endpoint:{name}", "endpoint", name, line, "MEDIUM", lang="python", framework="django", handler=short)
            self.out.edge(eid, f"unresolved:handler:{short}", "handled-by", line, "LOW", lang="python")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.value, ast.Name) and node.value.id[:1].isupper() and node.attr in ("objects", "query"):
            kind = "reads" if node.attr == "objects" else "queries"
            self.out.edge(self.scope[-1] if self.scope else self.fid, f"entity:{node.value.id}", kind, node.lineno, "MEDIUM", via="orm")
        self.generic_visit(node)

    def _literal(self, e: ast.expr) -> str:
        """The literal parts of a string expression."""
        if isinstance(e, ast.Constant):
            return e.value if isinstance(e.value, str) else ""
        if isinstance(e, ast.JoinedStr):
            return "".join(self._literal(v) for v in e.values)
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            return self._literal(e.left) + self._literal(e.right)
        if isinstance(e, ast.Call) and e.args:
            return self._literal(e.args[0])
        return ""

    def _sql(self, src: str, node: ast.Call) -> None:
        kind, tables = sql_tables(self._literal(node.args[0]))
        for t in tables:
            self.out.edge(src, f"table:{t}", kind, node.lineno, "MEDIUM", via="sql-string")
        if kind and not tables:
            self.out.edge(src, "unresolved:query:dynamic", "queries", node.lineno, "LOW", via="sql-string")


def framework_of(text: str) -> str:
    """The first of the known frameworks that a source names."""
    return next((f for f, words in PYTHON_FRAMEWORKS.items() if any(w in text for w in words)), "")


@extractor("python", ends(".py"))
def python(out: Emitter, text: str) -> None:
    base = os.path.basename(out.path)
    out.file("test" if "test" in out.path or base.startswith("conftest") else "source", lang="python")
    tree = ast.parse(text)
    _Python(out, tree, framework_of(text)).visit(tree)
    for i, line in enumerate(text.splitlines(), 1):
        m = re.search(r"\b(?:requests|httpx|aiohttp|urllib)\.(get|post|put|delete|patch)\(\s*f?[\"'](/[^\"'?{]*)", line)
        if m:
            route = f"{m[1].upper()} {m[2]}"
            out.node(f"endpoint:{route}", "endpoint", route, i, "LOW", via="http-client")
            out.edge(f"file:{out.path}", f"endpoint:{route}", "consumes", i, "MEDIUM", via="http-client")
        for name in re.findall(r"\.\s*(?:get_collection|Collection)\s*\(\s*[\"']([\w-]+)[\"']", line):
            out.edge(f"file:{out.path}", f"collection:{name}", "reads", i, "MEDIUM", via="pymongo")
        if re.search(r"\bredis\w*\s*\.\s*(?:Redis|StrictRedis|from_url|get|set|hget|hset|lpush|rpush|publish|expire)\s*\(", line):
            out.edge(f"file:{out.path}", "cache:redis", "writes", i, "LOW", via="redis")


# --- SQL

_NAME = r"([\"'`]?\w+[\"'`]?(?:\.[\"'`]?\w+[\"'`]?)*)"
_CREATE = re.compile(
    r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|UNLOGGED|GLOBAL|LOCAL)\s+)?(TABLE|MATERIALIZED\s+VIEW|VIEW|SEQUENCE|FUNCTION|PROCEDURE|TRIGGER)"
    r"\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME, re.I)  # fmt: skip
_ALTER = re.compile(r"\bALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?" + _NAME + r"([^;]*)", re.I)
_DROP = re.compile(r"\bDROP\s+(TABLE|VIEW|SEQUENCE|FUNCTION|PROCEDURE|TRIGGER)\s+(?:IF\s+EXISTS\s+)?" + _NAME, re.I)
_DML = (
    (re.compile(r"\bINSERT\s+INTO\s+" + _NAME, re.I), "seeds"),
    (re.compile(r"\b(?:FROM|JOIN)\s+(?:ONLY\s+)?" + _NAME, re.I), "reads"),
    (re.compile(r"\b(?:UPDATE|DELETE\s+FROM)\s+(?:ONLY\s+)?" + _NAME, re.I), "writes"),
)
_NO_COLUMN = frozenset("PRIMARY FOREIGN UNIQUE CONSTRAINT CHECK EXCLUDE KEY INDEX LIKE PERIOD".split())
MAX_COLUMNS = 100


def tail_name(name: str) -> str:
    return name.split(".")[-1].strip("\"'`").lower()


def columns_of(text: str, at: int) -> list[str]:
    """Column names of the parenthesised list that follows; quotes and nesting are respected."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text) or text[at] != "(":
        return []
    parts, depth, start, quote = [], 0, at + 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")" or (c == "," and depth == 1):
            if c == "," or depth == 1:
                parts.append(text[start:i])
                start = i + 1
            depth -= c == ")"
            if not depth:
                break
    words = [m[1] for p in parts if (m := re.match(r"\s*[\"`]?(\w+)", p))]
    return list(dict.fromkeys(w.lower() for w in words if w.upper() not in _NO_COLUMN))[:MAX_COLUMNS]


def dialect_of(path: str) -> str:
    base, low = os.path.basename(path), path.lower()
    if re.match(r"[VUR]\d[\w.]*__", base):
        return "flyway"
    return next((d for d in ("alembic", "django", "rails") if d in low), "raw-sql")


@extractor("sql", ends(".sql"))
def sql(out: Emitter, text: str) -> None:
    base, dialect = os.path.basename(out.path), dialect_of(out.path)
    fid = out.file(dialect=dialect)
    version = re.match(r"([VU]\d+)__", base)
    known = dialect == "flyway" and version
    mid = out.node(f"migration:{version[1] if known else base}", "migration", base, 1, "HIGH" if dialect == "flyway" else "MEDIUM", dialect=dialect)
    out.edge(fid, mid, "defines", 1, "HIGH")
    added: dict[str, list[str]] = {}
    for m in _ALTER.finditer(text):
        for col in re.findall(r"\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?(\w+)", m[2], re.I)[:1]:
            if col.upper() not in _NO_COLUMN:
                added.setdefault(tail_name(m[1]), []).append(col.lower())
    for m in _CREATE.finditer(text):
        what, name, line = m[1].upper().split()[0], tail_name(m[2]), line_at(text, m.start())
        kind = {"TABLE": "table", "VIEW": "view", "MATERIALIZED": "view", "SEQUENCE": "sequence"}.get(what, "procedure")
        cols = list(dict.fromkeys(columns_of(text, m.end()) + added.get(name, [])))[:MAX_COLUMNS] if kind == "table" else []
        nid = out.node(f"table:{name}" if kind == "table" else f"dbobj:{name}", kind, name, line, "HIGH", dialect=dialect, migration=base, columns=cols)
        out.edge(mid, nid, "creates", line, "HIGH")
        out.edge(fid, nid, "defines", line, "HIGH")
    dropped = {tail_name(m[2]) for m in _DROP.finditer(text)}
    for m in _ALTER.finditer(text):
        if tail_name(m[1]) not in dropped:
            out.edge(mid, f"table:{tail_name(m[1])}", "modifies", line_at(text, m.start()), "HIGH", dialect=dialect)
    for pattern, kind in _DML:
        for m in pattern.finditer(text):
            if (name := tail_name(m[1])) and name not in NOT_TABLES:
                out.edge(mid, f"table:{name}", kind, line_at(text, m.start()), "MEDIUM", via="sql-dml")
    for m in _DROP.finditer(text):
        space = "table" if m[1].upper() == "TABLE" else "dbobj"
        out.edge(mid, f"{space}:{tail_name(m[2])}", "modifies", line_at(text, m.start()), "HIGH", dialect=dialect, op="drop")


# --- Go

_GO_FUNC = re.compile(r"^[ \t]*func\s+(?:\(\s*\w*\s*\*?(\w+)\s*\)\s*)?(\w+)\s*\(")
_GO_TYPE = re.compile(r"^[ \t]*type\s+(\w+)\s+(struct|interface|[^\s{]+)")
_GO_IMPORT = re.compile(r'^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?"([\w.-]+/[\w./-]+)"')
_GO_ROUTE = re.compile(r"\.(?:HandleFunc|Handle|Get|Post|Put|Delete|Patch|Route|Mount)\s*\(\s*[\"`](/[^\"`]*)[\"`]")
_GO_GRPC = re.compile(r"Register(\w+)Server\s*\(")
_GO_WORDS = frozenset(
    "if for switch select return go defer new make len cap append copy delete panic print println range map chan func type struct interface import package".split()
)


@extractor("go", ends(".go"))
def go(out: Emitter, text: str) -> None:
    fid = out.file("test" if out.path.endswith("_test.go") else "source", lang="go")
    lines = text.splitlines()
    package = next((m[1] for x in lines if (m := re.match(r"\s*package\s+(\w+)", x))), "")
    heads = {i: m for i, x in enumerate(lines, 1) if (m := _GO_FUNC.match(x))}
    ident = lambda m: f"go:method:{package}.{m[1]}#{m[2]}" if m[1] else f"go:func:{package}.{m[2]}"
    by_name = {m[2]: ident(m) for m in heads.values()}
    for i, m in heads.items():
        kind = "handler" if m[2] == "main" else "method" if m[1] and m[2] != "init" else "function"
        nid = out.node(ident(m), kind, m[2], i, "HIGH", lang="go", package=package, receiver=m[1])
        out.edge(fid, nid, "defines", i, "HIGH")
        if m[1]:
            out.edge(f"go:type:{package}.{m[1]}", nid, "defines", i, "HIGH")
    here = None
    kafka = re.search(r"kafka|sarama|confluent|New(?:Consumer|Producer|Reader|Writer)\s*\(", text)
    for i, line in enumerate(lines, 1):
        code = line
        if i in heads:
            here, code = by_name[heads[i][2]], line.partition("{")[2]
        for name in re.findall(r"\b([A-Za-z_]\w*)\s*\(", code) if here else ():
            dst = by_name.get(name)
            if dst and dst != here and name not in _GO_WORDS:
                out.edge(here, dst, "calls", i, "HIGH", via="same-file")
        if m := _GO_TYPE.match(line):
            tid = out.node(f"go:type:{package}.{m[1]}", "interface" if m[2] == "interface" else "class", m[1], i, "HIGH", lang="go", package=package)
            out.edge(fid, tid, "defines", i, "HIGH")
        if m := _GO_IMPORT.match(line):
            out.edge(fid, f"unresolved:module:{m[1]}", "imports", i, "MEDIUM", lang="go")
        for route in _GO_ROUTE.findall(line):
            out.edge(fid, out.node(f"endpoint:* {route}", "endpoint", f"* {route}", i, "MEDIUM", lang="go"), "exposes", i, "MEDIUM")
        for service in _GO_GRPC.findall(line):
            out.edge(fid, out.node(f"endpoint:gRPC {service}", "endpoint", f"gRPC {service}", i, "HIGH", lang="go", via="grpc"), "exposes", i, "HIGH")
        if kafka and re.search("NewReader|Consumer", line):
            out.edge(fid, "queue:kafka", "consumes", i, "LOW", via="kafka")
        elif kafka and re.search("NewWriter|Producer", line):
            out.edge(fid, "queue:kafka", "publishes", i, "LOW", via="kafka")
        if re.search(r"gocron|cron\.(?:New|Schedule)|AddFunc\s*\(", line):
            out.edge(fid, "schedule:cron", "triggered-by", i, "LOW", lang="go")
        for m in TABLE_AFTER.finditer(line):
            verbs = FIRST_VERB.findall(line[: m.start()])
            if (table := m[1].split(".")[-1].lower()) not in NOT_TABLES:
                out.edge(fid, f"table:{table}", "writes" if verbs and verbs[-1].upper() != "SELECT" else "reads", i, "LOW", via="sql-string")


# --- Python that does not parse: the same shapes, line by line


def loose_python(out: Emitter, text: str) -> None:
    """Imports, classes, functions and their routes by the look of lines; owners by indentation."""
    fid, framework = f"file:{out.path}", framework_of(text)
    owner, pending = [], []  # (indent, class) and the decorators above
    for i, line in enumerate(text.splitlines(), 1):
        code = line.strip()
        if not code or code.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while owner and owner[-1][0] >= indent:
            owner.pop()
        if m := re.match(r"(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", code):
            if (name := m[1] or m[2]).split(".")[0] not in PLAIN_MODULES:
                out.edge(fid, f"unresolved:module:{name}", "imports", i, "MEDIUM", lang="python")
        elif code.startswith("@"):
            pending.append((i, code))
            continue
        elif m := re.match(r"class\s+(\w+)", code):
            kind = "test" if "Test" in m[1] or "test" in out.path else "class"
            out.edge(fid, out.node(f"py:class:{m[1]}", kind, m[1], i, "HIGH", lang="python"), "defines", i, "HIGH")
            owner.append((indent, m[1]))
        elif m := re.match(r"(?:async\s+)?def\s+(\w+)", code):
            own = owner[-1][1] if owner else None
            job = any(re.search(r"\b(?:task|shared_task|periodic_task|scheduled?)\b", d) for _, d in pending)
            nid = f"py:class:{own}#{m[1]}" if own else f"py:function:{m[1]}"
            out.node(nid, "job" if job else "method" if own else "function", m[1], i, "HIGH", lang="python", framework=framework)
            out.edge(fid, nid, "defines", i, "HIGH")
            if own:
                out.edge(f"py:class:{own}", nid, "defines", i, "HIGH")
            for at, d in pending:
                if r := re.match(r"@\w+\.(get|post|put|delete|patch|head|options|route)\(\s*[\"']([^\"']*)[\"']", d):
                    verbs = "/".join(re.findall(r"[\"'](\w+)[\"']", d.partition("methods")[2])).upper() if r[1] == "route" else r[1].upper()
                    route = f"{verbs or 'GET'} {r[2]}"
                    out.edge(out.node(f"endpoint:{route}", "endpoint", route, at, "HIGH", lang="python"), nid, "handled-by", at, "HIGH")
        pending = []


# --- fallback

_LIKE_IMPORT = re.compile(r"^[ \t]*(?:import|#?include|require|use|using|from|load)\b[ \t]*[\"'<]?([\w@:][\w./:@-]*)")
_LIKE_DEF = re.compile(r"^[ \t]*(?:(?:public[ \t]+)?(?:class|interface)|struct|enum|trait|func(?:tion)?|def|fn|sub|type|component)[ \t]+([A-Za-z_]\w*)")
_LIKE_ROUTE = re.compile(r"[\"']((?:/api|/v\d)/[\w/{}.-]*)[\"']")
_LIKE_TABLE = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE)\s+(?:ONLY\s+)?(?:\w+\.)*([A-Za-z]\w*)\b", re.I)


def fallback(out: Emitter, text: str) -> None:
    fid = out.file()
    why = {"reason": "unsupported-language-fallback"}
    for i, line in enumerate(text.splitlines(), 1):
        if m := _LIKE_IMPORT.match(line):
            out.edge(fid, f"unresolved:module:{m[1]}", "imports", i, "LOW", **why)
        if m := _LIKE_DEF.match(line):
            out.edge(fid, out.node(f"fallback:{out.path}::{m[1]}", "class", m[1], i, "LOW", **why), "defines", i, "LOW", **why)
        for route in _LIKE_ROUTE.findall(line):
            out.edge(fid, out.node(f"endpoint:* {route}", "endpoint", f"* {route}", i, "LOW", **why), "references", i, "LOW", **why)
        for m in _LIKE_TABLE.finditer(line):
            if line[max(0, m.start(1) - 1) : m.start(1)] not in tuple("'\"`[.") and m[1].lower() not in NOT_TABLES:
                out.edge(fid, f"unresolved:table-ref:{m[1].lower()}", "references", i, "LOW", **why)


@dataclass(frozen=True)
class Added:
    """An extractor that a caller adds: it travels to the executors with the function that uses it."""

    name: str
    claims: Callable[[str], bool]
    run: Extractor
    priority: int = 0


def _load() -> None:
    from waymark.sources import braces, configs  # noqa: F401  register their extractors


def extractors_for(path: str) -> list[str]:
    """Names of the extractors that claim a path; fallback only where none does."""
    _load()
    return [n for n, claims, _ in REGISTRY if claims(path)] or ["fallback"]


def extract_text(path: str, text: str, added: tuple[Added, ...] = ()) -> tuple[list[dict], list[str]]:
    """(rows, errors) of one file. Extractors that were added run by priority, those below zero before the
    library's; a path that one of them claims is not left to the fallback."""
    out, errors = Emitter(path), []
    mine = sorted((a for a in added if a.claims(path)), key=lambda a: a.priority)
    names = [n for n in extractors_for(path) if n != "fallback" or not mine]
    by_name = {n: f for n, _, f in REGISTRY} | {"fallback": fallback}
    runs = [(a.name, a.run) for a in mine if a.priority < 0] + [(n, by_name[n]) for n in names] + [(a.name, a.run) for a in mine if a.priority >= 0]
    for name, run in runs:
        try:
            run(out, text)
        except Exception as e:  # one bad file never fails the scan
            errors.append(f"{path} [{name.upper()}]: {e}")
            if name == "python":
                loose_python(out, text)
                fallback(out, text)
    return out.rows, errors


EMISSIONS = (
    "path string, place long, row string, id string, kind string, name string, src string, dst string, type string, line int,"
    " confidence string, meta map<string,string>, error string"
)


def emissions(files: DataFrame) -> DataFrame:
    """files (path, content binary) to EMISSIONS rows; text is decoded with replacement. Files are dealt
    to all tasks first: their bytes are few for the time that they take, so the splits of a scan are not."""
    names = [x.split()[0] for x in EMISSIONS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got, errors = extract_text(path, (content or b"").decode("utf-8", "replace"))
                rows += [r | {"path": path, "place": i} for i, r in enumerate(got)]
                rows += [{"path": path, "place": len(got) + i, "row": "error", "error": e} for i, e in enumerate(errors)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return dealt(files.select("path", "content"), "path").mapInArrow(run, EMISSIONS)


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of files (path, content): first id and first (src, dst, type) win."""
    from waymark.plans.lineage import cut

    rows = cut(emissions(files))
    places = global_rank(files.select("path").distinct().withColumn("k", walk_key(F.col("path"))), "k").select(F.col("path").alias("__p"), "rank")
    rows = rows.join(places, rows["path"] == places["__p"]).withColumn("seq", F.col("rank") * 1_000_000 + F.col("place"))
    common = [F.col("path").alias("file"), "line", "confidence", F.lit("derived").alias("provenance"), "meta"]
    nodes = rows.where("row = 'node'").select(
        "id", "kind", "name", *common, F.col("meta")["lang"].alias("lang"), F.col("meta")["package"].alias("package"), F.col("seq").alias("node_seq")
    )
    edges = rows.where("row = 'edge'").select("src", "dst", "type", *common, F.col("seq").alias("edge_seq"))
    return first_wins(nodes, ["id"], "node_seq"), first_wins(edges, ["src", "dst", "type"], "edge_seq"), rows.where("row = 'error'").select("path", "error")
