"""C#, with the idioms of ASP.NET, dependency injection and Entity Framework."""

from __future__ import annotations

from collections import Counter

from quillgraph.operators.extract.frameworks import CSHARP_MARKERS
from quillgraph.operators.extract.ir import Analysis, Symbol, squeeze
from quillgraph.operators.extract.lexer import literal, tokens

_MODIFIERS = frozenset("public private protected internal static abstract sealed partial readonly virtual override async const new extern unsafe volatile required ref file event implicit explicit".split())
_TYPES = frozenset("class interface struct record enum".split())
_NO_CALL = frozenset("if for foreach while switch catch using lock return typeof nameof sizeof default checked unchecked await base this new when fixed stackalloc throw is as in out ref and or not with".split())
#: Names that are no type of a project, and wrappers whose argument counts instead.
_SCALARS = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort object string dynamic void nint nuint DateTime DateTimeOffset TimeSpan Guid DateOnly TimeOnly String Object var".split())
_WRAPPERS = frozenset("Nullable List IList IEnumerable ICollection IReadOnlyList IReadOnlyCollection Collection HashSet ISet Task ValueTask DbSet IQueryable ObservableCollection".split())
_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
_MAPS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
_LIFETIMES = frozenset("AddScoped AddTransient AddSingleton".split())
#: Registrations whose type argument names a type of the project; without one they tell nothing.
_FEATURES_TYPED = frozenset("UseStartup AddHttpClient AddHostedService AddSchemaTransformer AddOperationTransformer AddDocumentTransformer AddDbContextCheck AddPooledDbContextFactory AddDbContextPool AddDbContextFactory AddDbContext".split())
#: Registrations and middleware that are known by their name alone, which is then looked up without its verb.
_FEATURES = frozenset("Add" + x for x in "SwaggerGen SignalR Session Routing ResponseCompression ResponseCaching RazorPages RateLimiter ProblemDetails OutputCache OpenApi MvcCore Mvc MemoryCache HttpContextAccessor HealthChecks EndpointsApiExplorer DistributedMemoryCache DatabaseDeveloperPageExceptionFilter Cors ControllersWithViews Controllers Authorization Authentication ApiVersioning Antiforgery".split())
_MIDDLEWARE = frozenset("Use" + x for x in "Hsts Mvc Cors Swagger SwaggerUI Session Routing Endpoints WebSockets StaticFiles RateLimiter OutputCache Antiforgery IdentityServer Authorization Authentication HttpsRedirection ExceptionHandler DeveloperExceptionPage ResponseCompression ResponseCaching".split())


def visibility_of(mods: set[str]) -> str:
    if {"protected", "internal"} <= mods:
        return "protectedinternal"
    if {"private", "protected"} <= mods:
        return "privateprotected"
    return next((m for m in ("public", "protected", "internal", "private") if m in mods), "default")


def join_template(prefix: str, template: str) -> str:
    return "/".join(p for p in (prefix.strip("/"), template.strip("/")) if p)


class CSharp:
    def __init__(self, path: str, source: str):
        self.a = Analysis(path, "csharp", source)
        self.t = tokens(source, True)
        self.framework = any(m in source for m in CSHARP_MARKERS)
        self.partials: Counter = Counter()
        self.main: str | None = None

    def run(self) -> Analysis:
        self.declarations(0, len(self.t), (), None)
        return self.a

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def after(self, i: int) -> int:
        return self.t[i].close + 1 if self.t[i].close >= 0 else i + 1

    def generics(self, i: int) -> int:
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.t), i + 200)):
            x = self.text(j)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif not (self.t[j].kind == "i" or x in (",", ".", "?", "[", "]", "::", "(", ")")):
                return i
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        parts = [self.text(i)]
        j = i + 1
        while self.text(j) in (".", "::") and j + 1 < len(self.t) and self.t[j + 1].kind == "i":
            parts.append(self.text(j + 1))
            j += 2
        return ".".join(parts), j

    def qualified(self, names: tuple[str, ...]) -> str:
        return f"{self.a.path}::" + ".".join(names)

    def declarations(self, i: int, end: int, names: tuple[str, ...], owner: Symbol | None) -> None:
        """Usings, namespaces, types and top-level statements (owner None), or the members of a type."""
        mods: set[str] = set()
        marks: list = []
        while i < end:
            t = self.t[i]
            x = t.text
            if x == "[" and t.kind == "p" and (not mods or owner is not None or True) and self.statement_start(i):
                marks += self.attributes(i)
                i = self.after(i)
                continue
            if owner is None and x == "using" and t.kind == "i" and self.text(i + 1) != "(" and self.text(i + 1) != "var":
                i = self.using(i, end)
                continue
            if owner is None and x == "global" and self.text(i + 1) == "using":
                i += 1
                continue
            if x == "namespace" and t.kind == "i":
                name, j = self.dotted(i + 1)
                full = (*names, name)
                ns = self.a.add(Symbol(name if not names else ".".join(full), self.qualified(full), "namespace", t.start, t.end))
                if self.text(j) == "{":
                    stop = min(self.t[j].close, end)
                    self.declarations(j + 1, stop, full, None)
                    ns.end = self.t[min(stop, len(self.t) - 1)].end
                    i = stop + 1
                else:
                    names = full
                    i = j + 1
                continue
            if x in _TYPES and t.kind == "i" and i + 1 < end and self.t[i + 1].kind == "i" and not (x == "record" and self.text(i + 2) in (".", ")")):
                i = self.type(i, end, names, owner, mods, marks)
                mods, marks = set(), []
                continue
            if x in _MODIFIERS and t.kind == "i" and not (x == "new" and owner is None):
                mods.add(x)
                i += 1
                continue
            if x == "delegate":
                while i < end and self.text(i) != ";":
                    i += 1
                mods, marks = set(), []
                continue
            if owner is not None:
                i = self.member(i, end, names, owner, mods, marks)
                mods, marks = set(), []
                continue
            if x not in (";", "}", "{") and self.framework and not names:
                i = self.statement(i, end)
            else:
                i += 1
            mods, marks = set(), []

    def statement_start(self, i: int) -> bool:
        return i == 0 or self.text(i - 1) in ("{", "}", ";", "]") or self.t[i - 1].text in _MODIFIERS

    def statement(self, i: int, end: int) -> int:
        """Top-level statements belong to a Program.Main of the file."""
        j = i
        while j < end and self.text(j) != ";":
            j = self.after(j) if self.t[j].kind == "p" and self.text(j) in "({[" else j + 1
        stop = min(j + 1, end)
        if self.main is None:
            s = Symbol("Main", self.qualified(("Program", "Main")), "method", self.t[i].start, self.t[min(stop, len(self.t)) - 1].end)
            self.a.add(s)
            self.main = s.local_key
        self.body(i, stop, self.main)
        return max(stop, i + 1)

    def using(self, i: int, end: int) -> int:
        j, reason, at = i + 1, None, self.t[i].start
        if self.text(j) == "static":
            reason, j = "static", j + 1
        if self.text(j + 1) == "=":
            reason, j = f"alias:{self.text(j)}", j + 2
        if j < end and self.t[j].kind == "i":
            name, j = self.dotted(j)
            self.a.edge(self.a.path, "imports", "unresolved", name, at, reason=reason)
        while j < end and self.text(j) != ";":
            j += 1
        return j + 1

    def attributes(self, i: int) -> list[tuple[str, int, int]]:
        """(name, place of the arguments or -1, place) of the attributes in the brackets at i."""
        out, j, end = [], i + 1, min(self.t[i].close, len(self.t))
        while j < end:
            if self.text(j + 1) == ":" and self.text(j) in ("assembly", "return", "module", "field", "property", "param", "method", "type"):
                j += 2
            if self.t[j].kind == "i":
                at = j
                name, j = self.dotted(j)
                j = self.generics(j)
                args = j if self.text(j) == "(" else -1
                if args >= 0:
                    j = self.after(j)
                out.append((name.rpartition(".")[2], args, at))
            while j < end and self.text(j) != ",":
                j += 1
            j += 1
        return out

    def decorate(self, key: str, marks: list) -> None:
        for name, _, at in marks:
            self.a.edge(key, "decorates", "none", name, self.t[at].start, reason=name)

    def type(self, i: int, end: int, names: tuple[str, ...], owner: Symbol | None, mods: set[str], marks: list) -> int:
        word, j = self.text(i), i + 1
        record = word == "record"
        kind = word
        if record:
            kind = "class"
            if self.text(j) in ("class", "struct"):
                kind, j = self.text(j), j + 1
        name = self.text(j)
        full = (*names, name)
        q = self.qualified(full)
        partial = "partial" in mods
        ordinal = None
        if partial:
            ordinal = self.partials[q]
            self.partials[q] += 1
        s = Symbol(name, q, kind, self.t[i].start, self.t[i].end, owner.qualified_name if owner else None, "", visibility_of(mods), partial, record, ordinal, top_level=owner is None)
        self.a.add(s)
        if owner is not None:
            self.a.edge(owner.local_key, "contains", "local", s.local_key, self.t[i].start)
        self.decorate(s.local_key, marks)
        j = self.generics(j + 1)
        if self.text(j) == "(":
            j = self.after(j)
        bases: list[str] = []
        if self.text(j) == ":":
            j += 1
            while j < end and self.text(j) not in ("{", ";", "where"):
                if self.t[j].kind == "i":
                    at = self.t[j].start
                    base, j = self.dotted(j)
                    base = base.rpartition(".")[2]
                    if kind != "enum":
                        self.a.edge(s.local_key, "usestype", "unresolved", base, at, reason="c# base list entry")
                        bases.append(base)
                    j = self.generics(j)
                    if self.text(j) == "(":
                        j = self.after(j)
                    continue
                j += 1
        while j < end and self.text(j) not in ("{", ";"):
            j += 1
        if self.text(j) == "{":
            stop = min(self.t[j].close, end)
            if kind == "enum":
                self.enum(j, stop, full, s)
            else:
                if self.framework:
                    self.controller(s, marks, bases)
                    s.roles |= {"repository"} if any(b.endswith("DbContext") for b in bases) else set()
                self.context = self.framework and any(b.endswith("DbContext") for b in bases)
                prefix, is_controller = self.prefix(s, marks), "controller" in s.roles
                held = (getattr(self, "in_controller", None), self.context)
                self.in_controller = (prefix, is_controller)
                self.declarations(j + 1, stop, full, s)
                self.in_controller, self.context = held
            s.end = self.t[min(stop, len(self.t) - 1)].end
            return stop + 1
        return j + 1

    def enum(self, j: int, stop: int, names: tuple[str, ...], s: Symbol) -> None:
        k, fresh = j + 1, True
        while k < stop:
            if fresh and self.t[k].kind == "i":
                f = self.a.add(Symbol(self.text(k), self.qualified((*names, self.text(k))), "field", self.t[k].start, self.t[k].end, s.qualified_name, visibility="public"))
                self.a.edge(s.local_key, "contains", "local", f.local_key, self.t[k].start)
                fresh = False
            if self.text(k) == ",":
                fresh = True
            k = self.after(k) if self.t[k].kind == "p" and self.text(k) in "([{" else k + 1

    def controller(self, s: Symbol, marks: list, bases: list[str]) -> None:
        if any(n == "ApiController" for n, _, _ in marks) or (s.name.endswith("Controller") and any(b in ("ControllerBase", "Controller") for b in bases)):
            s.roles.add("controller")

    def prefix(self, s: Symbol, marks: list) -> str:
        for n, args, _ in marks:
            if n == "Route" and args >= 0 and self.t[args + 1].kind == "s":
                return literal(self.t[args + 1]).replace("[controller]", s.name.removesuffix("Controller"))
        return ""

    def type_name(self, i: int) -> tuple[str | None, int]:
        """The project type that the type at i is about (unwrapped), and the place after it."""
        if i >= len(self.t):
            return None, i
        if self.text(i) == "(":
            return None, self.after(i)
        full, j = self.dotted(i)
        name = full.rpartition(".")[2]
        k = self.generics(j)
        inner = None
        if k > j:
            if name in _WRAPPERS:
                inner, _ = self.type_name(j + 1)
                name = inner or ""
            j = k
        while self.text(j) in ("?", "[", "*"):
            j = self.after(j) if self.text(j) == "[" else j + 1
        return (None if name in _SCALARS or not name else name), j

    def member(self, i: int, end: int, names: tuple[str, ...], owner: Symbol, mods: set[str], marks: list) -> int:
        t = self.t[i]
        if t.kind != "i" and t.text not in ("(", "~"):
            return self.after(i) if t.kind == "p" and t.text in "{[" else i + 1
        visibility = visibility_of(mods)
        if t.text == "~":
            i += 1
            t = self.t[i]
        if t.text == owner.name and self.text(i + 1) == "(":
            return self.callable(i, i + 1, "constructor", end, names, owner, visibility, marks, mods)
        wrapped = self.text(i) == "DbSet" and self.text(i + 1) == "<"
        declared, j = self.type_name(i)
        if j <= i or j >= end:
            return max(i + 1, min(j, end))
        if self.text(j) == "operator":
            while j < end and self.text(j) != "(":
                j += 1
            k = self.after(j) if j < end else end
            return self.past_body(k, end, None)
        if self.t[j].kind != "i":
            return j + 1
        while self.text(j + 1) == "." and j + 2 < end:
            j += 2
        name = self.text(j)
        p = self.generics(j + 1)
        if self.text(p) == "(":
            return self.callable(j, p, "method", end, names, owner, visibility, marks, mods)
        prop = self.text(j + 1) in ("{", "=>") or name == "this"
        kind = "property" if prop else "field"
        k = j
        while True:
            s = self.a.add(Symbol(self.text(k), self.qualified((*names, self.text(k))), kind, self.t[i].start, self.t[k].end, owner.qualified_name, visibility=visibility))
            self.a.edge(owner.local_key, "contains", "local", s.local_key, self.t[k].start)
            self.decorate(s.local_key, marks)
            if declared:
                self.a.edge(s.local_key, "usestype", "unresolved", declared, t.start, reason="c# property/field declared type")
            if wrapped and declared and getattr(self, "context", False):
                for key in (owner.local_key, s.local_key):
                    self.a.edge(key, "persiststo", "unresolved", declared, t.start, "heuristic", "high", f"dbset:{s.name}")
            k += 1
            if prop:
                if self.text(k) == "[":
                    k = self.after(k)
                stop = self.past_body(k, end, s.local_key)
                if self.text(stop) == "=":
                    while stop < end and self.text(stop) != ";":
                        stop = self.after(stop) if self.t[stop].kind == "p" and self.text(stop) in "({[" else stop + 1
                    stop += 1
                return max(stop, i + 1)
            depth_end = k
            while depth_end < end and self.text(depth_end) not in (";", ","):
                depth_end = self.after(depth_end) if self.t[depth_end].kind == "p" and self.text(depth_end) in "({[" else depth_end + 1
            if self.text(depth_end) == "," and depth_end + 1 < end and self.t[depth_end + 1].kind == "i":
                k = depth_end + 1
                continue
            return depth_end + 1

    def past_body(self, k: int, end: int, scope: str | None) -> int:
        """Past a block or an arrow expression at k; what it calls belongs to scope."""
        if self.text(k) == "{":
            stop = min(self.t[k].close, end)
            if scope:
                self.body(k + 1, stop, scope)
            return stop + 1
        if self.text(k) == "=>":
            j = k
            while j < end and self.text(j) != ";":
                j = self.after(j) if self.t[j].kind == "p" and self.text(j) in "({[" else j + 1
            if scope:
                self.body(k + 1, min(j, end), scope)
            return j + 1
        return k + 1 if self.text(k) == ";" else k

    def callable(self, j: int, p: int, kind: str, end: int, names: tuple[str, ...], owner: Symbol, visibility: str, marks: list, mods: set[str]) -> int:
        close = min(self.t[p].close, len(self.t) - 1)
        name = self.text(j)
        s = Symbol(name, self.qualified((*names, name)), kind, self.t[j].start, self.t[j].end, owner.qualified_name, squeeze(self.a.source[self.t[p].end : self.t[close].start]), visibility, "partial" in mods)
        self.a.add(s)
        self.a.edge(owner.local_key, "contains", "local", s.local_key, self.t[j].start)
        self.decorate(s.local_key, marks)
        if self.framework:
            self.routes(s, marks)
        k = close + 1
        while k < end and self.text(k) not in ("{", "=>", ";"):
            k = self.after(k) if self.text(k) in ("(", "[") and self.t[k].kind == "p" else k + 1
        for q in range(p + 1, close):
            if self.t[q].kind == "p" and self.text(q) == "[" and self.text(q - 1) in ("(", ",") and self.framework:
                for n, _, at in self.attributes(q):
                    if n.endswith("Trigger"):
                        self.a.edge(s.local_key, "triggers", "external", n, self.t[at].start, "heuristic", "high", "attribute")
        stop = self.past_body(k, end, s.local_key)
        s.end = self.t[min(max(stop, 1), len(self.t)) - 1].end
        return max(stop, j + 1)

    def routes(self, s: Symbol, marks: list) -> None:
        prefix, is_controller = getattr(self, "in_controller", None) or ("", False)
        found = {n: (args, at) for n, args, at in marks}
        own = ""
        if "Route" in found and found["Route"][0] >= 0 and self.t[found["Route"][0] + 1].kind == "s":
            own = literal(self.t[found["Route"][0] + 1])
        for n, (args, at) in found.items():
            if n in _VERBS and (is_controller or prefix):
                template = literal(self.t[args + 1]) if args >= 0 and self.t[args + 1].kind == "s" else own
                route = join_template(prefix, template).replace("[action]", s.name)
                if template.startswith(("/", "~/")):
                    route = template.lstrip("~").lstrip("/")
                self.a.edge(s.local_key, "handlesroute", "external", f"{_VERBS[n]} {route}", self.t[at].start, "heuristic", "high", "attribute route")
                s.roles.add("route")
            if n in ("Function", "FunctionName"):
                s.roles.add("route")
            if n.endswith("Trigger"):
                self.a.edge(s.local_key, "triggers", "external", n, self.t[at].start, "heuristic", "high", "attribute")

    def body(self, i: int, end: int, scope: str) -> None:
        """Calls, constructions and reads within i .. end."""
        end = min(end, len(self.t))
        while i < end:
            t = self.t[i]
            if t.kind == "i":
                if t.text == "new":
                    if self.text(i + 1) == "(":
                        self.a.edge(scope, "constructs", "unresolved", "", t.start, reason="target-typed new: type is not named here")
                    elif i + 1 < end and self.t[i + 1].kind == "i":
                        name, j = self.dotted(i + 1)
                        name = name.rpartition(".")[2]
                        if name not in _SCALARS and self.text(self.generics(j)) in ("(", "{"):
                            self.a.edge(scope, "constructs", "unresolved", name, t.start)
                        i = self.generics(j)
                        continue
                elif t.text not in _NO_CALL:
                    g = self.generics(i + 1)
                    called = self.text(g) == "("
                    member = self.text(i - 1) in (".", "?.")
                    if called:
                        self.a.edge(scope, "calls", "unresolved", t.text, t.start)
                        if self.framework:
                            self.idiom(i, g, scope, end)
                    elif member and self.text(i + 1) not in (".", "?.") or member and self.text(i + 1) in (".", "?."):
                        self.a.edge(scope, "reads", "unresolved", t.text, t.start)
            i += 1

    def type_args(self, i: int, g: int) -> list[tuple[str, int]]:
        out, j = [], i + 2
        while j < g - 1:
            if self.t[j].kind == "i":
                at = j
                name, j = self.dotted(j)
                out.append((name.rpartition(".")[2], at))
                j = self.generics(j)
                continue
            j += 1
        return out

    def idiom(self, i: int, g: int, scope: str, end: int) -> None:
        name, at = self.text(i), self.t[i].start
        args = self.type_args(i, g) if self.text(i + 1) == "<" else []
        close = min(self.t[g].close, len(self.t))
        if name in _LIFETIMES:
            if len(args) >= 2:
                for n, p in args[:2]:
                    self.a.edge(scope, "registeredas", "unresolved", n, self.t[p].start, "heuristic", "high", f"di:{name}")
            elif len(args) == 1:
                self.a.edge(scope, "registeredas", "unresolved", args[0][0], at, "heuristic", "low", f"di:{name}")
            else:
                for k in range(g + 1, close):
                    if self.text(k) == "typeof" and self.text(k + 1) == "(":
                        n, _ = self.dotted(k + 2)
                        self.a.edge(scope, "registeredas", "unresolved", n.rpartition(".")[2], self.t[k].start, "heuristic", "low", f"di:{name}:typeof")
        elif name in _FEATURES_TYPED:
            if args:
                self.a.edge(scope, "registeredas", "unresolved", args[0][0], at, "heuristic", "high", f"key:feature:{name}")
        elif name in _FEATURES:
            self.a.edge(scope, "registeredas", "unresolved", name[3:], at, "heuristic", "high", f"key:feature:{name}")
        elif name == "UseMiddleware" and args:
            self.a.edge(scope, "registeredas", "unresolved", args[0][0], at, "heuristic", "high", "key:middleware")
        elif name in _MIDDLEWARE:
            self.a.edge(scope, "registeredas", "unresolved", name[3:], at, "heuristic", "high", "key:middleware")
        elif name in _MAPS and g + 1 < len(self.t) and self.t[g + 1].kind == "s":
            prefix = ""
            k = i - 1
            while k >= 0 and self.text(k) not in (";", "{", "}"):
                if self.text(k) == "MapGroup" and self.t[k + 2].kind == "s":
                    prefix = literal(self.t[k + 2]) + prefix
                k -= 1
            route = f"{_MAPS[name]} /{join_template(prefix, literal(self.t[g + 1]))}"
            self.a.edge(scope, "handlesroute", "external", route, at, "heuristic", "high", "minimal api")
            k = g + 3
            if k < close and self.t[k].kind == "i" and self.text(k) not in ("async", "static"):
                handler, j = self.dotted(k)
                if j >= close:
                    self.a.edge(scope, "handlesroute", "unresolved", handler.rpartition(".")[2], self.t[k].start, "heuristic", "high", route)


def analyze(path: str, source: str) -> Analysis:
    return CSharp(path, source).run()
