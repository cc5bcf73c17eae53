"""TypeScript and JavaScript, with the idioms of Angular."""

from __future__ import annotations

from quillgraph.operators.extract.frameworks import WEB_MARKERS
from quillgraph.operators.extract.ir import Analysis, Symbol, squeeze
from quillgraph.operators.extract.lexer import Token, literal, tokens

_NO_CALL = frozenset("if for while switch catch function return typeof await super import new constructor do else with case void delete in of instanceof yield throw".split())
_MODIFIERS = frozenset("public private protected static readonly async abstract override declare accessor get set".split())
_BUILTIN = frozenset("string number boolean any void unknown never object null undefined symbol bigint this".split())
_HOSTS = frozenset("Component Directive Pipe Injectable NgModule".split())


class Web:
    def __init__(self, path: str, language: str, source: str):
        self.a = Analysis(path, language, source)
        self.t = tokens(source, False)
        self.angular = any(m in source for m in WEB_MARKERS)
        self.qname = lambda *parts: f"{path}::" + ".".join(parts)

    def run(self) -> Analysis:
        self.block(0, len(self.t), None)
        return self.a

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def after(self, i: int) -> int:
        """The place after a bracket's partner."""
        return self.t[i].close + 1 if self.t[i].close >= 0 else i + 1

    def generics(self, i: int) -> int:
        """The place after <...> at i, if it is there."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.t[j].text
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif x in "({[" and self.t[j].kind == "p":
                j = self.after(j) - 1
            elif x in (";", "}"):
                return i
            j += 1
        return i

    def block(self, i: int, end: int, scope: str | None) -> None:
        """Statements at the top level of a file (scope None) or in the body of the symbol `scope`."""
        decorators: list[tuple[Token, int, int]] = []
        exported = False
        while i < end:
            t = self.t[i]
            x = t.text
            if x == "@" and self.t[i].kind == "p" and i + 1 < end:
                i = self.decorator(i, decorators)
                continue
            if x == "import" and t.kind == "i" and scope is None and self.text(i + 1) not in ("(", "."):
                i = self.imports(i, end)
                continue
            if x == "export" and t.kind == "i" and scope is None:
                j = self.exports(i, end)
                if j > i + 1:
                    i = j
                    continue
                exported = True
                i += 1
                if self.text(i) == "default":
                    i += 1
                continue
            if x in ("abstract", "declare", "async", "default") and t.kind == "i" and self.text(i + 1) in ("class", "function", "interface", "async"):
                i += 1
                continue
            if x == "class" and t.kind == "i" and i + 1 < end and self.t[i + 1].kind == "i":
                i = self.klass(i, end, decorators, exported, scope)
                decorators, exported = [], False
                continue
            if x == "interface" and t.kind == "i" and scope is None and i + 1 < end and self.t[i + 1].kind == "i":
                i = self.interface(i, end, exported)
                decorators, exported = [], False
                continue
            if x == "function" and t.kind == "i":
                i = self.function(i, end, scope, exported)
                decorators, exported = [], False
                continue
            if x in ("const", "let", "var") and t.kind == "i":
                exported = False
                i = self.variable(i, end, scope)
                continue
            i = self.expression(i, end, scope)
            decorators, exported = [], False

    def expression(self, i: int, end: int, scope: str | None) -> int:
        """One token of an expression; calls and constructions within a function become edges."""
        t = self.t[i]
        if scope is not None and t.kind == "i":
            if t.text == "new" and i + 1 < end and self.t[i + 1].kind == "i":
                j = i + 1
                while self.text(j + 1) == "." and j + 2 < end:
                    j += 2
                self.a.edge(scope, "constructs", "unresolved", self.text(j), t.start)
                return self.generics(j + 1)
            if t.text not in _NO_CALL:
                j = self.generics(i + 1) if self.text(i + 1) == "<" else i + 1
                if self.text(j) == "(" and self.text(i - 1) not in ("function", "new"):
                    self.a.edge(scope, "calls", "unresolved", t.text, t.start)
                    if self.angular and t.text == "inject":
                        self.inject_call(i, j, scope)
        return i + 1

    def inject_call(self, i: int, j: int, scope: str) -> None:
        if j + 1 < len(self.t) and self.t[j + 1].kind == "i":
            self.a.edge(scope, "injects", "unresolved", self.text(j + 1), self.t[i].start, "heuristic", "high", "di:inject-fn")

    def annotation(self, i: int, end: int, scope: str) -> str | None:
        """The bare type after the colon at i, as a reference from scope."""
        if self.text(i) != ":" or i + 1 >= end or self.t[i + 1].kind != "i":
            return None
        name = self.text(i + 1)
        if name in _BUILTIN or self.text(i + 2) in ("<", ".", "[", "|", "&"):
            return None
        self.a.edge(scope, "references", "unresolved", name, self.t[i + 1].start)
        return name

    def variable(self, i: int, end: int, scope: str | None) -> int:
        j = i + 1
        name = self.text(j)
        if j < end and self.t[j].kind == "i":
            kind = self.annotation(j + 1, end, scope or self.a.path)
            if self.angular and scope is None:
                k = j + 1
                while k < end and self.text(k) not in ("=", ";"):
                    k += 1
                if self.text(k) == "=" and self.text(k + 1) == "[" and (kind == "Routes" or self.text(j + 2) == "Routes" or "routes" in name.lower()):
                    s = self.a.add(Symbol(name, self.qname(name), "variable", self.t[i].start, self.t[min(self.t[k + 1].close, len(self.t) - 1)].end, top_level=True, roles={"route"}))
                    self.routes(k + 1, s.local_key, "")
                    return self.after(k + 1)
            return j + 1
        return i + 1

    def params(self, i: int, scope: str) -> list[tuple[int, str | None, list]]:
        """(index, type, decorators) of the parameters in the parentheses at i."""
        out, j, end, n = [], i + 1, self.t[i].close, 0
        decorators: list = []
        kind: str | None = None
        seen = False
        while j <= min(end, len(self.t) - 1):
            x = self.text(j)
            if x == "@" and j + 1 < end:
                j = self.decorator(j, decorators)
                seen = True
                continue
            if (x == "," or j == end) and (seen or j != end):
                out.append((n, kind, decorators))
                n, kind, decorators, seen = n + 1, None, [], False
            elif x == ":" and kind is None:
                kind = self.annotation(j, end, scope) or (self.text(j + 1) if j + 1 < end and self.t[j + 1].kind == "i" else None)
                seen = True
                j = self.generics(j + 2) if self.text(j + 2) == "<" else j + 2
                continue
            elif x in ("(", "[", "{") and self.t[j].kind == "p":
                j = self.after(j)
                seen = True
                continue
            else:
                seen = True
            j += 1
        return out

    def body(self, i: int, end: int, scope: str) -> int:
        """Past parameters and a return type at i, to the end of the body, if there is one."""
        if self.text(i) != "(":
            return i
        j = self.after(i)
        if self.text(j) == ":":
            self.annotation(j, end, scope)
            j += 1
            while j < end and self.text(j) not in ("{", ";", "}"):
                j = self.after(j) if self.text(j) in ("(", "[") and self.t[j].kind == "p" else j + 1
        if self.text(j) == "{":
            stop = min(self.t[j].close, end)
            self.block(j + 1, stop, scope)
            return stop + 1
        return j

    def function(self, i: int, end: int, scope: str | None, exported: bool) -> int:
        j = i + 1
        if self.text(j) == "*":
            j += 1
        if scope is not None or j >= end or self.t[j].kind != "i":
            return j if scope is not None and self.text(j) == "(" else j + (self.t[j].kind == "i" if j < end else 0)
        name, p = self.text(j), self.generics(j + 1)
        s = Symbol(name, self.qname(name), "function", self.t[i].start, self.t[i].end, exported=exported, top_level=True, fingerprint=self.signature(p))
        self.a.add(s)
        if self.text(p) == "(":
            self.params(p, s.local_key)
        stop = self.body(p, end, s.local_key)
        s.end = self.t[min(stop, len(self.t)) - 1].end
        return max(stop, j + 1)

    def signature(self, p: int) -> str:
        if self.text(p) != "(":
            return ""
        close = min(self.t[p].close, len(self.t) - 1)
        inner = squeeze(self.a.source[self.t[p].end : self.t[close].start])
        return inner

    def interface(self, i: int, end: int, exported: bool) -> int:
        name = self.text(i + 1)
        s = self.a.add(Symbol(name, self.qname(name), "interface", self.t[i].start, self.t[i].end, exported=exported, top_level=True))
        j = self.generics(i + 2)
        while j < end and self.text(j) != "{":
            if self.t[j].kind == "i" and self.text(j) != "extends":
                self.a.edge(s.local_key, "inherits", "unresolved", self.text(j), self.t[j].start)
                j = self.generics(j + 1)
                continue
            j += 1
        stop = min(self.t[j].close, end) if j < end else end
        s.end = self.t[min(stop, len(self.t) - 1)].end
        return stop + 1

    def decorator(self, i: int, held: list) -> int:
        j = i + 1
        while self.text(j + 1) == "." and j + 2 < len(self.t):
            j += 2
        if self.text(j + 1) == "(":
            held.append((self.t[j], j + 1, self.t[j + 1].close))
            return self.after(j + 1)
        held.append((self.t[j], -1, -1))
        return j + 1

    def decorate(self, owner: str, held: list, reason: str | None = None) -> None:
        for t, _, _ in held:
            self.a.edge(owner, "decorates", "none", t.text, t.start, reason=reason or t.text)

    def klass(self, i: int, end: int, decorators: list, exported: bool, scope: str | None) -> int:
        name, j = self.text(i + 1), self.generics(i + 2)
        s = Symbol(name, self.qname(name), "class", self.t[i].start, self.t[i].end, exported=exported, top_level=scope is None)
        self.a.add(s)
        mode = None
        while j < end and self.text(j) != "{":
            t = self.t[j]
            if t.text in ("extends", "implements"):
                mode = "inherits" if t.text == "extends" else "implements"
            elif t.kind == "i" and mode:
                while self.text(j + 1) == "." and j + 2 < end:
                    j += 2
                self.a.edge(s.local_key, mode, "unresolved", self.text(j), t.start)
                j = self.generics(j + 1)
                if self.text(j) == "(":
                    j = self.after(j)
                continue
            j += 1
        self.decorate(s.local_key, decorators)
        names = {t.text for t, _, _ in decorators}
        if self.angular:
            self.roles(s, names)
            for t, a, b in decorators:
                if a >= 0 and t.text in ("NgModule", "Component", "Directive"):
                    self.metadata(s.local_key, a, min(b, len(self.t)))
        if j >= end:
            return end
        stop = min(self.t[j].close, end)
        self.members(j + 1, stop, s, bool(names & _HOSTS) and self.angular)
        s.end = self.t[min(stop, len(self.t) - 1)].end
        return stop + 1

    def roles(self, s: Symbol, names: set[str]) -> None:
        if "Component" in names:
            s.roles.add("component")
        if names & {"Directive", "Pipe"}:
            s.roles.add("decorator")
        if "Injectable" in names:
            s.roles.add("service")
            if s.name.endswith(("Repository", "Store")):
                s.roles.add("repository")

    def members(self, i: int, end: int, owner: Symbol, host: bool) -> None:
        held: list = []
        visibility = "default"
        while i < end:
            t = self.t[i]
            if t.text == "@" and t.kind == "p":
                i = self.decorator(i, held)
                continue
            if t.text in _MODIFIERS and t.kind == "i" and self.text(i + 1) not in ("(", "=", ":", ";", "?", "}"):
                if t.text in ("public", "private", "protected"):
                    visibility = t.text
                i += 1
                continue
            if t.text in (";", ",", "*"):
                i += 1
                continue
            if t.kind in ("i", "s", "n") or t.text == "[":
                name = literal(t) if t.kind == "s" else t.text
                j = self.after(i) if t.text == "[" else i + 1
                if self.text(j) in ("?", "!"):
                    j += 1
                p = self.generics(j)
                if self.text(p) == "(" and t.text != "[":
                    kind = "constructor" if name == "constructor" else "method"
                    s = Symbol(name, self.qname(owner.name, name), kind, t.start, t.end, owner.qualified_name, self.signature(p), visibility)
                    self.a.add(s)
                    self.a.edge(owner.local_key, "contains", "local", s.local_key, t.start)
                    self.decorate(s.local_key, held)
                    for n, typ, marks in self.params(p, s.local_key):
                        self.decorate(s.local_key, marks, f"param:{n}")
                        if kind == "constructor" and host:
                            self.inject_param(owner.local_key, n, typ, marks, self.t[p].start)
                    stop = self.body(p, end, s.local_key)
                    s.end = self.t[min(stop, len(self.t)) - 1].end
                    i = max(stop, i + 1)
                else:
                    self.annotation(j, end, owner.local_key)
                    self.decorate(owner.local_key, held)
                    i = self.field(j, end, owner, host)
                held, visibility = [], "default"
                continue
            i = self.after(i) if t.text in ("{", "(") and t.kind == "p" else i + 1

    def field(self, j: int, end: int, owner: Symbol, host: bool) -> int:
        line = self.a.place(self.t[j - 1].start)[1]
        while j < end and self.text(j) != ";":
            t = self.t[j]
            here = self.a.place(t.start)[1]
            if here > line and t.text not in (".", "?.", "=", "=>", "|", "&", "?", ":", ")", "]", "}", "+", "-") and self.text(j - 1) not in ("=", "=>", ".", "?.", ",", "|", "&", "(", "+", "-", "?", ":"):
                return j
            if t.text == "inject" and self.text(self.generics(j + 1)) == "(" and host:
                self.inject_call(j, self.generics(j + 1), owner.local_key)
            if t.kind == "p" and t.text in "({[":
                j = self.after(j)
                line = self.a.place(self.t[min(j, len(self.t)) - 1].start)[1]
                continue
            line = here
            j += 1
        return j + 1 if self.text(j) == ";" else j

    def inject_param(self, owner: str, n: int, typ: str | None, marks: list, at: int) -> None:
        for t, a, _ in marks:
            if t.text == "Inject" and a >= 0:
                if a + 1 < len(self.t) and self.t[a + 1].kind == "i":
                    self.a.edge(owner, "injects", "unresolved", self.text(a + 1), t.start, "heuristic", "medium", f"di:token:{n}")
                else:
                    self.a.edge(owner, "injects", "none", "", t.start, "heuristic", "unresolved", "injection token is not a name")
                return
        if typ is None or typ in _BUILTIN:
            self.a.edge(owner, "injects", "none", typ or "", at, "heuristic", "unresolved", "constructor parameter has no injectable type")
        else:
            self.a.edge(owner, "injects", "unresolved", typ, at, "heuristic", "high", f"di:ctor-param:{n}")

    def entries(self, i: int) -> list[tuple[str, int]]:
        """(key, place of the value) of the object literal at i."""
        out, j, end = [], i + 1, self.t[i].close
        start = True
        while j < min(end, len(self.t)):
            t = self.t[j]
            if start and t.kind in ("i", "s") and self.text(j + 1) == ":":
                out.append((literal(t), j + 2))
                j += 2
                start = False
                continue
            if t.kind == "p" and t.text in "({[":
                j = self.after(j)
                start = False
                continue
            start = t.text == ","
            j += 1
        return out

    def items(self, i: int) -> list[int]:
        """Places of the elements of the array literal at i."""
        out, j, end, start = [], i + 1, self.t[i].close, True
        while j < min(end, len(self.t)):
            t = self.t[j]
            if start and t.text != ",":
                out.append(j)
                start = False
            if t.kind == "p" and t.text in "({[":
                j = self.after(j)
                continue
            if t.text == ",":
                start = True
            j += 1
        return out

    def metadata(self, owner: str, a: int, b: int) -> None:
        if self.text(a + 1) != "{":
            return
        for key, v in self.entries(a + 1):
            if key not in ("providers", "imports") or self.text(v) != "[":
                continue
            for item in self.items(v):
                t = self.t[item]
                if t.kind == "i":
                    self.a.edge(owner, "registeredas", "unresolved", t.text, t.start, "heuristic", "high", f"key:{key}")
                elif t.text == "{":
                    e = dict(self.entries(item))
                    use = next((e[k] for k in ("useClass", "useExisting", "provide") if k in e), None)
                    if use is not None and self.t[use].kind == "i":
                        token = self.text(e["provide"]) if "provide" in e else ""
                        reason = f"key:{key}:HTTP_INTERCEPTORS" if token == "HTTP_INTERCEPTORS" else f"key:{key}"
                        self.a.edge(owner, "registeredas", "unresolved", self.text(use), self.t[use].start, "heuristic", "high", reason)

    def routes(self, i: int, owner: str, prefix: str) -> None:
        for item in self.items(i):
            if self.text(item) != "{":
                continue
            e = dict(self.entries(item))
            path = literal(self.t[e["path"]]) if "path" in e and self.t[e["path"]].kind in ("s", "t") else ""
            full = "/".join(p for p in (prefix.rstrip("/"), path.strip("/")) if p)
            if "component" in e:
                self.a.edge(owner, "handlesroute", "unresolved", self.text(e["component"]), self.t[e["component"]].start, "heuristic", "high", f"route:/{full}")
            if "canActivate" in e and self.text(e["canActivate"]) == "[":
                for g in self.items(e["canActivate"]):
                    if self.t[g].kind == "i":
                        self.a.edge(owner, "registeredas", "unresolved", self.text(g), self.t[g].start, "heuristic", "high", "key:canActivate")
            if "loadComponent" in e:
                stop = self.t[item].close
                names = [k for k in range(e["loadComponent"], stop) if self.text(k - 1) == "." and self.t[k].kind == "i" and self.text(k) != "then"]
                if names:
                    self.a.edge(owner, "handlesroute", "unresolved", self.text(names[0]), self.t[names[0]].start, "heuristic", "medium", f"route:/{full}")
            if "loadChildren" in e:
                self.a.edge(owner, "handlesroute", "none", f"/{full}", self.t[e["loadChildren"]].start, "heuristic", "unresolved", "lazy route children are not followed")
            if "children" in e and self.text(e["children"]) == "[":
                self.routes(e["children"], owner, full)

    def imports(self, i: int, end: int) -> int:
        j, names = i + 1, []
        at = self.t[i].start
        if self.text(j) == "type" and self.text(j + 1) not in (",", "from"):
            j += 1
        while j < end and self.text(j) not in ("from", ";") and self.t[j].kind != "s":
            t = self.t[j]
            if t.text == "*":
                names.append("*")
                j += 3
                continue
            if t.text == "{":
                for k in range(j + 1, min(t.close, end)):
                    if self.t[k].kind == "i" and self.text(k - 1) in ("{", ",", "type") and self.text(k) != "type":
                        names.append(self.text(k))
                j = self.after(j)
                continue
            if t.kind == "i":
                names.append("default")
            j += 1
        if self.text(j) == "from":
            j += 1
        if j < end and self.t[j].kind == "s":
            spec = literal(self.t[j])
            for n in names:
                self.a.edge(self.a.path, "imports", "unresolved", n, at, reason=n, specifier=spec)
            j += 1
        return max(j, i + 1)

    def exports(self, i: int, end: int) -> int:
        """The place after an export that is a statement of its own; i + 1 where a declaration follows."""
        j, at = i + 1, self.t[i].start
        if self.text(j) == "type" and self.text(j + 1) == "{":
            j += 1
        if self.text(j) == "{":
            stop = min(self.t[j].close, end)
            names = [(self.text(k), self.t[k].start) for k in range(j + 1, stop) if self.t[k].kind == "i" and self.text(k - 1) in ("{", ",", "type") and self.text(k) != "type"]
            if self.text(stop + 1) == "from" and stop + 2 < end:
                for n, _ in names:
                    self.a.edge(self.a.path, "exports", "unresolved", n, at, reason=n, specifier=literal(self.t[stop + 2]))
                return stop + 3
            for n, where in names:
                self.a.edge(self.a.path, "exports", "unresolved", n, where)
            return stop + 1
        if self.text(j) == "*":
            k = j + 1
            while k < end and self.t[k].kind != "s" and self.text(k) != ";":
                k += 1
            if k < end and self.t[k].kind == "s":
                self.a.edge(self.a.path, "exports", "unresolved", "*", at, reason="*", specifier=literal(self.t[k]))
            return k + 1
        if self.text(j) == "default" and j + 1 < end and self.t[j + 1].kind == "i" and self.text(j + 1) not in ("class", "function", "abstract", "async", "interface", "new"):
            self.a.edge(self.a.path, "exports", "unresolved", self.text(j + 1), at, reason="default")
            return j + 2
        return i + 1


def analyze(path: str, language: str, source: str) -> Analysis:
    return Web(path, language, source).run()
