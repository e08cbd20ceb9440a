"""Declarations in TypeScript/JavaScript, Java and Kotlin, read from tokens whose brackets are matched.

Each reader walks the members of a scope, and goes into the bodies that have declarations of their own. Code that isn't well
formed gives the declarations that can be told; a file without any becomes one chunk.

TypeScript: a declaration begins at its own first word, without export, decorators or comments above. Java and Kotlin: it
begins with the comments right above it; annotations are part of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import wraps

from .code_tokens import DEEPEST, Code, Syntax

#: File extension to language.
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin"}

TYPESCRIPT = Syntax(quotes="\"'", long=("`",), templates=("`",), regex=True)
JAVA = Syntax(quotes="\"'", long=('"""',))
KOTLIN = Syntax(quotes="\"'", long=('"""',), templates=('"', '"""'), nested_comments=True, quoted_names=True)


@dataclass
class Node:
    """A declaration; lines are counted from 1."""

    fragment_type: str
    fqn: str
    start_line: int
    end_line: int
    subtype: str | None = None
    receiver: str | None = None


def _bounded(read):
    """A reader of scopes that goes DEEPEST levels deep at most; what lies deeper has no declarations."""

    @wraps(read)
    def run(self, *args):
        self.depth += 1
        try:
            return read(self, *args) if self.depth <= DEEPEST else []
        finally:
            self.depth -= 1

    return run


class _Reader:
    syntax: Syntax
    #: Signs and words that a statement goes on after, or that go on with one, over a line's end.
    goes_on_after = frozenset("= => -> , . ?. ( [ { + - * / % & | ^ ! ~ ? : < :: in is as instanceof extends implements by".split())
    goes_on_with = frozenset(". ?. ? : | & = => :: { [ ( , ) ] as in is extends implements by where instanceof else".split())

    def __init__(self, text: str):
        self.c = Code(text, self.syntax)
        self.t, self.out, self.depth = self.c.tokens, [], 0

    def end(self, i: int, stop: int) -> int:
        """The last token of a statement that begins at i: a `;`, or the last one of its lines."""
        k = i
        while k < stop:
            if self.c.is_(k, ";"):
                return k
            k = self.c.after(k)
            if k < stop and self.c.is_(k, "}"):
                return k - 1
            if k < stop and self.t[k].fresh and not self.c.is_(k, ";") and self.t[k - 1].text not in self.goes_on_after and (self.t[k].text not in self.goes_on_with or self.t[k - 1].text == "}" and self.t[k].text == "{"):
                return k - 1
        return stop - 1

    def body(self, i: int, stop: int) -> int | None:
        """The `{` that follows in the same declaration, past other brackets; None before a `;` or the scope's end."""
        k = i
        while k < stop and not self.c.is_(k, ";", "}"):
            if self.c.is_(k, "{"):
                return k if k in self.c.close else None
            k = self.c.after(k)
        return None

    def add(self, kind: str, fqn: str, first_line: int, last: int, subtype: str | None = None, receiver: str | None = None) -> None:
        self.out.append(Node(kind, fqn, first_line, self.t[min(last, len(self.t) - 1)].last, subtype, receiver))


class _TypeScript(_Reader):
    syntax = TYPESCRIPT
    modifiers = frozenset("public private protected static async override abstract readonly get set declare accessor".split())

    @_bounded
    def scope(self, i: int, stop: int) -> None:
        """Declarations of the file, of a namespace, or of a block."""
        c, t = self.c, self.t
        exported = False
        while i < stop:
            if c.is_(i, "export"):
                exported, i = True, i + 1
                continue
            if c.is_(i, "default", "declare") and exported | c.is_(i, "declare") and (c.word(i + 1) or c.is_(i + 1, "@")):
                i += 1
                continue
            if t[i].text.startswith("@"):  # a decorator, with what it is called with
                i += 1
                while c.is_(i, "."):
                    i += 2
                i = c.after(i) if c.is_(i, "(") else i
                continue
            i, exported = self.statement(i, stop, exported), False

    def statement(self, i: int, stop: int, exported: bool) -> int:
        """One declaration or statement; gives the token after it."""
        c, t, first = self.c, self.t, i
        line = t[i].line
        if c.is_(i, "{"):
            if i in c.close:
                self.scope(i + 1, c.close[i])
            return c.after(i)
        if c.is_(i, "namespace", "module") and (c.word(i + 1) or t[i + 1 : i + 2] and t[i + 1].kind == "text") and (b := self.body(i + 1, stop)) and not t[i + 1].fresh:
            self.scope(b + 1, c.close[b])
            return c.after(b)
        if c.is_(i, "global") and c.is_(i + 1, "{"):
            return self.statement(i + 1, stop, exported)
        k = i + 1 if c.is_(i, "abstract") and c.is_(i + 1, "class") else i
        if c.is_(k, "class", "interface", "enum") or c.is_(k, "const") and c.is_(k + 1, "enum"):
            k += c.is_(k, "const")
            name, b = k + 1, self.body(k + 1, stop)
            if c.word(name) and not c.is_(name, "extends", "implements") and b is not None:
                kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM"}[t[k].text]
                self.add(kind, t[name].text, line, c.close[b])
                if kind == "CLASS":
                    self.members(b + 1, c.close[b], t[name].text)
                return c.after(b)
            return c.after(b) if b is not None else self.end(i, stop) + 1
        k = i + 1 if c.is_(i, "async") else i
        if c.is_(k, "function"):
            name = k + 2 if c.is_(k + 1, "*") else k + 1
            p = c.angles(name + 1, stop)
            b = self.function_body(p, stop) if c.is_(p, "(") else None
            if c.word(name) and b is not None:
                self.add("FUNCTION", t[name].text, line, c.close[b])
                return c.after(b)
            return (c.after(b) if b is not None else self.end(i, stop) + 1) if c.word(name) else self.end(i, stop) + 1
        if c.is_(i, "type") and c.word(i + 1) and not t[i + 1].fresh:
            last = self.end(i, stop)
            if exported:
                self.add("TYPE", t[i + 1].text, line, last)
            return last + 1
        last = self.end(first, stop)
        if c.is_(i, "const", "let") and (c.word(i + 1) or c.is_(i + 1, "{", "[")):
            for name in self.functions(i + 1, last + 1):
                self.add("FUNCTION", name, line, last)
        elif c.is_(i, "if", "for", "while", "switch", "try", "else", "catch", "finally", "do"):
            b = self.body(i, stop)
            return max(last + 1, c.after(b)) if b is not None and b <= last + 1 else last + 1
        return last + 1

    def function_body(self, p: int, stop: int) -> int | None:
        """The body after parameters at p and a type: braces of the type stand after a `:`, `|`, `&` or a word like `is`."""
        c = self.c
        k = c.after(p)
        while k < stop and not c.is_(k, ";", "}"):
            if c.is_(k, "{") and not c.is_(k - 1, ":", "|", "&", "=>", "is", "extends", "?"):
                return k if k in c.close else None
            if k > c.after(p) and self.t[k].fresh and not c.is_(k, "{", "|", "&", ">", ",") and not c.is_(k - 1, ":", "|", "&", "=>", "<", ","):
                return None
            n = c.angles(k, stop)
            k = n if n > k else c.after(k)
        return None

    def functions(self, i: int, stop: int):
        """Names of declarators `name = function` or `name = (..) =>` up to stop."""
        c, t = self.c, self.t
        while i < stop:
            name, k = i, c.after(i)
            if c.is_(k, "!"):
                k += 1
            while k < stop and not c.is_(k, "=", ",", ";"):  # its type
                n = c.angles(k, stop)
                k = n if n > k else c.after(k)
            if c.is_(k, "=") and not c.is_(k + 1, "="):
                v = k + 2 if c.is_(k + 1, "async") and not c.is_(k + 2, "=>") else k + 1
                if c.word(name) and (c.is_(v, "function") or self.arrow(v, stop)):
                    yield t[name].text
                k += 1
                while k < stop and not c.is_(k, ",", ";"):
                    n = c.angles(k, stop) if c.is_(k + 1, "(") or c.word(k + 1) else k
                    k = n if n > k and c.is_(n, "(") else c.after(k)
            i = k + 1

    def arrow(self, v: int, stop: int) -> bool:
        c = self.c
        if c.word(v) and c.is_(v + 1, "=>"):
            return True
        p = c.angles(v, stop)
        if not c.is_(p, "("):
            return False
        k = c.after(p)
        if c.is_(k, ":"):
            k += 1
            while k < stop and not c.is_(k, "=>", ";", "="):
                n = c.angles(k, stop)
                k = n if n > k else c.after(k)
        return c.is_(k, "=>")

    def members(self, i: int, stop: int, owner: str) -> None:
        c, t = self.c, self.t
        while i < stop:
            if c.is_(i, ";"):
                i += 1
                continue
            if t[i].text.startswith("@"):
                i += 1
                while c.is_(i, "."):
                    i += 2
                i = c.after(i) if c.is_(i, "(") else i
                continue
            first, k = i, i
            while c.is_(k, *self.modifiers) and not c.is_(k + 1, "(", "=", ";", ":", "?", "<", "!") and k + 1 < stop:
                k += 1
            if c.is_(k, "{"):  # a static block
                i = c.after(k)
                continue
            k += c.is_(k, "*")
            name = t[k].text if k < stop and (t[k].kind != "sign") else None
            after = c.after(k)
            if c.is_(k, "[") and k in c.close:
                name = "".join(x.text for x in t[k:after])
            after += c.is_(after, "?", "!")
            p = c.angles(after, stop)
            b = self.function_body(p, stop) if name and c.is_(p, "(") else None
            if b is not None and b < stop:
                self.add("METHOD", f"{owner}.{name}", t[first].line, c.close[b])
                i = c.after(b)
            else:
                i = self.end(first, stop) + 1


class _Java(_Reader):
    syntax = JAVA
    modifiers = frozenset("public protected private static final abstract sealed default synchronized native strictfp transient volatile".split())

    def package(self) -> list[str]:
        c, t = self.c, self.t
        i = next((i for i in range(min(len(t), 400)) if c.is_(i, "package") and t[i].kind == "word" and t[i].fresh), None)
        if i is None:
            return []
        name, k = [], i + 1
        while c.word(k) and not (t[k].fresh and not c.is_(k - 1, ".")):
            name.append(t[k].text)
            if not c.is_(k + 1, "."):
                break
            k += 2
        return [".".join(name)] if name else []

    def words(self, i: int, stop: int) -> int:
        """The token after annotations and modifiers."""
        c, t = self.c, self.t
        while i < stop:
            if t[i].text.startswith("@") and not (t[i].text == "@interface" or t[i].text == "@" and c.is_(i + 1, "interface")):
                i += 1
                while c.is_(i, ".", ":"):
                    i += 2
                i = c.after(i) if c.is_(i, "(") else i
            elif c.is_(i, *self.modifiers) or c.is_(i, "non") and c.is_(i + 1, "-"):
                i += 3 if c.is_(i, "non") else 1
            else:
                break
        return i

    @_bounded
    def scope(self, i: int, stop: int, prefix: list[str], names: list[str]) -> None:
        c, t = self.c, self.t
        while i < stop:
            if c.is_(i, ";"):
                i += 1
                continue
            first, k = i, self.words(i, stop)
            marked = c.is_(k, "@")
            kind = t[k + marked].text.lstrip("@") if k + marked < stop else ""
            noted = kind in ("class", "enum") or kind == "interface" or kind == "record" and c.word(k + 1) and c.is_(c.angles(k + 2, stop), "(")
            if noted and c.word(k + marked + 1) and (b := self.body(k + marked + 2, stop)) is not None:
                name = t[k + marked + 1].text
                if not names:
                    of = {"class": ("CLASS", None), "interface": ("INTERFACE", "ANNOTATION_TYPE" if marked or t[k].text == "@interface" else None), "enum": ("ENUM", None), "record": ("CLASS", "RECORD")}[kind]
                    self.add(of[0], ".".join([*prefix, name]), c.noted(first), c.close[b], of[1])
                if kind == "class":
                    self.scope(b + 1, c.close[b], prefix, [*names, name])
                i = c.after(b)
                continue
            if not names:
                i = self.end(first, stop) + 1
                continue
            i = self.member(first, k, stop, prefix, names)

    def member(self, first: int, k: int, stop: int, prefix: list[str], names: list[str]) -> int:
        """A method, constructor, field or initialiser of the class names[-1]; gives the token after it."""
        c, t = self.c, self.t
        if c.is_(k, "{"):
            self.bodies(k + 1, c.close.get(k, stop), prefix, names)
            return c.after(k)
        start = k = c.angles(k, stop)
        # A type, then the name before the parameters; a constructor has the name alone.
        while k < stop and not c.is_(k, "(", "=", ";", "{", "}"):
            n = c.angles(k, stop)
            k = n if n > k else c.after(k)
        if c.is_(k, "(") and c.word(k - 1):
            name, made = t[k - 1].text, k - 1 == start
            if made and name != names[-1]:
                return self.end(first, stop) + 1
            b = self.body(c.after(k), stop)
            while b is not None and c.is_(b - 1, "default"):
                b = self.body(c.after(b), stop)
            last = c.close[b] if b is not None else self.until(c.after(k), stop)
            self.add("METHOD", ".".join([*prefix, *names, name]), c.noted(first), last, "CONSTRUCTOR" if made else None)
            return last + 1
        last = self.until(k, stop)
        self.bodies(k, last, prefix, names)
        return last + 1

    def until(self, k: int, stop: int) -> int:
        """The `;` that ends a member, or the scope's last token."""
        while k < stop and not self.c.is_(k, ";"):
            k = self.c.after(k)
        return min(k, stop - 1)

    @_bounded
    def bodies(self, i: int, stop: int, prefix: list[str], names: list[str]) -> None:
        """Methods of the anonymous and local classes of a field or an initialiser."""
        c, t = self.c, self.t
        while i < stop:
            if c.is_(i, "new"):
                k = i + 1
                while k < stop and (c.word(k) or c.is_(k, ".")):
                    k += 1
                k = c.angles(k, stop)
                if c.is_(k, "(") and c.is_(c.after(k), "{") and c.after(k) in c.close:
                    self.bodies(k + 1, c.close.get(k, stop), prefix, names)
                    b = c.after(k)
                    self.scope(b + 1, c.close[b], prefix, names)
                    i = c.after(b)
                    continue
            elif c.is_(i, "class") and c.word(i + 1) and not c.is_(i - 1, ".") and (b := self.body(i + 2, stop)) is not None:
                self.scope(b + 1, c.close[b], prefix, [*names, t[i + 1].text])
                i = c.after(b)
                continue
            i += 1


class _Kotlin(_Java):
    syntax = KOTLIN
    modifiers = frozenset("public private internal protected open abstract final override inline suspend operator infix tailrec external const lateinit actual expect value inner data sealed enum annotation vararg noinline crossinline".split())

    def modified(self, i: int, stop: int) -> int:
        """The token after annotations and modifiers; a modifier's word may also be a name."""
        c, t = self.c, self.t
        while i < stop:
            if t[i].text.startswith("@"):
                i += 1
                while c.is_(i, ".", ":"):
                    i += 2
                i = c.after(i) if c.is_(i, "(", "[") and not t[i].fresh else i
            elif c.is_(i, *self.modifiers) and (c.word(i + 1) or i + 1 < stop and t[i + 1].text.startswith("@")):
                i += 1
            else:
                break
        return i

    @_bounded
    def kotlin(self, i: int, stop: int, prefix: list[str], names: list[str]) -> list[tuple[int, int]]:
        """Reads a scope; gives the first and last token of its properties, one after another, as runs."""
        c, t = self.c, self.t
        runs: list[list[int]] = []
        joined = False
        path = lambda *more: ".".join([*prefix, *names, *more])
        while i < stop:
            if c.is_(i, ";", ","):
                i += 1
                continue
            first, k = i, self.modified(i, stop)
            held = {x.text for x in t[first:k]}
            fun_interface = c.is_(k, "fun") and c.is_(k + 1, "interface")
            k += fun_interface
            if c.is_(k, "val", "var") and k + 1 < stop:
                last = self.property_end(k, stop)
                if joined and not c.notes[first]:
                    runs[-1][1] = last
                else:
                    runs.append([first, last])
                joined, i = True, last + 1
                continue
            joined = False
            if c.is_(k, "class", "interface", "object") or c.is_(k, "companion") and c.is_(k + 1, "object"):
                companion = c.is_(k, "companion")
                at = k + 1 + companion
                name = t[at].text if c.word(at) and not t[at].fresh else None
                if name is None and not companion:
                    i = self.end(first, stop) + 1
                    continue
                last, b = self.head(at + (name is not None), stop)
                name = name or "Companion"
                kind, subtype = ("CLASS", None)
                if companion:
                    subtype = "COMPANION_OBJECT"
                elif c.is_(k, "object"):
                    subtype = "OBJECT"
                elif "enum" in held:
                    kind = "ENUM"
                elif c.is_(k, "interface"):
                    kind = "INTERFACE"
                elif "data" in held or "sealed" in held:
                    subtype = "DATA_CLASS" if "data" in held else "SEALED_CLASS"
                if companion or not names:
                    self.add(kind, path(name), c.noted(first), last, subtype)
                if b is not None:
                    self.kotlin(b + 1, c.close[b], prefix, [*names, name])
                i = last + 1
            elif c.is_(k, "fun") and not c.is_(k + 1, "("):
                i = self.function(first, k, stop, path, bool(names))
            else:
                # Anything else: blocks in it (initialisers, bodies of enum entries, calls) may hold declarations.
                last = self.end(first, stop) if first < stop else first
                for b in range(first, last + 1):
                    if c.is_(b, "{") and b in c.close:
                        self.kotlin(b + 1, c.close[b], prefix, names)
                        last = max(last, c.close[b])
                        break
                i = max(last, first) + 1
        return [(a, b) for a, b in runs]

    def head(self, k: int, stop: int) -> tuple[int, int | None]:
        """The last token of a type's declaration, and the brace of its body if there is one."""
        c, t = self.c, self.t
        while k < stop:
            if c.is_(k, "{"):
                return (c.close[k], k) if k in c.close else (stop - 1, None)
            if c.is_(k, ";", "}"):
                return k - 1, None
            if t[k].fresh and not c.is_(k, ":", ",", "where", "constructor", "(", "private", "internal", "protected") and not c.is_(k - 1, ":", ",", "by", "<", "constructor"):
                return k - 1, None
            n = c.angles(k, stop)
            k = n if n > k else c.after(k)
        return stop - 1, None

    def function(self, first: int, k: int, stop: int, path, inside: bool) -> int:
        c, t = self.c, self.t
        i = c.angles(k + 1, stop)
        start = i
        while c.word(i) or c.is_(i, ".", "?", "?."):  # receiver and name
            n = c.angles(i + 1, stop)
            i = n if n > i + 1 else i + 1
        if not c.is_(i, "(") or not c.word(i - 1):
            return self.end(first, stop) + 1
        name, receiver = t[i - 1].text, "".join(x.text for x in t[start : i - 2]) + ("?" if c.is_(i - 2, "?.") else "")
        p = c.after(i)
        while p < stop and not c.is_(p, "{", "=", ";", "}") and not (t[p].fresh and not c.is_(p, ":", "where") and not c.is_(p - 1, ":", "->", ",", "where")):
            n = c.angles(p, stop)
            p = n if n > p else c.after(p)
        if c.is_(p, "{") and p in c.close:
            last = c.close[p]
        elif c.is_(p, "="):
            last = self.end(p, stop)
        else:
            last = p - 1
        if inside:
            self.add("METHOD", path(name), c.noted(first), last)
        elif receiver:
            self.add("FUNCTION", path(name), c.noted(first), last, "EXTENSION_FUNCTION", receiver)
        else:
            self.add("FUNCTION", path(name), c.noted(first), last)
        return last + 1

    def property_end(self, k: int, stop: int) -> int:
        """The last token of a property with its getter and setter."""
        c, t = self.c, self.t
        last = self.end(k, stop)
        while True:
            n = last + 1
            n = self.modified(n, stop) if n < stop else n
            if not (c.is_(n, "get", "set") and (c.is_(n + 1, "(") or n + 1 >= stop or t[n + 1].fresh)):
                return last
            p = c.after(n + 1) if c.is_(n + 1, "(") else n + 1
            while p < stop and not t[p].fresh and not c.is_(p, "{", "="):
                p = c.after(p)
            last = c.close[p] if c.is_(p, "{") and p in c.close else self.end(p, stop) if c.is_(p, "=") else p - 1


def typescript(code: str) -> list[Node]:
    """CLASS with its METHODs, INTERFACE, FUNCTION, ENUM, exported TYPE; also inside namespaces and blocks of the file."""
    r = _TypeScript(code)
    r.scope(0, len(r.t))
    return r.out


def java(code: str) -> list[Node]:
    """Top-level types; methods and constructors of classes at any depth, and of anonymous classes of their fields."""
    r = _Java(code)
    r.scope(0, len(r.t), r.package(), [])
    return r.out


def kotlin(code: str) -> list[Node]:
    """Top-level types and objects, companions, functions, methods; then runs of top-level properties."""
    r = _Kotlin(code)
    package = r.package()
    for first, last in r.kotlin(0, len(r.t), package, []):
        line = r.t[first].line
        r.add("FUNCTION", ".".join([*package, f"_properties_{line}"]), line, last, "PROPERTIES")
    return r.out


EXTRACTORS = {"typescript": typescript, "tsx": typescript, "javascript": typescript, "java": java, "kotlin": kotlin}
