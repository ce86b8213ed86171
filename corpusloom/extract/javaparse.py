"""A tolerant Java parser: declarations in full, method bodies as tokens with their calls.

It keeps what the fact rules need: packages, imports, types with annotations, supertypes,
fields, methods with parameters and line ranges, and in bodies every call with its scope
and arguments as text without white space.  A file whose braces do not match gives a
ParseError; its facts are then none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """The text is not Java as far as this parser goes."""


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|\.\.\.|&&|\|\||==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|.)""",
    re.S | re.X,
)
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "synchronized", "native", "transient", "volatile", "strictfp", "sealed", "non"}
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]"}, {")", "}", "]"}
#: Words before a parenthesis that are no calls.
_NO_CALL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new", "assert", "else", "do", "try", "super", "this", "case", "instanceof"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Annotation:
    name: str
    values: dict[str, str] = field(default_factory=dict)

    def text(self, *names: str) -> str:
        """The first of the named values that is given, without quotes; lists comma-joined."""
        for name in names:
            if name in self.values:
                raw = self.values[name]
                return ",".join(unquote(x) for x in split_top(raw[1:-1])) if raw.startswith("{") else unquote(raw)
        return ""


@dataclass
class Call:
    name: str
    scope: str
    args: list[str]
    line: int
    depth: int = 0
    created: bool = False  # new Name(args)


@dataclass
class Variable:
    name: str
    type: str
    annotations: list[Annotation]
    line: int = 0


@dataclass
class Method:
    name: str
    type: str
    params: list[Variable]
    annotations: list[Annotation]
    modifiers: set[str]
    start: int
    end: int
    has_body: bool
    text: str = ""
    calls: list[Call] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)

    def annotation(self, *names: str) -> Annotation | None:
        return next((a for a in self.annotations if a.name in names), None)


@dataclass
class Type:
    kind: str
    name: str
    annotations: list[Annotation]
    modifiers: set[str]
    extends: list[str]
    implements: list[str]
    start: int
    end: int = 0
    fields: list[Variable] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    components: list[Variable] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)

    def annotation(self, *names: str) -> Annotation | None:
        return next((a for a in self.annotations if a.name in names), None)


@dataclass
class Unit:
    package: str
    imports: list[tuple[str, bool, bool]]  # name, static, wildcard
    types: list[Type]

    def all_types(self) -> list[Type]:
        out, todo = [], [*self.types]
        while todo:
            t = todo.pop(0)
            out.append(t)
            todo = [*t.types, *todo]
        return out


def unquote(text: str) -> str:
    return re.sub(r'^"|"$', "", text)


def split_top(text: str) -> list[str]:
    """Parts between commas that stand in no bracket and no string."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "\"'":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
        i += 1
    out.append(text[start:])
    return [x for x in out if x]


def glue(tokens: list[Token]) -> str:
    """Tokens as text, with a blank only between words."""
    out = []
    for a, b in zip(tokens, [*tokens[1:], None], strict=False):
        out.append(a.text)
        if b is not None and a.kind in ("id", "num") and b.kind in ("id", "num", "str"):
            out.append(" ")
    return "".join(out)


class Parser:
    def __init__(self, source: str):
        self.tokens, line = [], 1
        for m in _TOKEN.finditer(source):
            if m.lastgroup != "skip":
                self.tokens.append(Token(m.lastgroup, m[0], line))
            line += m[0].count("\n")
        self.i, self.n = 0, len(self.tokens)
        self.mate, stack = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append(k)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise ParseError(f"line {t.line}: {t.text} without its opening bracket")
                self.mate[stack[-1]] = k
                self.mate[k] = stack.pop()
        if stack:
            raise ParseError(f"line {self.tokens[stack[-1]].line}: bracket is not closed")

    def at(self, *texts: str, ahead: int = 0) -> bool:
        k = self.i + ahead
        return k < self.n and self.tokens[k].text in texts

    def take(self) -> Token:
        if self.i >= self.n:
            raise ParseError("the text ends too early")
        self.i += 1
        return self.tokens[self.i - 1]

    def dotted(self) -> str:
        parts = [self.take().text]
        while self.at(".") and self.i + 1 < self.n and self.tokens[self.i + 1].kind == "id":
            self.i += 1
            parts.append(self.take().text)
        return ".".join(parts)

    def unit(self) -> Unit:
        package, imports, types = "", [], []
        while self.i < self.n:
            if self.at(";"):
                self.i += 1
            elif self.at("import"):
                self.i += 1
                static = self.at("static")
                self.i += static
                name = self.dotted()
                wild = self.at(".")
                self.i += 2 * wild
                self.expect(";")
                imports.append((name, static, wild))
            else:
                annotations, modifiers = self.prefix()
                if self.at("package"):
                    self.i += 1
                    package = self.dotted()
                    self.expect(";")
                elif (found := self.type(annotations, modifiers)) is not None:
                    types.append(found)
                else:
                    raise ParseError(f"line {self.tokens[min(self.i, self.n - 1)].line}: a type is expected")
        return Unit(package, imports, types)

    def expect(self, text: str) -> None:
        if not self.at(text):
            raise ParseError(f"line {self.tokens[min(self.i, self.n - 1)].line}: {text} is expected")
        self.i += 1

    def prefix(self) -> tuple[list[Annotation], set[str]]:
        annotations, modifiers = [], set()
        while self.i < self.n:
            if self.at("@") and not self.at("interface", ahead=1):
                annotations.append(self.one_annotation())
            elif self.tokens[self.i].text in _MODIFIERS and not (self.at("default") and self.at(":", "->", ahead=1)):
                modifiers.add(self.take().text)
                if self.at("-") and self.at("sealed", ahead=1):
                    self.i += 2
            else:
                break
        return annotations, modifiers

    def one_annotation(self) -> Annotation:
        self.i += 1
        name = self.dotted().rsplit(".", 1)[-1]
        values: dict[str, str] = {}
        if self.at("("):
            end = self.mate[self.i]
            for part in self.parts(self.i + 1, end):
                if len(part) > 1 and part[0].kind == "id" and part[1].text == "=":
                    values[part[0].text] = glue(part[2:])
                elif part:
                    values["value"] = glue(part)
            self.i = end + 1
        return Annotation(name, values)

    def parts(self, lo: int, hi: int) -> list[list[Token]]:
        """Token runs between commas at this level; commas inside type arguments do not count."""
        out, run, k, angle = [], [], lo, 0
        while k < hi:
            t = self.tokens[k]
            if t.text in _OPEN and t.kind == "op":
                run += self.tokens[k : self.mate[k] + 1]
                k = self.mate[k] + 1
                continue
            if t.text == "<" and k > lo and self.tokens[k - 1].kind == "id" and (self.tokens[k - 1].text[:1].isupper()):
                angle += 1
            elif t.text == ">" and angle:
                angle -= 1
            if t.text == "," and not angle:
                out.append(run)
                run = []
            else:
                run.append(t)
            k += 1
        return [r for r in [*out, run] if r]

    def skip_angles(self) -> str:
        """Type arguments at this place, as text."""
        start, depth = self.i, 0
        while self.i < self.n:
            t = self.take().text
            depth += t == "<"
            depth -= t == ">"
            if not depth:
                break
        return glue(self.tokens[start : self.i])

    def type_name(self) -> str:
        while self.at("@"):
            self.one_annotation()
        text = self.dotted() if not self.at("?") else self.take().text
        while self.at("<", ".", "[", "..."):
            if self.at("<"):
                text += self.skip_angles()
            elif self.at("["):
                self.i = self.mate[self.i] + 1
                text += "[]"
            elif self.at("..."):
                self.i += 1
                text += "..."
            else:
                self.i += 1
                text += "." + self.dotted()
        return text

    def type_list(self) -> list[str]:
        out = [self.type_name()]
        while self.at(",", "&"):
            self.i += 1
            out.append(self.type_name())
        return out

    def type(self, annotations: list[Annotation], modifiers: set[str]) -> Type | None:
        start = self.tokens[self.i].line if self.i < self.n else 0
        if self.at("@") and self.at("interface", ahead=1):
            self.i += 2
            kind = "annotation"
        elif self.at("class", "interface", "enum") or self.at("record") and self.i + 2 < self.n and self.tokens[self.i + 1].kind == "id" and self.tokens[self.i + 2].text in "(<":
            kind = self.take().text
        else:
            return None
        found = Type(kind, self.take().text, annotations, modifiers, [], [], start)
        if self.at("<"):
            self.skip_angles()
        if self.at("("):
            end = self.mate[self.i]
            found.components = self.variables(self.i + 1, end)
            self.i = end + 1
        while self.at("extends", "implements", "permits"):
            word = self.take().text
            names = self.type_list()
            if word != "permits":
                (found.extends if word == "extends" else found.implements).extend(names)
        if not self.at("{"):
            raise ParseError(f"line {start}: type {found.name} has no body")
        end = self.mate[self.i]
        self.i += 1
        if kind == "enum":
            while self.i < end and not self.at(";"):
                self.i = self.mate[self.i] + 1 if self.tokens[self.i].text in _OPEN else self.i + 1
        while self.i < end:
            self.member(found, end)
        self.i = end + 1
        found.end = self.tokens[end].line
        return found

    def variables(self, lo: int, hi: int) -> list[Variable]:
        out = []
        for part in self.parts(lo, hi):
            keep, self_i = part, self.i
            sub = Parser.__new__(Parser)
            sub.tokens, sub.i, sub.n, sub.mate = [*keep, Token("op", ";", keep[-1].line)], 0, len(keep) + 1, {}
            stack = []
            for k, t in enumerate(sub.tokens):
                if t.kind == "op" and t.text in _OPEN:
                    stack.append(k)
                elif t.kind == "op" and t.text in _CLOSE and stack:
                    sub.mate[stack[-1]] = k
                    sub.mate[k] = stack.pop()
            annotations, _ = sub.prefix()
            kind = sub.type_name()
            if sub.tokens[sub.i].kind == "id":
                out.append(Variable(sub.tokens[sub.i].text, kind, annotations, keep[0].line))
            self.i = self_i
        return out

    def member(self, owner: Type, end: int) -> None:
        if self.at(";"):
            self.i += 1
            return
        if self.at("{"):
            self.i = self.mate[self.i] + 1
            return
        start = self.tokens[self.i].line
        annotations, modifiers = self.prefix()
        if self.at("{"):  # a static block
            self.i = self.mate[self.i] + 1
            return
        if (inner := self.type(annotations, modifiers)) is not None:
            owner.types.append(inner)
            return
        if self.at("<"):
            self.skip_angles()
        if self.tokens[self.i].text == owner.name and self.at("(", "{", ahead=1):  # a constructor
            self.i += 1
            if self.at("("):
                self.i = self.mate[self.i] + 1
            while self.i < end and not self.at("{", ";"):
                self.i += 1
            self.i = self.mate[self.i] + 1 if self.at("{") else self.i + 1
            return
        kind = self.type_name()
        if self.i >= end or self.tokens[self.i].kind != "id":
            raise ParseError(f"line {start}: a member of {owner.name} is not understood")
        name = self.take().text
        if self.at("("):
            close = self.mate[self.i]
            params = self.variables(self.i + 1, close)
            self.i = close + 1
            while self.i < end and not self.at("{", ";"):
                self.i = self.mate[self.i] + 1 if self.tokens[self.i].text in _OPEN and self.tokens[self.i].text != "{" else self.i + 1
            method = Method(name, kind, params, annotations, modifiers, start, start, self.at("{"))
            if self.at("{"):
                lo, hi = self.i + 1, self.mate[self.i]
                method.end = self.tokens[hi].line
                method.text = glue(self.tokens[lo:hi])
                method.calls = self.calls(lo, hi)
                method.returns = self.returns(lo, hi)
                self.i = hi + 1
            else:
                method.end = self.tokens[self.i].line if self.i < self.n else start
                self.i += 1
            owner.methods.append(method)
            return
        line = self.tokens[self.i - 1].line
        owner.fields.append(Variable(name, kind, annotations, line))
        while self.i < end and not self.at(";"):
            if self.at(",") and self.i + 1 < end and self.tokens[self.i + 1].kind == "id" and self.i + 2 <= end and self.tokens[self.i + 2].text in (",", ";", "="):
                owner.fields.append(Variable(self.tokens[self.i + 1].text, kind, annotations, line))
            self.i = self.mate[self.i] + 1 if self.tokens[self.i].text in _OPEN else self.i + 1
        self.i += 1

    def scope_start(self, k: int) -> int:
        """Where the expression starts whose last token is k."""
        while True:
            t = self.tokens[k]
            if t.text in (")", "]") and t.kind == "op":
                k = self.mate[k]
                if k and (self.tokens[k - 1].kind == "id" and self.tokens[k - 1].text not in _NO_CALL - {"this", "super"} or self.tokens[k - 1].text in (")", "]")):
                    k -= 1
                    continue
            elif t.text == ">" and k:
                depth = 0
                while k:
                    depth += self.tokens[k].text == ">"
                    depth -= self.tokens[k].text == "<"
                    if not depth:
                        break
                    k -= 1
                k -= 1
                continue
            if k >= 2 and self.tokens[k - 1].text == ".":
                k -= 2
                continue
            if k >= 1 and self.tokens[k - 1].text == "new":
                k -= 1
            return k

    def calls(self, lo: int, hi: int) -> list[Call]:
        out = []
        ends: list[int] = []
        for k in range(lo, hi):
            while ends and ends[-1] <= k:
                ends.pop()
            t = self.tokens[k]
            if t.kind != "id" or k + 1 >= hi or t.text in _NO_CALL:
                continue
            j = k + 1
            before = self.tokens[k - 1].text if k > lo else ""
            if self.tokens[j].text == "<" and before == "new" or before == "new" and self.tokens[j].text == ".":
                while j < hi and self.tokens[j].text not in "({[;":
                    j += 1
            if j >= hi or self.tokens[j].text != "(":
                continue
            args = [glue(p) for p in self.parts(j + 1, self.mate[j])]
            if before == "new":
                out.append(Call(t.text, "", args, t.line, len(ends), True))
                continue
            dot = k - 1
            if before == ">":  # explicit type arguments
                depth = 0
                while dot > lo:
                    depth += self.tokens[dot].text == ">"
                    depth -= self.tokens[dot].text == "<"
                    dot -= 1
                    if not depth:
                        break
            scope = ""
            if dot > lo and self.tokens[dot].text == ".":
                scope = glue(self.tokens[self.scope_start(dot - 1) : dot])
            elif before and self.tokens[k - 1].kind == "id" and before not in ("return", "throw", "else", "do", "case", "assert", "yield"):
                continue  # a local declaration such as ``Type name(``
            out.append(Call(t.text, scope, args, t.line, len(ends)))
            ends.append(self.mate[j])
        return out

    def returns(self, lo: int, hi: int) -> list[str]:
        """Expressions of the return statements of the body itself, not of blocks within."""
        out, k = [], lo
        while k < hi:
            t = self.tokens[k]
            if t.text == "{" and t.kind == "op":
                k = self.mate[k] + 1
            elif t.text == "return":
                j = k
                while j < hi and self.tokens[j].text != ";":
                    j = self.mate[j] + 1 if self.tokens[j].text in _OPEN else j + 1
                out.append(glue(self.tokens[k + 1 : j]))
                k = j + 1
            else:
                k += 1
        return out


def parse(source: str) -> Unit:
    try:
        return Parser(source).unit()
    except (KeyError, IndexError) as e:
        raise ParseError(f"structure is not understood: {e!r}") from e
