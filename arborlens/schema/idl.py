"""Compiles the part of WebIDL that tree schemas use.

Known are typedefs, enums and interfaces of attributes; ``FrozenArray<T>``, unions ``(A or B)`` of simple types and ``T?``.
An interface that inherits from Node is a node. ``[IdentifierType=tag]`` before a typedef of strings makes it a type of
names; ``[Lazy]`` marks an attribute. Other extended attributes are read and not used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from arborlens.schema.types import NULL, Enum, Iface, Schema, SchemaError, Typedef, optional

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<text>"[^"]*")|(?P<word>-?[A-Za-z_][\w-]*|-?\d+(?:\.\d+)?)|(?P<mark>[\[\]{}()<>?;:,=])', re.S)
_SLUG = re.compile(r"([A-Z][a-z0-9]*)+")
_SIMPLE = {"boolean": "bool", "double": "f64", "string": "str", "DOMString": "str"}

#: Names of operator symbols and words, as they appear in alphabets.
SYMBOLS = dict(
    line.split()
    for line in """
var KwVar
let KwLet
const KwConst
in KwIn
instanceof KwInstanceof
typeof KwTypeof
void KwVoid
delete KwDelete
, Comma
|| LogicalOr
&& LogicalAnd
! LogicalNot
| Bitor
^ Bitxor
& Bitand
~ Bitnot
== Equal
!= NotEqual
=== StrictEqual
!== NotStrictEqual
< LessThan
<= LessEqual
> GreaterThan
>= GreaterEqual
<< Lsh
>> Rsh
>>> Arsh
+ Plus
- Minus
* Mul
/ Div
% Mod
** Pow
++ PlusPlus
-- MinusMinus
""".strip().splitlines()
)
_PHRASES = {"non-const lexical": "NonConstLexical", "const lexical": "ConstLexical"}


def symbol_name(text: str) -> str:
    """The variant name of an enum's text: a known symbol, an assignment operator by its operator, or a capitalised word."""
    if text in SYMBOLS or text in _PHRASES:
        return SYMBOLS.get(text) or _PHRASES[text]
    if text.endswith("=") and text[:-1] in SYMBOLS:
        return SYMBOLS[text[:-1]] + "Assign"
    if re.fullmatch(r"[A-Za-z0-9]+([ _-][A-Za-z0-9]+)*", text):
        words = "".join(w.capitalize() for w in re.split(r"[ _-]", text))
        return words if words[0].isalpha() else f"N{words}"
    raise SchemaError(f"no name for the symbol {text!r}")


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at : at + 20]!r} in line {text.count(chr(10), 0, at) + 1}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[m.lastgroup], text.count("\n", 0, m.start()) + 1
    yield "end", "", text.count("\n") + 1


class _Reader:
    def __init__(self, text: str, symbols: Callable[[str], str], compat: bool):
        self.tokens, self.at, self.symbols, self.compat = list(_tokens(text)), 0, symbols, compat

    def fail(self, wanted: str):
        kind, text, line = self.tokens[self.at]
        raise SchemaError(f"line {line}: {wanted} expected, not {text or kind!r}")

    def take(self, *marks: str) -> str | None:
        if self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            self.fail(repr(mark))

    def word(self) -> str:
        kind, text, _ = self.tokens[self.at]
        if kind != "word":
            self.fail("a name")
        self.at += 1
        return text.removeprefix("_")  # an underscore escapes words of the language

    def attributes(self) -> dict[str, str | None]:
        """Extended attributes before a declaration or member."""
        found: dict[str, str | None] = {}
        while self.take("["):
            while not self.take("]"):
                name = self.word()
                found[name] = self.word() if self.take("=") else None
                self.take(",")
        return found

    def type_(self, nested: bool = False) -> tuple:
        if self.take("("):
            parts = [self.type_(nested=True)]
            while self.take("or"):
                parts.append(self.type_(nested=True))
            self.need(")")
            if len(parts) < 2 or nested:
                self.fail("a union of two simple types or more")
            return ("union", (NULL, *parts) if self.take("?") else tuple(parts))
        name = self.word()
        if name == "FrozenArray":
            if nested:
                self.fail("a simple type")
            self.need("<")
            t = ("array", self.type_())
            self.need(">")
            return optional(t) if self.take("?") else t
        if name == "unsigned":
            name = f"unsigned {self.word()}"
        if name in ("long", "unsigned long"):
            t = ("prim", "uint" if name[0] == "u" else "int")
        elif name in _SIMPLE:
            t = ("prim", _SIMPLE[name])
        elif name[:1].isupper():
            t = ("named", name)
        else:
            self.at -= 1
            self.fail("a type that begins with a capital")
        missing = self.take("?")
        return optional(t) if missing and not (self.compat and t[0] == "prim") else t

    def typedef(self, attributes: dict) -> Typedef | None:
        t, name = self.type_(), self.word()
        self.need(";")
        if name == "string":
            if t != ("prim", "str"):
                raise SchemaError("string must be a typedef of DOMString")
            return None
        if "IdentifierType" in attributes:
            if t != ("prim", "str"):
                raise SchemaError(f"{name} must be a typedef of string")
            t = ("ident", attributes["IdentifierType"] or name)
        return Typedef(name, t)

    def enum(self, _attributes: dict) -> Enum:
        name, texts = self.word(), []
        self.need("{")
        while not self.take("}"):
            kind, text, _ = self.tokens[self.at]
            if kind != "text":
                self.fail("a quoted value")
            self.at += 1
            texts.append(text[1:-1])
            self.take(",")
        self.need(";")
        variants = tuple(map(self.symbols, texts))
        for v in variants:
            if not _SLUG.fullmatch(v):
                raise SchemaError(f"{v!r} can't name a variant of {name}")
        return Enum(name, variants, tuple(texts))

    def interface(self, _attributes: dict) -> Iface | None:
        name = self.word()
        parent = self.word() if self.take(":") else None
        self.need("{")
        fields = []
        while not self.take("}"):
            marks = self.attributes()
            self.take("readonly")
            self.need("attribute")
            t, own = self.type_(), self.word()
            self.need(";")
            if own in [f[0] for f in fields]:
                raise SchemaError(f"{name}.{own} is declared twice")
            fields.append((own, t, "Lazy" in marks))
        self.need(";")
        return None if name == "Node" else Iface(name, tuple(fields), parent == "Node")

    def declarations(self):
        while self.tokens[self.at][0] != "end":
            attributes = self.attributes()
            kind = self.take("typedef", "enum", "interface")
            if not kind:
                self.fail("a typedef, an enum or an interface")
            declared = {"typedef": self.typedef, "enum": self.enum, "interface": self.interface}[kind](attributes)
            if declared is not None:
                yield declared


def compile_idl(text: str, symbols: Callable[[str], str] = symbol_name, compat: bool = False) -> Schema:
    """The schema that ``text`` declares. ``symbols`` names the variants of enums. ``compat`` drops the ``?`` of boolean,
    double and string, as some compiled schemas have it."""
    return Schema(_Reader(text, symbols, compat).declarations())
