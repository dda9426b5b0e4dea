"""Types of tree schemas: declarations, flattened type sets with their total order, and the resolution of values.

A type is a tuple: ("prim", name), ("ident", tag), ("array", item), ("iface", name), ("enum", name), and, until it is
flattened, ("named", name) or ("union", (types...)). Tuples compare by value, so equal types are one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, cached_property

#: Primitive types in the order of their symbols.
PRIMITIVES = ("null", "bool", "uint", "int", "f64", "str")
_RANK = {"prim": 0, "ident": 1, "array": 2, "iface": 3, "enum": 4}
NULL = ("prim", "null")


class Name(str):
    """A string that names something: an identifier or a property."""

    __slots__ = ()


@dataclass(frozen=True)
class Variant:
    """A value of an enum."""

    enum: str
    name: str

    def __str__(self) -> str:
        return f"{self.enum}_{self.name}"


@dataclass
class Record:
    """A value of an interface, with its fields by name."""

    iface: str
    fields: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Iface:
    name: str
    fields: tuple[tuple[str, tuple, bool], ...]  # name, type, lazy
    is_node: bool


@dataclass(frozen=True)
class Enum:
    name: str
    variants: tuple[str, ...]
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Typedef:
    name: str
    target: tuple


class SchemaError(ValueError):
    """A schema that contradicts itself, or a value that doesn't fit one."""


def optional(t: tuple) -> tuple:
    return ("union", (NULL, t))


@cache
def pretty(t: tuple) -> str:
    kind, what = t
    if kind == "union":
        return f"Union<{' | '.join(map(pretty, what))}>"
    if kind == "array":
        return f"Array<{pretty(what)}>"
    return {"prim": what, "named": what, "ident": f"id({what})", "iface": f"Iface<{what}>", "enum": f"Enum<{what}>"}[kind]


def order_key(t: tuple):
    """The total order of terminal types: primitives by rank, identifiers, arrays by item, interfaces and enums by name."""
    kind, what = t
    return _RANK[kind], PRIMITIVES.index(what) if kind == "prim" else 0, "" if kind == "prim" else pretty(what) if kind == "array" else what


class Schema:
    """Declarations by name, in the order they were given."""

    def __init__(self, declarations):
        self.declarations: dict[str, Iface | Enum | Typedef] = {}
        for d in declarations:
            if d.name in self.declarations:
                raise SchemaError(f"{d.name} is declared twice")
            self.declarations[d.name] = d
        self._sets: dict[tuple, tuple[tuple, ...]] = {}
        for d in self.declarations.values():
            for t in [d.target] if isinstance(d, Typedef) else [t for _, t, _ in d.fields] if isinstance(d, Iface) else []:
                self.type_set(t)  # every name must be declared, and no alias may hold itself

    def __getstate__(self):
        return list(self.declarations.values())

    def __setstate__(self, declarations):
        self.__init__(declarations)

    def __getitem__(self, name: str):
        try:
            return self.declarations[name]
        except KeyError:
            raise SchemaError(f"{name} is not declared") from None

    def iface(self, name: str) -> Iface:
        d = self[name]
        if not isinstance(d, Iface):
            raise SchemaError(f"{name} is no interface")
        return d

    def enum(self, name: str) -> Enum:
        d = self[name]
        if not isinstance(d, Enum):
            raise SchemaError(f"{name} is no enum")
        return d

    def _terminals(self, t: tuple, above: tuple = ()):
        kind, what = t
        if kind == "union":
            for x in what:
                yield from self._terminals(x, above)
        elif kind == "named":
            d = self[what]
            if isinstance(d, Typedef):
                if what in above:
                    raise SchemaError(f"{what} is an alias of itself")
                yield from self._terminals(d.target, (*above, what))
            else:
                yield ("iface" if isinstance(d, Iface) else "enum", what)
        else:
            yield t

    def type_set(self, t: tuple) -> tuple[tuple, ...]:
        """The distinct terminal types that ``t`` stands for, in their order; the position is the type's symbol."""
        if t not in self._sets:
            self._sets[t] = tuple(sorted(set(self._terminals(t)), key=order_key))
        return self._sets[t]

    def fits(self, value, t: tuple) -> bool:
        kind, what = t
        if kind in ("named", "union"):
            return any(self.fits(value, x) for x in self.type_set(t))
        if kind == "iface":
            return isinstance(value, Record) and value.iface == what
        if kind == "enum":
            return isinstance(value, Variant) and value.enum == what and value.name in self.enum(what).variants
        if kind == "ident":
            return isinstance(value, Name)
        if kind == "array":
            return isinstance(value, (list, tuple)) and all(self.fits(x, what) for x in value)
        if what == "null":
            return value is None
        if what == "bool":
            return isinstance(value, bool)
        if what == "str":
            return isinstance(value, str) and not isinstance(value, Name)
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            return False
        return what == "f64" or (value == value // 1 and (what == "int" or value >= 0))

    def resolve(self, value, bound: tuple) -> tuple[int, tuple]:
        """(symbol, type) of the one member of the bound's type set that the value fits. None and several are errors: an
        empty array fits any two array types, a whole number fits uint and int."""
        found = [(i, t) for i, t in enumerate(self.type_set(bound)) if self.fits_shallow(value, t)]
        if len(found) > 1:
            found = [(i, t) for i, t in found if self.fits(value, t)]
        if len(found) != 1:
            raise SchemaError(f"{len(found)} types of {pretty(bound)} fit {brief(value)}")
        return found[0]

    def fits_shallow(self, value, t: tuple) -> bool:
        """``fits`` without the items of arrays, which a walk meets one by one."""
        return isinstance(value, (list, tuple)) if t[0] == "array" else self.fits(value, t)

    def value_symbol(self, value, t: tuple) -> tuple[str, int, tuple[str, ...]] | None:
        """(tag, index, alphabet) of the values that are predicted; nulls, floats, strings, names and records aren't."""
        kind, what = t
        if kind == "array":
            return "arrayLength", min(len(value), 16), LENGTHS
        if kind == "enum":
            return what, self.enum(what).variants.index(value.name), self.enum(what).variants
        if kind == "prim" and what == "bool":
            return "bool", int(value), ("false", "true")
        if kind == "prim" and what == "uint":
            return "uint", min(int(value), 8), UINTS
        if kind == "prim" and what == "int":
            return "int", int(value) + 1 if -1 <= value <= 6 else 8, INTS
        return None

    @cached_property
    def alphabets(self) -> dict[str, tuple[str, ...]]:
        """Symbols by alphabet: of the type sets of all bounds (by their pretty form), and of the value tags."""
        out = {"bool": ("false", "true"), "uint": UINTS, "int": INTS, "arrayLength": LENGTHS}
        bounds = []
        for d in self.declarations.values():
            if isinstance(d, Enum):
                out[d.name] = d.variants
            else:
                bounds += [d.target] if isinstance(d, Typedef) else [t for _, t, _ in d.fields]
        while bounds:
            t = bounds.pop()
            if (key := f"type {pretty(t)}") not in out:
                out[key] = tuple(pretty(x) for x in self.type_set(t))
                bounds += [x[1] for x in self.type_set(t) if x[0] == "array"]
        return out

    def describe(self) -> str:
        """The schema as text."""
        lines = []
        for d in self.declarations.values():
            if isinstance(d, Typedef):
                lines.append(f"typedef {d.name} = {pretty(d.target)}")
            elif isinstance(d, Enum):
                lines += [f"enum {d.name} {{", *(f"    {v} {t!r}" for v, t in zip(d.variants, d.texts, strict=True)), "}"]
            else:
                lines += [f"{'node' if d.is_node else 'iface'} {d.name} {{", *(f"    {'lazy ' if lazy else ''}{n}: {pretty(t)}" for n, t, lazy in d.fields), "}"]
        return "\n".join(lines) + "\n"


#: The alphabets of small numbers and lengths.
UINTS = (*map(str, range(8)), "MISS")
INTS = (*map(str, range(-1, 7)), "MISS")
LENGTHS = (*map(str, range(16)), "MISS")


def brief(value) -> str:
    if isinstance(value, Record):
        return f"a record {value.iface}"
    if isinstance(value, (list, tuple)):
        return f"an array of {len(value)}"
    return repr(value)[:60]
