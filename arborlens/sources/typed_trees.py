"""Typed trees as rows of locations, in pre-order, by Arrow batches.

A document becomes records of a schema; a walk meets every location once, fields in the order of their declaration.
A row holds its key, the declared type (``bound``) with the symbol of the type that is there, the value's symbol, and the
path that ``operators.contexts`` reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.schema.types import NULL, Name, Record, Schema, SchemaError, Variant, brief, pretty

#: Calls that reading one document may nest.
DEEPEST = 20_000
PATH = "array<struct<key:string,idx:int,n:int,iface:string,is_node:boolean>>"
#: Columns of a location; ``last_seq`` is the last location below it, so a walk ends it after that one.
COLUMNS = {
    "seq": "int", "parent_seq": "int", "depth": "int", "last_seq": "int", "key_name": "string", "key_index": "int", "sibling_count": "int",
    "bound": "string", "type_kind": "string", "type_name": "string", "type_index": "int", "type_set_size": "int", "is_node": "boolean",
    "value_tag": "string", "value_index": "int", "value_name": "string", "value_alphabet_size": "int",
    "str_kind": "string", "str_value": "string", "num_value": "double", "text": "string", "path": PATH, "error": "string",
}


def read_json(schema: Schema, value, bound: tuple):
    """A parsed JSON value as a value of ``bound``. A text is a variant of an enum, a name or a string, whichever the bound
    has; an object is the only interface of the bound or the one that its key ``type`` names. Keys that the interface
    lacks are left out; a missing key is null."""
    members = schema.type_set(bound)
    of = lambda kind: [what for k, what in members if k == kind]
    if isinstance(value, dict):
        names = of("iface")
        name = names[0] if len(names) == 1 else value.get("type")
        if name not in names:
            raise SchemaError(f"{pretty(bound)} has no interface {name!r}")
        return Record(name, {field: read_json(schema, value.get(field), t) for field, t, _ in schema.iface(name).fields})
    if isinstance(value, list):
        for item in of("array"):
            made = None
            try:
                made = [read_json(schema, x, item) for x in value]
            except SchemaError:
                if len(of("array")) == 1:
                    raise
            if made is not None:
                return made
        raise SchemaError(f"{pretty(bound)} has no such array")
    if isinstance(value, str):
        for name in of("enum"):
            e = schema.enum(name)
            if value in e.texts or value in e.variants:
                return Variant(name, e.variants[e.texts.index(value)] if value in e.texts else value)
        if of("ident"):
            return Name(value)
    return value


def _valid(text: str) -> str:
    """A text that UTF-8 can hold: halves of surrogate pairs that stand alone become escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _text(value) -> str | None:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return None if isinstance(value, (Record, list, tuple)) else _valid(str(value))


def walk(schema: Schema, root: Record) -> list[tuple]:
    """The locations below and at ``root`` (columns as in COLUMNS without ``error``). Iterative: trees may nest deeply."""
    rows: list[list] = []
    stack = [("$Root", None, None, ("iface", root.iface), root, None, 0, ())]
    while stack:
        key, index, n, bound, value, parent, depth, above = stack.pop()
        symbol, (kind, what) = schema.resolve(value, bound)
        iface = schema.iface(what) if kind == "iface" else None
        node = iface is not None and iface.is_node
        path = (*above, (key, index, n, what if iface else None, node))
        tag, at, alphabet = schema.value_symbol(value, (kind, what)) or (None, None, ())
        seq = len(rows)
        strings = (what, _valid(value)) if kind == "ident" else ("raw", _valid(value)) if (kind, what) == ("prim", "str") else (None, None)
        number = float(value) if kind == "prim" and what in ("uint", "int", "f64") else None
        rows.append([seq, parent, depth, seq, key, index, n, pretty(bound), kind, pretty((kind, what)), symbol, len(schema.type_set(bound)), node, tag, at, alphabet[at] if tag else None, len(alphabet) if tag else None, *strings, number, _text(value), path])
        if iface is not None:
            missing = [f for f, _, _ in iface.fields if f not in value.fields]
            if missing:
                raise SchemaError(f"{brief(value)} lacks {', '.join(missing)}")
            stack += [(f, None, None, t, value.fields[f], seq, depth + 1, path) for f, t, _ in reversed(iface.fields)]
        elif kind == "array":
            stack += [(None, i, len(value), what, value[i], seq, depth + 1, path) for i in range(len(value) - 1, -1, -1)]
    for row in reversed(rows):
        if row[1] is not None:
            above = rows[row[1]]
            above[3] = max(above[3], row[3])
    return [tuple(r) for r in rows]


def typed_nodes(df: DataFrame, schema: Schema, root: str, *, id_col: str, text_col: str, read: Callable[[str], Record] | None = None, errors: str = "raise") -> DataFrame:
    """(id, locations) of documents that hold values of the interface ``root``; without ``read`` they are JSON.

    Null texts have no location. A document that doesn't fit its schema ends the job, or with ``errors="report"``
    has one row with nothing but ``error`` and an empty path.
    """
    if errors not in ("raise", "report"):
        raise ValueError("errors must be raise or report")
    src = df.select(F.col(id_col), F.col(text_col).cast("string"))

    def read_text(text):
        return read(text) if read else read_json(schema, json.loads(text), ("iface", root))

    def run(batches):
        import sys

        import pyarrow as pa

        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        step = pa.struct([("key", pa.string()), ("idx", pa.int32()), ("n", pa.int32()), ("iface", pa.string()), ("is_node", pa.bool_())])
        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), PATH: pa.list_(step)}
        names = [id_col, *COLUMNS]

        def table(ids, rows, kind):
            columns = list(zip(*rows, strict=True))
            paths = columns.pop(list(COLUMNS).index("path"))
            steps = list(zip(*(s for p in paths for s in p or ()), strict=True)) or [()] * len(step)
            ends = list(accumulate((len(p or ()) for p in paths), initial=0))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(steps, step, strict=True)], fields=list(step)))
            arrays = [pa.array(c, kinds[k]) for c, k in zip(columns, (k for k in COLUMNS.values() if k != PATH), strict=True)]
            arrays.insert(list(COLUMNS).index("path"), held)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *arrays], names=names)

        for batch in batches:
            ids, rows, kind = [], [], batch.schema.types[0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                try:
                    found = [(*r, None) for r in walk(schema, read_text(text))]
                except (ValueError, KeyError, TypeError, RecursionError) as e:
                    if errors == "raise":
                        raise SchemaError(f"document {i}: {e}") from e
                    found = [(*(None for _ in range(len(COLUMNS) - 1)), f"{type(e).__name__}: {e}"[:500])]
                ids += [i] * len(found)
                rows += found
                if len(rows) >= 20_000:
                    yield table(ids, rows, kind)
                    ids, rows = [], []
            if rows:
                yield table(ids, rows, kind)

    columns = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, {columns}")


def nullable(bound: tuple, schema: Schema) -> bool:
    return NULL in schema.type_set(bound)
