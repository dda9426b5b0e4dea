"""Nested documents as rows of tree locations, in pre-order, by Arrow batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_walk(value):
    """(depth, parent, key, index, siblings, type, text) of every location of a parsed JSON value, keys in name order."""
    out, stack = [], [(0, None, "$Root", None, None, value)]
    while stack:
        depth, parent, key, index, n, v = stack.pop()
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        seq = len(out)
        out.append((depth, parent, key, index, n, kind, None if kind in ("array", "object", "null") else v if kind == "string" else json.dumps(v)))
        if kind == "object":
            stack += [(depth + 1, seq, k, None, None, v[k]) for k in sorted(v, reverse=True)]
        elif kind == "array":
            stack += [(depth + 1, seq, None, i, len(v), v[i]) for i in range(len(v) - 1, -1, -1)]
    return out


def html_walk(page: str):
    """(depth, parent, key, index, siblings, type, text) of elements as a tolerant event parser meets them."""
    from html.parser import HTMLParser

    void = frozenset("area base br col embed hr img input link meta source track wbr".split())  # fixed values of HTML
    out: list = []
    open_: list[tuple[int, str]] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            out.append((len(open_), open_[-1][0] if open_ else None, tag, None, None, tag, None))
            if tag not in void:
                open_.append((len(out) - 1, tag))

        def handle_endtag(self, tag):
            if any(t == tag for _, t in open_):
                while open_.pop()[1] != tag:
                    pass

        def handle_data(self, data):
            if data.strip():
                out.append((len(open_), open_[-1][0] if open_ else None, "#text", None, None, "#text", data))

    r = Reader()
    r.feed(page)
    r.close()
    return out


def _nodes(df: DataFrame, id_col: str, text_col: str, walk) -> DataFrame:
    src = df.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [id_col, "seq", "depth", "parent_seq", "key_name", "key_index", "sibling_count", "type_name", "value"]
        for batch in batches:
            ids, rows = [], []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if t is None:
                    continue
                found = walk(t)
                ids += [i.as_py()] * len(found)
                rows += [(seq, d, p, k, x, n, kind, v) for seq, (d, p, k, x, n, kind, v) in enumerate(found)]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)
                    ids, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = dict(src.dtypes)[id_col]
    return src.mapInArrow(run, f"{id_col} {kind}, seq int, depth int, parent_seq int, key_name string, key_index int, sibling_count int, type_name string, value string")


def json_nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Locations of JSON documents. A text that isn't JSON, or nests too deeply to be read, is one string."""

    def walk(text):
        try:
            return json_walk(json.loads(text))
        except (ValueError, RecursionError):
            return json_walk(text)

    return _nodes(df, id_col, text_col, walk)


def html_nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _nodes(df, id_col, text_col, html_walk)
