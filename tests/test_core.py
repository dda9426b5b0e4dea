import random

import pytest

from arborlens.functions import symbols as S
from arborlens.functions.text_codes import code_points, wtf8
from arborlens.operators.contexts import with_suffixes
from arborlens.operators.range_coder import Reader, Writer
from arborlens.operators.recency import distances
from arborlens.sources.trees import json_nodes, json_walk


def test_range_coder_golden():
    e = Writer(0)
    for step in ((88026, 0, 262142), (88202, 88026, 262142), (85914, 176228, 262142), (88026, 0, 262142)):
        e.code(*step)
    e.bits(0x41, 8)
    assert e.finish().hex(" ") == "00 31 19 00 00 07"


@pytest.mark.parametrize("seed", range(40))
def test_range_coder_round_trip(seed):
    r = random.Random(seed)
    total = r.choice([3, 256, 262142, 262144])
    steps = []
    for _ in range(r.randint(0, 500)):
        offset = r.randrange(total)
        steps.append((r.randint(1, total - offset), offset, total))
    e = Writer()
    for s in steps:
        e.code(*s)
    d = Reader(e.finish())
    for size, offset, t in steps:
        assert offset <= d.find(t) < offset + size
        d.accept(size, offset, t)


@pytest.mark.parametrize("limit", [1, 2, 3, 8])
def test_distance_identity(limit):
    r = random.Random(limit)
    seq = [r.choice("abcdefgh") for _ in range(500)]
    for i, got in enumerate(distances(seq, limit)):
        before = [j for j in range(i) if seq[j] == seq[i]]
        apart = len(set(seq[before[-1] + 1 : i])) if before else limit
        assert got == (apart if apart < limit else -1)


def test_suffixes(spark):
    step = "struct<key:string,idx:int,n:int,iface:string,is_node:boolean>"
    script, scope = ("$Root", None, None, "Script", True), ("scope", None, None, "AssertedScriptGlobalScope", False)
    paths = {
        1: [script, ("statements", None, None, None, False), (None, 0, 1, "ExpressionStatement", True)],
        2: [script, scope, ("declaredNames", None, None, None, False), (None, 0, 1, "AssertedDeclaredName", False), ("kind", None, None, None, False)],
        3: [script, ("statements", None, None, None, False), (None, 7, 9, "ExpressionStatement", True), ("expression", None, None, "X", True)],
        4: [script],
        5: [script, ("statements", None, None, None, False), (None, 7, 9, "ExpressionStatement", True)],
    }
    df = spark.createDataFrame(list(paths.items()), f"seq int, path array<{step}>")
    got = {(r.seq, r.suffix_len): r.suffix for r in with_suffixes(df, 3).collect()}
    assert got == {
        (1, 1): "Script.statements.0-of-1",
        (2, 1): "Script.scope=AssertedScriptGlobalScope.declaredNames.*=AssertedDeclaredName.kind",
        (3, 1): "ExpressionStatement.expression",
        (3, 2): "Script.statements.*/ExpressionStatement.expression",
        (5, 1): "Script.statements.*",
    }


def test_symbols(spark):
    row = spark.range(1).select(*(S.varuint_bits(S.F.lit(v)) for v in (127, 128, 16384, 1 << 17, 1 << 21)), S.varuint_bits(S.F.lit(1 << 17), True)).first()
    assert list(row) == [8, 16, 24, 24, 32, 28]
    assert [S.F.lit(0) is not None, spark.range(1).select(S.utf16_length(S.F.lit("a😀"))).first()[0]] == [True, 3]


def test_codes():
    assert code_points([0xD83D, 0xDE00, 0xD800, 0x61]) == [0x1F600, 0xD800, 0x61]
    assert wtf8([0xE9, 0xD800]) == b"\xc3\xa9\xed\xa0\x80"
    assert code_points([0xD83D, 0xDE00], compat=True) == [0x10000 + (0x3D << 10)] and wtf8([0xE9, 0x1F600], compat=True) == b"\xe9\xf0\x9f\x98\x80"


def test_json_walk():
    assert [(d, k, i, t, v) for d, _, k, i, _, t, v in json_walk({"b": [1, None], "a": "x"})] == [(0, "$Root", None, "object", None), (1, "a", None, "string", "x"), (1, "b", None, "array", None), (2, None, 0, "number", "1"), (2, None, 1, "null", None)]


def test_json_nodes(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "no"), (3, "[" * 200_000), (4, None)], "id long, t string")
    got = sorted((r.id, r.type_name) for r in json_nodes(df, "id", "t").collect())
    assert got == [(1, "object"), (2, "string"), (3, "string")]
