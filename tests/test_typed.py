"""Schemas, lifted scripts, typed trees, the analyses over them, stores and the command line."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from arborlens import cli
from arborlens.operators import coding, recency, scopes
from arborlens.operators.ordering import global_index
from arborlens.operators.range_coder import Reader, Writer
from arborlens.plans import analyses
from arborlens.schema import views
from arborlens.schema.idl import compile_idl, symbol_name
from arborlens.schema.types import Name, Record, SchemaError, Variant
from arborlens.sources import sinks, store
from arborlens.sources.es5 import parse_script, string_value
from arborlens.sources.syntax import Lifter, lift_script
from arborlens.sources.tables import table_schema
from arborlens.sources.typed_trees import typed_nodes, walk
from tests import scripts as P

SCHEMA = compile_idl(P.IDL)


def nodes_of(spark, *trees):
    df = spark.createDataFrame([(f"s{i}.js", len(json.dumps(t)), json.dumps(t)) for i, t in enumerate(trees)], "subpath string, size long, text string")
    return df, typed_nodes(df, SCHEMA, "Script", id_col="subpath", text_col="text", read=lambda t: lift_script(SCHEMA, t))


def test_type_sets():
    sets = {n: [t[1] for t in SCHEMA.type_set(("named", n))] for n in ("Expression", "Statement", "Binding", "AssignmentTarget")}
    assert [len(s) for s in sets.values()] == [30, 24, 3, 5]
    assert sets["Expression"].index("IdentifierExpression") == 11 and sets["Statement"].index("ExpressionStatement") == 8
    assert SCHEMA.type_set(("union", (("named", "Binding"), ("prim", "str"), ("prim", "null"), ("ident", "b"), ("array", ("prim", "int")), ("ident", "a"))))[:5] == (("prim", "null"), ("prim", "str"), ("ident", "a"), ("ident", "b"), ("array", ("prim", "int")))


def test_idl():
    text = """typedef DOMString string; enum E { "+=", "a b", "in" }; interface Node {};
    interface N : Node { [Lazy] attribute boolean? b; attribute FrozenArray<(E or N)?>? many; attribute unsigned long n; };"""
    schema = compile_idl(text)
    assert schema.enum("E").variants == ("PlusAssign", "AB", "KwIn")
    assert schema.iface("N").is_node and [f[2] for f in schema.iface("N").fields] == [True, False, False]
    assert [len(schema.type_set(t)) for _, t, _ in schema.iface("N").fields] == [2, 2, 1]
    assert len(compile_idl(text, compat=True).type_set(compile_idl(text, compat=True).iface("N").fields[0][1])) == 1
    assert "    many: Union<null | Array<Union<null | E | N>>>" in schema.describe()
    for bad in ("interface A : Node { attribute b c; };", 'enum E { "§" };', "typedef B A; typedef A B;", "typedef (A) B;", "interface A {}; interface A {};", "typedef Missing A;", "interface A { attribute E x }"):
        with pytest.raises(SchemaError):
            compile_idl(bad)
    assert symbol_name(">>>=") == "ArshAssign" and symbol_name("non-const lexical") == "NonConstLexical"


def test_resolve():
    two = ("union", (("array", ("prim", "int")), ("array", ("prim", "str"))))
    assert SCHEMA.resolve([1], two)[0] == 0 and SCHEMA.resolve(["a"], two)[0] == 1
    for value, bound in (([], two), (1, ("union", (("prim", "uint"), ("prim", "int")))), ("x", ("prim", "f64")), (True, ("prim", "f64")), (Record("Block"), ("named", "Expression"))):
        with pytest.raises(SchemaError):
            SCHEMA.resolve(value, bound)
    assert SCHEMA.fits(Name("a"), ("ident", "any")) and not SCHEMA.fits("a", ("ident", "ident")) and not SCHEMA.fits(Name("a"), ("prim", "str"))
    symbols = [SCHEMA.value_symbol(v, t)[:2] for v, t in ((False, ("prim", "bool")), (9, ("prim", "uint")), (-1, ("prim", "int")), (7, ("prim", "int")), ([0] * 20, ("array", ("prim", "int"))), (Variant("BinaryOperator", "Plus"), ("enum", "BinaryOperator")))]
    assert symbols == [("bool", 0), ("uint", 8), ("int", 0), ("int", 8), ("arrayLength", 16), ("BinaryOperator", 19)]


def test_golden_first(spark):
    _, nodes = nodes_of(spark, P.FIRST)
    freq = analyses.path_suffix(nodes, SCHEMA, 2).where("scope = 'ALL'")
    rows = freq.where("hits > 0").collect()
    assert {r.total_symbols for r in rows} == {9}
    tables = [(r.suffix, r.totalHits, len(r.freqs)) for r in analyses.suffix_tables(freq).orderBy("place").collect()]
    assert tables[0] == ("Script.statements.*/ExpressionStatement.expression#type", 1, 30)
    assert sorted(tables) == sorted([
        ("Script.statements.*/ExpressionStatement.expression#type", 1, 30), ("Script.scope=AssertedScriptGlobalScope.declaredNames#arrayLength", 1, 17),
        ("Script.scope=AssertedScriptGlobalScope.hasDirectEval#bool", 1, 2), ("Script.directives#arrayLength", 1, 17), ("Script.statements#arrayLength", 1, 17),
        ("Script.statements.0-of-1#type", 1, 24), ("ExpressionStatement.expression#type", 1, 30),
    ])
    assert {(r.suffix, r.tag): (r.sym_name, r.sym_index) for r in rows}["Script.statements.0-of-1", "type"] == ("Iface<ExpressionStatement>", 8)


def test_golden_second(spark):
    _, nodes = nodes_of(spark, P.SECOND)
    rows = analyses.path_suffix(nodes, SCHEMA, 1).where("scope = 'doc'").collect()
    hit = {f"{r.suffix}#{r.tag}": (r.sym_name, r.sym_index) for r in rows if r.hits}
    sizes = {}
    for r in rows:
        sizes[f"{r.suffix}#{r.tag}"] = sizes.get(f"{r.suffix}#{r.tag}", 0) + 1
    assert {r.total_symbols for r in rows} == {30} and len(hit) == 19 and {r.scope for r in rows} == {"doc"}
    want = {
        "Script.scope=AssertedScriptGlobalScope.declaredNames.*=AssertedDeclaredName.kind#AssertedDeclaredKind": ("KwVar", 0, 3),
        "Script.statements.0-of-2#type": ("Iface<VariableDeclaration>", 21, 24), "VariableDeclarator.binding#type": ("Iface<BindingIdentifier>", 1, 3),
        "VariableDeclarator.init#type": ("Iface<LiteralNumericExpression>", 18, 31), "AssignmentExpression.binding#type": ("Iface<AssignmentTargetIdentifier>", 1, 5),
        "BinaryExpression.operator#BinaryOperator": ("Plus", 19, 25), "BinaryExpression.right#type": ("Iface<StaticMemberExpression>", 23, 30), "StaticMemberExpression.object#type": ("Iface<IdentifierExpression>", 11, 31),
    }
    assert {k: (*hit[k], sizes[k]) for k in want} == want
    refs = [(r.str_kind, r.str_value) for r in analyses.string_refs(nodes).orderBy("seq").collect()]
    assert refs == [("ident", "x")] * 5 + [("prop", "y")]
    counts = [(r.scope, r.str, r.idx, r.ident_count, r.prop_count, r.raw_count, r.total_count) for r in analyses.global_strings(nodes).orderBy("scope", "idx").collect()]
    assert counts == [(s, *r) for s in ("ALL", "doc") for r in (("x", 0, 5, 0, 0, 5), ("y", 1, 0, 1, 0, 1))]
    for compat, want in ((False, (4, 1, 4, 5)), (True, (5, 2, 5, 7))):
        w = {r["index"]: r["count"] for r in analyses.string_window(nodes, [64], compat=compat).where("scope = 'ALL' and str_kind = 'ident'").collect()}
        assert (w["0"], w["MISSES"], w["HITS"], w["TOTAL"]) == want and len(w) == 67


def test_scopes():
    body = P.function("FunctionExpression", "me", ["a"], P.run(P.ident("a")), P.run(P.function("FunctionExpression", None, [], P.run(P.ident("a")), P.run(P.ident("v")), P.run(P.ident("me")))))
    tree = P.script(P.declare("var", "v", body), P.declare("let", "w"), P.block(P.declare("const", "c"), P.declare("var", "d")), P.function("FunctionDeclaration", "f", ["p"], P.run(P.ident("p")), P.run(P.ident("w"))), directives=["use strict"])
    r = lift_script(SCHEMA, tree)
    names = lambda scope: [(str(n.fields["name"]), getattr(n.fields.get("kind"), "name", None), n.fields["isCaptured"]) for n in scope.fields.get("declaredNames") or scope.fields.get("boundNames")]
    # The inner use of v comes before its declaration, so it stays free.
    assert names(r.fields["scope"]) == [("v", "KwVar", False), ("w", "NonConstLexical", True), ("d", "KwVar", False), ("f", "KwVar", False)]
    made = r.fields["statements"][0].fields["declarators"][0].fields["init"].fields["contents"]
    assert made.fields["isFunctionNameCaptured"] is True and names(made.fields["parameterScope"]) == [("a", None, True)]
    assert names(r.fields["statements"][2].fields["scope"]) == [("c", "ConstLexical", False)]
    assert names(r.fields["statements"][3].fields["contents"].fields["parameterScope"]) == [("p", None, False)]
    old = lift_script(SCHEMA, tree, compat=True)
    assert names(old.fields["scope"])[:3] == [("v", "KwVar", False), ("w", "KwVar", True), ("c", "KwVar", False)]
    assert names(old.fields["statements"][0].fields["declarators"][0].fields["init"].fields["contents"].fields["parameterScope"]) == [("me", None, False), ("a", None, False)]
    assert len(walk(SCHEMA, r)) == 147 and len(walk(SCHEMA, old)) == 149
    twice = P.script(P.declare("let", "x"), P.declare("let", "x"))
    with pytest.raises(SchemaError):
        lift_script(SCHEMA, twice)
    assert len(lift_script(SCHEMA, twice, compat=True).fields["scope"].fields["declaredNames"]) == 2
    case = lambda n: {"type": "SwitchCase", "test": P.number(n), "consequent": []}
    switch = P.script({"type": "SwitchStatementWithDefault", "discriminant": P.number(0), "preDefaultCases": [case(1)], "defaultCase": {"type": "SwitchDefault", "consequent": []}, "postDefaultCases": [case(2), case(3)]})
    regexp = P.script(P.run({"type": "LiteralRegExpExpression", "pattern": "a", "global": True, "ignoreCase": True, "multiLine": False, "unicode": False, "sticky": False}))
    for compat, cases, flags in ((False, 2, "gi"), (True, 1, "g,i")):
        assert len(lift_script(SCHEMA, switch, compat).fields["statements"][0].fields["postDefaultCases"]) == cases
        assert lift_script(SCHEMA, regexp, compat).fields["statements"][0].fields["expression"].fields["flags"] == flags
    lifter = Lifter(SCHEMA)
    lifter.script(tree)
    assert lifter.names.most_common(1)[0] == ("a", 3) and lifter.strings["use strict"] == 1
    for bad in ({"type": "Module"}, P.script({"type": "Nothing"}), P.script(P.run({"type": "UnaryExpression", "operator": "?", "operand": P.ident("x")}))):
        with pytest.raises((SchemaError, KeyError)):
            lift_script(SCHEMA, bad)


def test_catch_binds():
    tree = P.script({"type": "TryCatchStatement", "body": {"type": "Block", "statements": []}, "catchClause": {"type": "CatchClause", "binding": P.bound("e"), "body": {"type": "Block", "statements": [P.run(P.ident("e"))]}}})
    clause = lift_script(SCHEMA, tree).fields["statements"][0].fields["catchClause"]
    assert [str(n.fields["name"]) for n in clause.fields["bindingScope"].fields["boundNames"]] == ["e"]
    walk(SCHEMA, lift_script(SCHEMA, tree))


def test_pretty_print(spark):
    _, nodes = nodes_of(spark, P.FIRST)
    text = analyses.pretty_print(nodes).first()["text"]
    assert text.startswith("$Root: Iface<Script> = {\n    @ iface(Script)\n\n    scope: AssertedScriptGlobalScope = {\n        @ iface(AssertedScriptGlobalScope)\n    \n        declaredNames: Array<AssertedDeclaredName> = {\n            @ Array<AssertedDeclaredName>\n        \n        }\n")
    assert "            expression: Expression = {\n                @ iface(IdentifierExpression)\n            \n                name: Identifier = {\n                    @ id(ident)\n                \n                    value = x\n                }\n            }\n" in text
    assert text.endswith("        }\n    }\n}\n") and text.count("{\n") == text.count("}\n") == 9


def test_nodes_report_errors(spark):
    df = spark.createDataFrame([(1, '{"type": "click"}'), (2, '{"type": "nothing"}'), (3, "no json"), (4, None)], "id long, t string")
    got = typed_nodes(df, table_schema(), "Event", id_col="id", text_col="t", errors="report").groupBy("id").agg(F.count("seq").alias("n"), F.max("error").alias("e")).collect()
    assert {r.id: r.n for r in got} == {1: 4, 2: 0, 3: 0} and all(bool(r.e) == (r.id > 1) for r in got)


def test_views(spark):
    schema = table_schema()
    assert views.struct_type(schema, "History").simpleString() == "struct<events:array<struct<type:string,value:double,props:string>>>"
    assert views.struct_type(schema, "Turn")["role"].metadata == {"lazy": False, "ident": "ident"} and views.struct_type(schema, "Turn")["role"].nullable
    with pytest.raises(SchemaError):
        views.struct_type(SCHEMA, "Block")
    assert views.declarations(spark, schema).count() == len(schema.declarations) and views.variants(spark, schema).count() == 5
    assert views.fields(spark, schema).where("iface = 'Turn'").count() == 2


def test_range_coder_bytes_and_bits():
    out = Writer()
    rnd = random.Random(2)
    steps = [(rnd.randrange(1 << n), n) for n in rnd.choices([1, 8, 16], k=3000)]
    for v, n in steps:
        out.bits(v, n)
    out.raw(b"\xff" * 50)
    data = out.finish()
    back = Reader(data)
    assert [(back.bits(n), n) for _, n in steps] == steps and back.raw(50) == b"\xff" * 50
    with pytest.raises(ValueError):
        Writer().code(0, 3, 10)


def test_entropy_code(spark, tmp_path):
    trees = [P.SECOND, P.script(*(P.declare("var", f"n{k % 7}", P.number(k / 3 - 2)) for k in range(40)), *(P.assign(f"n{k % 5}", {"type": "LiteralStringExpression", "value": f"text {k % 3}"}) for k in range(30)))]
    files, nodes = nodes_of(spark, *trees)
    nodes = nodes.persist()
    model = coding.table_model(analyses.path_suffix(nodes, SCHEMA, 2).where("scope = 'ALL'")).unionByName(coding.string_model(analyses.string_window(nodes, [8]).where("scope = 'ALL'"), 8))
    words = spark.createDataFrame([("x", 0), ("n1", 1)], "value string, id long")
    rows = coding.symbol_rows(nodes, "subpath", 8, words)
    costed = coding.costs(rows, model)
    got = costed.where("subpath = 's1.js'").orderBy("seq", "part").collect()
    coded = {r.subpath: r for r in coding.encode(costed, "subpath").collect()}
    back = Reader(bytes(coded["s1.js"].coded))
    for r in got:
        if r["size"] is not None:
            assert r.offset <= back.find(r.total) < r.offset + r["size"]
            back.accept(r["size"], r.offset, r.total)
        if r.raw is not None:
            assert back.raw(len(r.raw)) == bytes(r.raw)
    assert coded["s1.js"].n_symbols == len(got)
    numbers = [struct.unpack(">d", bytes(r.raw))[0] for r in got if r.c2 == "f64"]
    assert numbers == [k / 3 - 2 for k in range(40)]
    labels = {r.label: r for r in coding.rollup(costed, "subpath").where("subpath = 's1.js'").collect()}
    assert math.isclose(labels["sym"].bits, sum(labels[f"sym/{c}"].bits for c in ("type", "value", "string"))) and labels["sym"].symbols == len(got)
    assert {"sym/value/f64", "sym/string/ident", "sym/string/escape", "sym/string/escape/ident", "sym/type/Iface<VariableDeclaration>"} <= set(labels)
    assert math.isclose(labels["sym"].bits, sum(r.bits for r in got))
    refs = [bytes(r.raw) for r in got if r.c2 == "escape"]
    assert bytes([1]) in refs and bytes([0x80, 0x20]) in refs  # the dictionary's second word, and the first own one, 4096
    with pytest.raises(Exception, match="no model for symbol"):
        coding.costs(rows, model.where("model not like '%arrayLength'")).collect()
    unseen = model.withColumns({"size": F.when(F.col("model").like("%#bool"), 0).otherwise(F.col("size")), "total": F.col("total") + 1})
    assert coding.costs(rows, unseen).where("model like '%#bool' and raw is not null").count() > 0
    with pytest.raises(Exception, match="no size for symbol"):
        coding.costs(rows, unseen, compat=True).collect()
    old = coding.symbol_rows(nodes, "subpath", 8, words, compat=True)
    assert old.where("raw is not null and hex(raw) rlike '[^0]'").count() == 0
    # The other script knows x and y already when its own strings come.
    misses = lambda r: r.where("c2 = 'escape' and subpath = 's1.js'").count()
    assert misses(old) <= misses(rows)


def test_double_bytes(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1e300, -1e-300, 5e-324, 2.0**-1022, float("inf"), 1 / 3, 2.0**1023, 1.7976931348623157e308, 0.9999999999999999, 4503599627370497.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", coding._double_bytes(F.col("v")).alias("b")).collect()
    assert {r.v: bytes(r.b) for r in got} == {v: struct.pack(">d", v) for v in values}


def test_store(spark, tmp_path):
    root = str(tmp_path / "out")
    s = store.Store.create(spark, root)
    s.write_json("a/b.json", {"k": [1, "é"]})
    s.write_text("a/c.js", "x\ny")
    s.write_sink_text("d.txt", lambda sink: sink.write("one ", "two\ud800"))
    assert s.subpaths() == ["a/b.json", "a/c.js", "d.txt"] and s.list_all() == ["a", "d.txt"] and s.list_files() == ["d.txt"] and s.list_dirs() == ["a"]
    assert s.read_json("a/b.json") == {"k": [1, "é"]} and s.read_lines("a/c.js") == ["x", "y"] and s.size("a/c.js") == 3
    assert s.read_text("a/b.json") == '{\n  "k": [\n    1,\n    "é"\n  ]\n}' and s.read_bytes("d.txt") == b"one two\xed\xa0\x80"
    assert store.compress(b"a" * 100, "gzip") == s.read_compressed("a/c.js", "gzip")[:0] + store.compress(b"a" * 100, "gzip")
    for bad in ("", "a//b", "../x", "a/./b", "WRITABLE", "a b"):
        with pytest.raises(ValueError):
            s.write_text(bad, "")
    for bad, error in (("a", IsADirectoryError), ("a/c.js/x", NotADirectoryError)):
        with pytest.raises(error):
            s.write_text(bad, "")
    assert [(r.subpath, r["size"]) for r in s.files().collect()] == [("a/c.js", 3)] and s.files(least_size=4).count() == 0
    assert [(r.line_number, r.line) for r in s.lines(".js").collect()] == [(0, "x"), (1, "y")]
    again = store.Store.create(spark, root)
    again.write_table("t", spark.range(3))
    corpus = store.Store.open(spark, root)
    with pytest.raises(PermissionError):
        corpus.write_text("x", "")
    (tmp_path / "other").mkdir()
    with pytest.raises(PermissionError):
        store.Store.create(spark, str(tmp_path / "other"))
    with pytest.raises(NotADirectoryError):
        store.Store.open(spark, str(tmp_path / "none"))


def test_sinks(capsys):
    kept = []
    sink = sinks.ByteSink(kept.append, block=4)
    sink.write(b"abc", b"defgh")
    assert kept == [b"abcd", b"efgh"] and sink.written == 8
    sink.write(b"i")
    sink.flush()
    assert kept[-1] == b"i"
    text = sinks.MemoryText()
    text.write("a", "é")
    assert text.value() == "aé"
    console = sinks.ConsoleText("> ")
    console.write("a\nb", "c")
    console.flush()
    sinks.log("done")
    assert capsys.readouterr().out == "> a\n> bc\ndone\n"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.js").write_text("x;")
    (tmp_path / "in" / "sub" / "two.js").write_text("var x = 1; x = x + x.y;")
    (tmp_path / "in" / "note.txt").write_text("no script")
    (tmp_path / "s.webidl").write_text(P.IDL)
    out = tmp_path / "out"
    argv = ["--script-dir", str(tmp_path / "in"), "--result-dir", str(out), "--schema", str(tmp_path / "s.webidl")]
    assert cli.main([*argv, "--string-window", "--string-window-sizes", "2,4", "--pretty-print", "--path-suffix", "--path-suffix-length", "2", "--global-strings", "--entropy-code", "--least-size", "1"]) == 0
    found = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert {"WRITABLE", "path-suffix/2/ALL.json", "path-suffix/2/one.txt", "path-suffix/2/sub/two.json", "string-window/4/ALL.txt", "string-window/2/sub/two.json", "global-strings/ALL.json", "pretty-print/one.txt", "entropy-code/sub/two.TSC", "entropy-code/report/one.txt"} <= found
    tables = json.loads((out / "path-suffix/2/one.json").read_text())
    assert tables[0]["suffix"] == "Script.statements.*/ExpressionStatement.expression#type" and tables[0]["freqs"][0] == {"name": "Iface<IdentifierExpression>", "index": 11, "hits": 1} and tables[0]["totalSymbols"] == 9
    text = (out / "path-suffix/2/one.txt").read_text()
    assert text.startswith("Suffix Script.statements.*/ExpressionStatement.expression#type\n  [hits=1/9] 11.11%]\n    Iface<IdentifierExpression>\n        hits=1, bits=0, prob = 100, accum = 100\n\n")
    window = json.loads((out / "string-window/2/sub/two.json").read_text())
    assert window["windowSize"] == 2 and window["idents"][-1] == {"index": "TOTAL", "count": 5, "prob": 1.0} and window["strings"] == []
    assert "WindowSize=2\nTable idents:\n    INDEX 0\n        hits=4, bits=0.32, prob=80, accum=80\n" in (out / "string-window/2/sub/two.txt").read_text()
    assert json.loads((out / "global-strings/ALL.json").read_text())[0] == {"str": "x", "idx": 0, "identCount": 6, "propCount": 0, "rawCount": 0, "totalCount": 6}
    assert (out / "global-strings/sub/two.txt").read_text().startswith('STRING 0 length=1 identCount=5 propCount=0 rawCount=0\n >> "x"\n\n')
    assert (out / "entropy-code/report/one.txt").read_text().startswith("REPORT ")
    assert cli.main(["schema", str(tmp_path / "s.webidl")]) == 0 and "node ExpressionStatement {\n    expression: Expression\n}" in capsys.readouterr().out


def test_global_index(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(7)
    assert all(r.v == r.idx for r in global_index(df, ["v"]).collect())


@pytest.fixture(params=["false", "true"])
def many_ranges(spark, request):
    """Sorts fall into several ranges: partitions are kept, or merged by the bytes that each read of them has."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": request.param, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "16"}
    kept = {c: spark.conf.get(c) for c in own}
    for c, v in own.items():
        spark.conf.set(c, v)
    yield
    for c, v in kept.items():
        spark.conf.set(c, v)


def test_global_index_in_ranges(spark, many_ranges):
    df = spark.range(20_000, numPartitions=7).select((F.col("id") * 7919 % 20_000).alias("v"), F.repeat(F.lit("x"), 40).alias("more"))
    odd = df.select(F.when(F.col("v") > 0, F.struct((F.col("v") / 100).cast("long").alias("a"), F.format_string("%05d", "v").alias("b"))).alias("key"), "v", "more")
    for rows in (global_index(df, ["v"]), global_index(odd, ["key"]), global_index(df, [(-F.col("v"))]).withColumn("idx", 19_999 - F.col("idx"))):
        assert sorted((r.v, r.idx) for r in rows.collect()) == [(i, i) for i in range(20_000)]
    assert global_index(df, ["v"], "at").columns == ["v", "more", "at"] and global_index(df.where("v < 0"), ["v"]).count() == 0


def test_global_strings_in_ranges(spark, many_ranges, tmp_path):
    from arborlens.plans import catalog

    rnd = random.Random(3)
    turns = [(c, t, rnd.choice(["user", "assistant"]), f"text {rnd.randrange(12_000)} " + "y" * 30) for c in range(2000) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    want: dict = {}
    for c, t, role, text in sorted(turns, key=lambda r: (str(r[0]), r[1])):
        for s in (role, text):
            want.setdefault(s, len(want))
    got = catalog.queries()["global_strings_scoped"](spark, str(tmp_path)).where("scope = 'ALL'").collect()
    assert sorted((r.str, r.idx) for r in got) == sorted(want.items())


def test_token_ranks(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("abcdefg", k=rnd.randint(0, 60)))) for i in range(20)] + [(99, None)]
    got = {(r.d, r["rank"]): r.hits for r in recency.token_ranks(spark.createDataFrame(rows, "d long, t string"), "d", "t", 3).collect()}
    want = {}
    for d, t in rows:
        seen = []
        for w in (t.split(" ") if t is not None else []):
            rank = seen.index(w) if w in seen else -1
            seen = [w] + [x for x in seen if x != w]
            rank = rank if rank < 3 else -1
            want[d, rank] = want.get((d, rank), 0) + 1
    assert got == want


def test_uses(spark):
    s = spark.createDataFrame([(1, 1, "global", 0, 99, 0), (1, 2, "function", 10, 50, 1), (2, 1, "global", 0, 9, 0)], "doc long, scope long, kind string, begin int, end int, depth int")
    n = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc long, scope long, name string")
    u = spark.createDataFrame([(1, 20, "x"), (1, 20, "y"), (1, 60, "y"), (2, 5, "x")], "doc long, pos int, name string")
    got = {(r.doc, r.pos, r.name): (r.scope, r.captured) for r in scopes.resolve_uses(u, s, n, ["doc"]).collect()}
    assert got == {(1, 20, "x"): (1, True), (1, 20, "y"): (2, False), (1, 60, "y"): (None, False), (2, 5, "x"): (None, False)}


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_chunked_ranks(spark, chunk):
    """A stream that spans many chunks has the ranks of one group."""
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), t, rnd.choice(["x", "y", "z", "u", "v", None])) for t in range(300 if chunk > 1 else 40)]
    df = spark.createDataFrame(rows, "s string, t long, v string").repartition(3)
    whole, cut = (recency.mtf_ranks(df, ["s"], ["t"], "v", 4, chunk=c).collect() for c in (None, chunk))
    assert {(r.s, r.t): r.dist for r in cut} == {(r.s, r.t): r.dist for r in whole} and len(cut) == len(rows)


def brief(n):
    """A parser tree in short: operators and names with what they hold."""
    if not isinstance(n, dict):
        return n if not isinstance(n, list) else [brief(x) for x in n]
    rest = [brief(v) for k, v in n.items() if k != "type"]
    kind = n["type"]
    if kind in ("IdentifierExpression", "AssignmentTargetIdentifier", "BindingIdentifier", "LiteralNumericExpression", "LiteralStringExpression", "StaticPropertyName"):
        return rest[0]
    return (kind.removesuffix("Expression").removesuffix("Statement"), *rest)


def test_parser_golden():
    assert parse_script("x;") == P.FIRST and parse_script("var x = 1; x = x + x.y;") == P.SECOND
    assert parse_script("'use strict'; \"b\\n\"\nf()")["directives"] == [{"type": "Directive", "rawValue": "use strict"}, {"type": "Directive", "rawValue": "b\\n"}]
    assert parse_script("('no');")["directives"] == [] and len(parse_script("'a' + b")["statements"]) == 1


@pytest.mark.parametrize(
    "source,want",
    [
        ("a + b * c - d", ("Binary", "-", ("Binary", "+", "a", ("Binary", "*", "b", "c")), "d")),
        ("a = b ? c : d = 1, e", ("Binary", ",", ("Assignment", "a", ("Conditional", "b", "c", ("Assignment", "d", 1.0))), "e")),
        ("a || b && !c in d", ("Binary", "||", "a", ("Binary", "&&", "b", ("Binary", "in", ("Unary", "!", "c"), "d")))),
        ("x /= 2 / y / z", ("CompoundAssignment", "/=", "x", ("Binary", "/", ("Binary", "/", 2.0, "y"), "z"))),
        ("f(/[/]a\\//gi, 1)[0].b++", ("Update", False, "++", ("StaticMemberAssignmentTarget", ("ComputedMember", ("Call", "f", [("LiteralRegExp", "[/]a\\/", True, True, False, False, False), 1.0]), 0.0), "b"))),
        ("new a.b(c).d(e)", ("Call", ("StaticMember", ("New", ("StaticMember", "a", "b"), ["c"]), "d"), ["e"])),
        ("new new X", ("New", ("New", "X", []), [])),
        ("[, 1, , 'x',]", ("Array", [None, 1.0, None, "x"])),
        ("typeof void delete a.b", ("Unary", "typeof", ("Unary", "void", ("Unary", "delete", ("StaticMember", "a", "b"))))),
        ("--a.if, ++b", ("Binary", ",", ("Update", True, "--", ("StaticMemberAssignmentTarget", "a", "if")), ("Update", True, "++", "b"))),
        ("0x1F + 017 + .5e1 + 1e999", ("Binary", "+", ("Binary", "+", ("Binary", "+", 31.0, 15.0), 5.0), ("LiteralInfinity",))),
        ("x = {a: 1, 'b c': 2, 3: 4, get d() {return 1}, set e(v) {}, get: 5, if: 6, g}", None),
        ("(function f(a, b) { 'own'; return a })(this, null, true)", None),
    ],
)
def test_parser_expressions(source, want):
    (made,) = parse_script(source)["statements"]
    assert made["type"] == "ExpressionStatement" and (want is None or brief(made["expression"]) == want)


def test_parser_statements():
    source = """#!/usr/bin/env js
    /* a
    comment */ var a = 1, b
    let c; const d = /x/.test(a) // end
    function f(x, y) { return x
      + y }
    if (a) b(); else { ; }
    for (var i = 0, n = 2; i < n; i++) continue
    for (k in o) if ("k" in o) break
    for (var q in (1, o)) ;
    for (;;) { break }
    outer: while (true) { do x--; while (x) continue outer }
    switch (a) { case 1: b(); case 2: break; default: c = 1; case 3: }
    switch (a) { case 1: }
    try { throw e } catch (e) { e } finally { }
    try { } catch (z) { }
    with (o) p()
    debugger
    let
    i
    ++
    j
    return_ = function () { return
      1 }
    """
    made = parse_script(source)["statements"]
    kinds = [s["type"].removesuffix("Statement") for s in made]
    assert kinds == "VariableDeclaration VariableDeclaration VariableDeclaration FunctionDeclaration If For ForIn ForIn For Labeled SwitchStatementWithDefault Switch TryFinally TryCatch With Debugger VariableDeclaration Expression Expression".split()
    assert [len(made[10][k]) for k in ("preDefaultCases", "postDefaultCases")] == [2, 1]
    assert brief(made[3]["body"]["statements"][0]) == ("Return", ("Binary", "+", "x", "y"))
    assert made[16]["declaration"]["declarators"][0]["binding"]["name"] == "i" and brief(made[17])[1] == ("Update", True, "++", "j")
    assert [s["type"] for s in made[18]["expression"]["expression"]["body"]["statements"]] == ["ReturnStatement", "ExpressionStatement"]
    Lifter(SCHEMA)
    for bad in ("a b", "var 1", "x = ", "(", "class A {}", "1 = 2", "throw\n1", "'a\nb'", "for (x of y) ;", "if (", "{", "a => b", "§", "try { }"):
        with pytest.raises(SchemaError):
            parse_script(bad)


def test_strings():
    assert string_value(r"a\x41\u0042\u{1F600}\n\0\101\
b\q\uD83D\uDE00") == "aAB\U0001f600\n\0Abq\U0001f600"
    assert string_value(r"\ud800") == "\ud800"


def test_source_corpus(spark):
    """Scripts go from source to locations; a deep one too, and one that can't be read is reported."""
    sources = {"a.js": "var s = '\\ud800', t = function g(a) { return a; };", "b.js": "x = " + " + ".join(["x"] * 1500), "c.js": "this is no script"}
    files = spark.createDataFrame([(k, len(v), v) for k, v in sources.items()], "subpath string, size long, text string")
    corpus = analyses.Corpus.read(spark, SCHEMA, files, errors="report")
    got = {r.subpath: (r.n, r.e) for r in corpus.nodes.groupBy("subpath").agg(F.count("seq").alias("n"), F.max("error").alias("e")).collect()}
    assert got["a.js"][0] > 30 and got["a.js"][1] is None and got["b.js"][0] > 4500 and "line 1" in got["c.js"][1]
    assert corpus.nodes.where("str_kind = 'raw'").first()["str_value"] == "\\ud800"
