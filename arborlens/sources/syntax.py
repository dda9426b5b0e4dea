"""Lifts parser trees of scripts (objects with a ``type``, as Shift parsers write them) into records of a schema, with scopes.

Most node types are read by one rule each: which interface they become and how each field is read, in the order in
which names are met. The types that open scopes or bind names have a method. What the rules don't know is an error; whether a node may
stand where it stands is checked against the schema when the tree is walked.

Scopes: a declaration goes to the nearest scope that takes its kind; a use is looked up outwards, and once a function's
scope is left the name that it finds is captured. Uses before their declaration stay free.

``compat`` reproduces known slips of a published lifter: declarators bind as var whatever their kind, the first name
of a scope can be declared twice, cases after the default repeat those before it, flags of expressions are joined by
commas, a function's name is bound beside its parameters, and parameters are never captured.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from arborlens.schema.types import Name, Record, SchemaError, Variant

#: The parser's node types, what they become, and their fields in the order in which they are read.
#: ``field`` alone is a node, ``?`` one that may be null, ``*`` an array of them; ``:`` names another way to read it.
_RULES = """
ExpressionStatement > ExpressionStatement expression
IfStatement > IfStatement test consequent alternate?
WhileStatement > WhileStatement test body
DoWhileStatement > DoWhileStatement test body
ReturnStatement > ReturnStatement expression?
BreakStatement > BreakStatement label:text?
ContinueStatement > ContinueStatement label:text?
ThrowStatement > ThrowStatement expression
TryCatchStatement > TryCatchStatement body catchClause
TryFinallyStatement > TryFinallyStatement body catchClause? finalizer
SwitchStatement > SwitchStatement discriminant cases*
SwitchCase > SwitchCase test consequent*
SwitchDefault > SwitchDefault consequent*
LabeledStatement > LabelledStatement label:text body
EmptyStatement > EmptyStatement
DebuggerStatement > DebuggerStatement
WithStatement > WithStatement object body
Directive > Directive rawValue:text
CallExpression > CallExpression callee arguments*
NewExpression > NewExpression callee arguments*
StaticMemberExpression > StaticMemberExpression object property:name
ComputedMemberExpression > ComputedMemberExpression object expression
IdentifierExpression > IdentifierExpression name:use
LiteralStringExpression > LiteralStringExpression value:text
LiteralBooleanExpression > LiteralBooleanExpression value:flag
LiteralNullExpression > LiteralNullExpression
LiteralInfinityExpression > LiteralInfinityExpression
LiteralNumericExpression > LiteralNumericExpression value:number
ObjectExpression > ObjectExpression properties*
DataProperty > DataProperty name expression
ShorthandProperty > ShorthandProperty name
StaticPropertyName > LiteralPropertyName value:name
ComputedPropertyName > ComputedPropertyName expression
ArrayExpression > ArrayExpression elements*
SpreadElement > SpreadElement expression
AssignmentExpression > AssignmentExpression binding expression
CompoundAssignmentExpression > CompoundAssignmentExpression operator:variant binding expression
UpdateExpression > UpdateExpression isPrefix:flag operator:variant operand
UnaryExpression > UnaryExpression operator:variant operand
BinaryExpression > BinaryExpression operator:variant left right
ConditionalExpression > ConditionalExpression test consequent alternate
ThisExpression > ThisExpression
Super > Super
AssignmentTargetIdentifier > AssignmentTargetIdentifier name:use
StaticMemberAssignmentTarget > StaticMemberAssignmentTarget object property:name
ComputedMemberAssignmentTarget > ComputedMemberAssignmentTarget object expression
"""


def _rules():
    for line in _RULES.strip().splitlines():
        kind, _, rest = line.partition(" > ")
        iface, *fields = rest.split()
        yield kind, (iface, [(f.rstrip("?*").partition(":")[0], f.rstrip("?*").partition(":")[2] or "node", f[-1] if f[-1] in "?*" else "") for f in fields])


RULES = dict(_rules())
#: Which kinds of declarations a scope takes, and what it becomes.
_TAKES = {"global": ("var", "let", "const"), "var": ("var", "let", "const"), "block": ("let", "const"), "parameter": ("parameter",), "catch": ("catch",), "own name": ("own name",)}
_ASSERTED = {"global": "AssertedScriptGlobalScope", "var": "AssertedVarScope", "block": "AssertedBlockScope", "parameter": "AssertedParameterScope", "catch": "AssertedBoundNamesScope"}
_INSIDE = {"var": "parameter", "parameter": "own name", "own name": None}
_KINDS = {"var": "KwVar", "let": "NonConstLexical", "const": "ConstLexical"}


@dataclass
class Scope:
    kind: str
    names: list[list] = field(default_factory=list)  # name, kind of declaration, captured
    place: dict[str, int] = field(default_factory=dict)

    def declare(self, name: Name, kind: str, compat: bool) -> None:
        at = self.place.get(name)
        if at is not None and not (compat and at == 0):
            if kind in _KINDS and (kind, self.names[at][1]) != ("var", "var"):
                raise SchemaError(f"{name} is declared as {self.names[at][1]} and as {kind}")
            return
        self.place[name] = len(self.names)
        self.names.append([name, kind, False])

    def asserted(self) -> Record:
        declared = self.kind in ("global", "var", "block")
        rows = [Record("AssertedDeclaredName", {"name": n, "kind": Variant("AssertedDeclaredKind", _KINDS[k]), "isCaptured": c}) if declared else Record("AssertedBoundName", {"name": n, "isCaptured": c}) for n, k, c in self.names]
        extra = {"isSimpleParameterList": False} if self.kind == "parameter" else {}
        return Record(_ASSERTED[self.kind], {"declaredNames" if declared else "boundNames": rows, "hasDirectEval": False} | extra)


class Lifter:
    """Lifts one script. ``strings`` and ``names`` count what was met."""

    def __init__(self, schema, compat: bool = False):
        self.schema, self.compat, self.scopes = schema, compat, []
        self.strings: Counter[str] = Counter()
        self.names: Counter[str] = Counter()
        self.enums = {(i.name, f): t[1] for i in schema.declarations.values() if hasattr(i, "is_node") for f, b, _ in i.fields for t in schema.type_set(b) if t[0] == "enum"}

    # Names and scopes

    def name(self, text) -> Name:
        if not isinstance(text, str):
            raise SchemaError(f"a name must be a text, not {text!r}")
        self.names[text] += 1
        return Name(text)

    def use(self, text) -> Name:
        captured = False
        name = self.name(text)
        for k in range(len(self.scopes) - 1, -1, -1):
            scope = self.scopes[k]
            if name in scope.place:
                if captured:
                    scope.names[scope.place[name]][2] = True
                break
            outer = self.scopes[k - 1].kind if k else None
            # A function's scopes are its body in its parameters in its own name; it is left with the last of them.
            captured = captured or (scope.kind == "var" if self.compat else scope.kind in _INSIDE and outer != _INSIDE[scope.kind])
        return name

    def bind(self, node, kind: str) -> Record:
        if node["type"] != "BindingIdentifier":
            raise SchemaError(f"{node['type']} can't be bound yet")
        name = self.name(node["name"])
        for scope in reversed(self.scopes):
            if kind in _TAKES[scope.kind]:
                scope.declare(name, kind, self.compat)
                return Record("BindingIdentifier", {"name": name})
        raise SchemaError(f"no scope takes {name} as {kind}")

    def inside(self, kind: str, work):
        """The result of ``work(scope)`` in a new scope."""
        scope = Scope(kind)
        self.scopes.append(scope)
        try:
            return work(scope)
        finally:
            self.scopes.pop()

    # Fields

    def text(self, value) -> str:
        if not isinstance(value, str):
            raise SchemaError(f"a text expected, not {value!r}")
        self.strings[value] += 1
        return value

    def flag(self, value) -> bool:
        if not isinstance(value, bool):
            raise SchemaError(f"true or false expected, not {value!r}")
        return value

    def number(self, value) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise SchemaError(f"a number expected, not {value!r}")
        return float(value)

    def variant(self, enum: str, text: str) -> Variant:
        e = self.schema.enum(enum)
        if text not in e.texts:
            raise SchemaError(f"{enum} has no {text!r}")
        return Variant(enum, e.variants[e.texts.index(text)])

    def nodes(self, values) -> list:
        if not isinstance(values, list):
            raise SchemaError(f"an array expected, not {values!r}")
        return [None if v is None else self.node(v) for v in values]

    def node(self, node) -> Record:
        kind = node.get("type") if isinstance(node, dict) else None
        special = getattr(self, f"_{kind}", None) if kind else None
        if special:
            return special(node)
        if kind not in RULES:
            raise SchemaError(f"nodes of type {kind!r} aren't known")
        iface, rules = RULES[kind]
        fields = {}
        for name, how, many in rules:
            value = node.get(name)
            if value is None and many == "?":
                fields[name] = None
            elif many == "*":
                fields[name] = self.nodes(value)
            else:
                fields[name] = self.variant(self.enums[iface, name], value) if how == "variant" else getattr(self, how)(value)
        return Record(iface, fields)

    # Nodes with scopes and bindings

    def script(self, node) -> Record:
        """The root."""
        if node.get("type") != "Script":
            raise SchemaError(f"a Script expected, not {node.get('type')!r}")
        directives = self.nodes(node["directives"])

        def work(scope):
            statements = self.nodes(node["statements"])
            return Record("Script", {"scope": scope.asserted(), "directives": directives, "statements": statements})

        return self.inside("global", work)

    def _BlockStatement(self, node):
        return self.node(node["block"])

    def _Block(self, node):
        def work(scope):
            statements = self.nodes(node["statements"])
            return Record("Block", {"scope": scope.asserted(), "statements": statements})

        return self.inside("block", work)

    def _VariableDeclarationStatement(self, node):
        return self.node(node["declaration"])

    def _VariableDeclaration(self, node):
        kind = node["kind"]
        out = []
        for d in node["declarators"]:
            init = None if d.get("init") is None else self.node(d["init"])  # before its name is bound
            out.append(Record("VariableDeclarator", {"binding": self.bind(d["binding"], "var" if self.compat else kind), "init": init}))
        return Record("VariableDeclaration", {"kind": self.variant("VariableDeclarationKind", kind), "declarators": out})

    def _ForInStatement(self, node):
        def work(_scope):
            right = self.node(node["right"])  # before the variable is bound
            left = node["left"]
            if left["type"] == "VariableDeclaration":
                (d,) = left["declarators"]
                left = Record("ForInOfBinding", {"kind": self.variant("VariableDeclarationKind", left["kind"]), "binding": self.bind(d["binding"], left["kind"])})
            else:
                left = self.node(left)
            return Record(node["type"], {"left": left, "right": right, "body": self.node(node["body"])})

        return self.inside("block", work)

    _ForOfStatement = _ForInStatement

    def _ForStatement(self, node):
        def work(_scope):
            head = {k: None if node.get(k) is None else self.node(node[k]) for k in ("init", "test", "update")}
            return Record("ForStatement", head | {"body": self.node(node["body"])})

        return self.inside("block", work)

    def _CatchClause(self, node):
        def work(scope):
            binding = self.bind(node["binding"], "catch")
            body = self.node(node["body"])
            return Record("CatchClause", {"bindingScope": scope.asserted(), "binding": binding, "body": body})

        return self.inside("catch", work)

    def _SwitchStatementWithDefault(self, node):
        out = {"discriminant": self.node(node["discriminant"]), "preDefaultCases": self.nodes(node["preDefaultCases"]), "defaultCase": self.node(node["defaultCase"])}
        return Record("SwitchStatementWithDefault", out | {"postDefaultCases": self.nodes(node["preDefaultCases" if self.compat else "postDefaultCases"])})

    def _LiteralRegExpExpression(self, node):
        marks = {"g": "global", "i": "ignoreCase", "m": "multiLine", "u": "unicode", "y": "sticky"}
        flags = ("," if self.compat else "").join(m for m, key in marks.items() if self.flag(node[key]))
        return Record("LiteralRegExpExpression", {"pattern": self.text(node["pattern"]), "flags": self.text(flags)})

    def _FormalParameters(self, node):
        return Record("FormalParameters", {"items": [self.bind(p, "parameter") for p in node["items"]], "rest": None if node.get("rest") is None else self.bind(node["rest"], "parameter")})

    def body(self, node, contents: str, parameters) -> Record:
        """The contents of a function: its parameters, then its body in a scope of its own."""

        def work(outer):
            fields = {"isThisCaptured": False} | parameters()
            early = outer.asserted()

            def inner(scope):
                statements = self.nodes(node["body"]["statements"])
                return {"bodyScope": scope.asserted(), "body": statements}

            fields |= self.inside("var", inner)
            return Record(contents, fields | {"parameterScope": early if self.compat else outer.asserted()})

        return self.inside("parameter", work)

    def function(self, node, iface: str, contents: str, own_kind: str | None) -> Record:
        head = {"isAsync": False, "isGenerator": self.flag(node["isGenerator"]), "directives": self.nodes(node["body"]["directives"])}
        found = {}

        def parameters():
            if self.compat or own_kind == "parameter":
                found["name"] = None if node.get("name") is None else self.bind(node["name"], "parameter")
            return {"params": self._FormalParameters(node["params"])}

        if not self.compat and own_kind == "var":
            found["name"] = self.bind(node["name"], "var")
        if not self.compat and own_kind == "own name":

            def work(scope):
                found["name"] = None if node.get("name") is None else self.bind(node["name"], "own name")
                made = self.body(node, contents, parameters)
                made.fields["isFunctionNameCaptured"] = any(c for _, _, c in scope.names)
                return made

            made = self.inside("own name", work)
        else:
            made = self.body(node, contents, parameters)
            if own_kind == "own name":
                made.fields["isFunctionNameCaptured"] = False
        return Record(iface, head | found | {"contents": made})

    def _FunctionDeclaration(self, node):
        return self.function(node, "EagerFunctionDeclaration", "FunctionOrMethodContents", "var")

    def _FunctionExpression(self, node):
        return self.function(node, "EagerFunctionExpression", "FunctionExpressionContents", "own name")

    def _Getter(self, node):
        name, directives = self.node(node["name"]), self.nodes(node["body"]["directives"])

        def work(scope):
            statements = self.nodes(node["body"]["statements"])
            return Record("GetterContents", {"isThisCaptured": False, "bodyScope": scope.asserted(), "body": statements})

        return Record("EagerGetter", {"name": name, "directives": directives, "contents": self.inside("var", work)})

    def _Setter(self, node):
        name, directives = self.node(node["name"]), self.nodes(node["body"]["directives"])
        contents = self.body(node, "SetterContents", lambda: {"param": self.bind(node["param"], "parameter")})
        return Record("EagerSetter", {"name": name, "directives": directives, "contents": contents})


def lift_script(schema, tree, compat: bool = False) -> Record:
    """The record of a parsed script, given as an object or as JSON text."""
    return Lifter(schema, compat).script(json.loads(tree) if isinstance(tree, str) else tree)
