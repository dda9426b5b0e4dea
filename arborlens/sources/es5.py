"""Parses ECMAScript 5 (with let, const and shorthand properties) into parser trees as ``sources.syntax`` reads them.

Tokens are read where the parser stands, so a slash is a division or the start of an expression by what may come there. Semicolons
are put in where the language says so. What later editions add is an error that names its line.
"""

from __future__ import annotations

import re

from arborlens.schema.types import SchemaError

_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n]*)+", re.S)
_NAME = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|0[0-7]+(?![0-9.eE])|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'", re.S)
_PATTERN = re.compile(r"/((?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([a-zA-Z]*)")
_MARK = re.compile(r">>>=|===|!==|>>>|<<=|>>=|\*\*=|\*\*|=>|\.\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.]")
_LINE_END = re.compile(r"[\n\r\u2028\u2029]")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-3][0-7]{0,2}|[4-7][0-7]?)|(\r\n|[\n\r\u2028\u2029])|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "b": "\b", "v": "\v", "f": "\f", "r": "\r"}

#: Fixed values of the language: reserved words, and binary operators from the loosest to the tightest.
RESERVED = frozenset("break case catch const continue debugger default delete do else finally for function if in instanceof new return switch this throw try typeof var void while with class enum export extends import super null true false".split())
_LEVELS = ["||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %"]
_TIGHT = {op: k for k, ops in enumerate(_LEVELS, 1) for op in ops.split()}
_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^=".split())
_UNARY = frozenset("+ - ! ~ typeof void delete".split())


def string_value(raw: str) -> str:
    """The value of a string literal without its quotes; surrogate pairs are joined."""

    def one(m):
        if m[1] or m[2] or m[3]:
            return chr(int(m[1] or m[2] or m[3], 16))
        if m[4]:
            return chr(int(m[4], 8))
        return "" if m[5] else _PLAIN.get(m[6], m[6])

    return _ESCAPE.sub(one, raw).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") if "\\" in raw else raw


class Parser:
    def __init__(self, source: str):
        self.source, self.at = source, 0
        if source.startswith("#!"):
            self.at = len(source.split("\n", 1)[0])
        self.advance()

    # Tokens: (kind, text) with where it begins and whether a line ended before it

    def advance(self) -> None:
        m = _SPACE.match(self.source, self.at)
        skipped = m[0] if m else ""
        self.at += len(skipped)
        self.fresh = self.at == len(skipped) or _LINE_END.search(skipped) is not None
        self.begin = self.at
        if self.at >= len(self.source):
            self.kind, self.token = "end", ""
            return
        for kind, pattern in (("name", _NAME), ("number", _NUMBER), ("string", _STRING), ("mark", _MARK)):
            if m := pattern.match(self.source, self.at):
                self.kind, self.token, self.at = kind, m[0], m.end()
                if kind == "name" and "\\" in self.token:
                    self.token = string_value(self.token)
                return
        self.fail("unexpected character")

    def fail(self, what: str):
        line = self.source.count("\n", 0, self.begin) + 1
        raise SchemaError(f"line {line}: {what} at {self.source[self.begin : self.begin + 20]!r}")

    def sees(self, *tokens: str) -> bool:
        return self.kind in ("name", "mark") and self.token in tokens

    def take(self, *tokens: str) -> bool:
        if self.sees(*tokens):
            self.advance()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"{token!r} expected")

    def name(self) -> str:
        if self.kind != "name" or self.token in RESERVED:
            self.fail("a name expected")
        name = self.token
        self.advance()
        return name

    def end_statement(self) -> None:
        if not self.take(";") and not (self.sees("}") or self.kind == "end" or self.fresh):
            self.fail("';' expected")

    # Statements

    def script(self) -> dict:
        directives, statements = self.body(lambda: self.kind == "end")
        return {"type": "Script", "directives": directives, "statements": statements}

    def body(self, done) -> tuple[list, list]:
        """Directives and statements. A directive is a statement of a string alone."""
        directives, statements = [], []
        while not done():
            if self.kind == "string" and not statements:
                raw = self.token[1:-1]
                made = self.statement()
                if made.get("expression", {}).get("type") == "LiteralStringExpression":
                    directives.append({"type": "Directive", "rawValue": raw})
                    continue
                statements.append(made)
            else:
                statements.append(self.statement())
        return directives, statements

    def block(self) -> dict:
        self.need("{")
        statements = []
        while not self.take("}"):
            statements.append(self.statement())
        return {"type": "Block", "statements": statements}

    def statement(self) -> dict:
        if self.kind == "mark" and self.token == "{":
            return {"type": "BlockStatement", "block": self.block()}
        if self.take(";"):
            return {"type": "EmptyStatement"}
        if self.kind == "name":
            if self.token in ("class", "import", "export"):
                self.fail("not known yet")
            own = getattr(self, f"_{self.token}", None) if self.token in RESERVED else None
            if own:
                return own()
            if self.token in ("var", "const") or self.token == "let" and self.declares():
                made = self.declaration()
                self.end_statement()
                return {"type": "VariableDeclarationStatement", "declaration": made}
        begin, was_name = (self.begin, self.at, self.kind, self.token, self.fresh), self.kind == "name" and self.token not in RESERVED
        if was_name:
            label = self.token
            self.advance()
            if self.take(":"):
                return {"type": "LabeledStatement", "label": label, "body": self.statement()}
            self.begin, self.at, self.kind, self.token, self.fresh = begin
        expression = self.expression()
        self.end_statement()
        return {"type": "ExpressionStatement", "expression": expression}

    def declares(self) -> bool:
        """Whether ``let`` is followed by a name."""
        m = _SPACE.match(self.source, self.at)
        m = _NAME.match(self.source, m.end() if m else self.at)
        return m is not None and m[0] not in RESERVED

    def declaration(self, with_in: bool = True) -> dict:
        kind = self.token
        self.advance()
        out = []
        while True:
            name = {"type": "BindingIdentifier", "name": self.name()}
            out.append({"type": "VariableDeclarator", "binding": name, "init": self.assignment(with_in) if self.take("=") else None})
            if not self.take(","):
                return {"type": "VariableDeclaration", "kind": kind, "declarators": out}

    def condition(self) -> dict:
        self.need("(")
        test = self.expression()
        self.need(")")
        return test

    def _function(self):
        return self.function("FunctionDeclaration")

    def _if(self):
        self.advance()
        test, consequent = self.condition(), self.statement()
        return {"type": "IfStatement", "test": test, "consequent": consequent, "alternate": self.statement() if self.take("else") else None}

    def _while(self):
        self.advance()
        return {"type": "WhileStatement", "test": self.condition(), "body": self.statement()}

    def _do(self):
        self.advance()
        body = self.statement()
        self.need("while")
        test = self.condition()
        self.take(";")
        return {"type": "DoWhileStatement", "test": test, "body": body}

    def _for(self):
        self.advance()
        self.need("(")
        init = None
        if self.sees("var", "const") or self.sees("let") and self.declares():
            init = self.declaration(with_in=False)
        elif not self.sees(";"):
            init = self.expression(with_in=False)
        if self.take("in"):
            left = init if init["type"] == "VariableDeclaration" else self.target(init)
            right = self.expression()
            self.need(")")
            return {"type": "ForInStatement", "left": left, "right": right, "body": self.statement()}
        self.need(";")
        test = None if self.sees(";") else self.expression()
        self.need(";")
        update = None if self.sees(")") else self.expression()
        self.need(")")
        return {"type": "ForStatement", "init": init, "test": test, "update": update, "body": self.statement()}

    def jump(self, kind: str) -> dict:
        self.advance()
        label = self.name() if self.kind == "name" and not self.fresh and self.token not in RESERVED else None
        self.end_statement()
        return {"type": kind, "label": label}

    def _break(self):
        return self.jump("BreakStatement")

    def _continue(self):
        return self.jump("ContinueStatement")

    def _return(self):
        self.advance()
        value = None if self.sees(";", "}") or self.kind == "end" or self.fresh else self.expression()
        self.end_statement()
        return {"type": "ReturnStatement", "expression": value}

    def _throw(self):
        self.advance()
        if self.fresh:
            self.fail("a value expected in this line")
        value = self.expression()
        self.end_statement()
        return {"type": "ThrowStatement", "expression": value}

    def _debugger(self):
        self.advance()
        self.end_statement()
        return {"type": "DebuggerStatement"}

    def _with(self):
        self.advance()
        return {"type": "WithStatement", "object": self.condition(), "body": self.statement()}

    def _try(self):
        self.advance()
        body, clause = self.block(), None
        if self.take("catch"):
            self.need("(")
            binding = {"type": "BindingIdentifier", "name": self.name()}
            self.need(")")
            clause = {"type": "CatchClause", "binding": binding, "body": self.block()}
        if self.take("finally"):
            return {"type": "TryFinallyStatement", "body": body, "catchClause": clause, "finalizer": self.block()}
        if clause is None:
            self.fail("catch or finally expected")
        return {"type": "TryCatchStatement", "body": body, "catchClause": clause}

    def _switch(self):
        self.advance()
        out = {"type": "SwitchStatement", "discriminant": self.condition(), "cases": []}
        self.need("{")
        into, default = out["cases"], None
        while not self.take("}"):
            if self.take("case"):
                case = {"type": "SwitchCase", "test": self.expression(), "consequent": []}
                into.append(case)
            elif default is None and self.take("default"):
                case = default = {"type": "SwitchDefault", "consequent": []}
                into = []
            else:
                self.fail("case or default expected")
            self.need(":")
            while not self.sees("case", "default", "}"):
                case["consequent"].append(self.statement())
        if default is None:
            return out
        return {"type": "SwitchStatementWithDefault", "discriminant": out["discriminant"], "preDefaultCases": out["cases"], "defaultCase": default, "postDefaultCases": into}

    # Functions

    def function_body(self) -> dict:
        self.need("{")
        directives, statements = self.body(lambda: self.sees("}"))
        self.need("}")
        return {"type": "FunctionBody", "directives": directives, "statements": statements}

    def function(self, kind: str) -> dict:
        self.advance()
        named = kind == "FunctionDeclaration" or not self.sees("(")
        name = {"type": "BindingIdentifier", "name": self.name()} if named else None
        self.need("(")
        items = []
        while not self.take(")"):
            items.append({"type": "BindingIdentifier", "name": self.name()})
            if not self.sees(")"):
                self.need(",")
        return {"type": kind, "isAsync": False, "isGenerator": False, "name": name, "params": {"type": "FormalParameters", "items": items, "rest": None}, "body": self.function_body()}

    # Expressions

    def expression(self, with_in: bool = True) -> dict:
        left = self.assignment(with_in)
        while self.take(","):
            left = {"type": "BinaryExpression", "operator": ",", "left": left, "right": self.assignment(with_in)}
        return left

    def target(self, e: dict) -> dict:
        """An expression as what is assigned to."""
        kind = e["type"]
        if kind == "IdentifierExpression":
            return {"type": "AssignmentTargetIdentifier", "name": e["name"]}
        if kind == "StaticMemberExpression":
            return {"type": "StaticMemberAssignmentTarget", "object": e["object"], "property": e["property"]}
        if kind == "ComputedMemberExpression":
            return {"type": "ComputedMemberAssignmentTarget", "object": e["object"], "expression": e["expression"]}
        self.fail("this can't be assigned to")

    def assignment(self, with_in: bool = True) -> dict:
        left = self.conditional(with_in)
        if self.take("="):
            return {"type": "AssignmentExpression", "binding": self.target(left), "expression": self.assignment(with_in)}
        if self.kind == "mark" and self.token in _ASSIGN:
            operator = self.token
            self.advance()
            return {"type": "CompoundAssignmentExpression", "operator": operator, "binding": self.target(left), "expression": self.assignment(with_in)}
        return left

    def conditional(self, with_in: bool) -> dict:
        test = self.binary(1, with_in)
        if not self.take("?"):
            return test
        consequent = self.assignment()
        self.need(":")
        return {"type": "ConditionalExpression", "test": test, "consequent": consequent, "alternate": self.assignment(with_in)}

    def binary(self, least: int, with_in: bool) -> dict:
        """Operators that bind at least as tightly as ``least``; equal ones from the left."""
        left = self.unary()
        while self.kind in ("mark", "name") and (level := _TIGHT.get(self.token, 0)) >= least and (with_in or self.token != "in"):
            operator = self.token
            self.advance()
            left = {"type": "BinaryExpression", "operator": operator, "left": left, "right": self.binary(level + 1, with_in)}
        return left

    def unary(self) -> dict:
        if self.kind in ("mark", "name") and self.token in _UNARY:
            operator = self.token
            self.advance()
            return {"type": "UnaryExpression", "operator": operator, "operand": self.unary()}
        if self.sees("++", "--"):
            operator = self.token
            self.advance()
            return {"type": "UpdateExpression", "isPrefix": True, "operator": operator, "operand": self.target(self.unary())}
        e = self.member(calls=True)
        if self.sees("++", "--") and not self.fresh:
            operator = self.token
            self.advance()
            return {"type": "UpdateExpression", "isPrefix": False, "operator": operator, "operand": self.target(e)}
        return e

    def arguments(self) -> list:
        out = []
        self.need("(")
        while not self.take(")"):
            out.append(self.assignment())
            if not self.sees(")"):
                self.need(",")
        return out

    def member(self, calls: bool) -> dict:
        if self.take("new"):
            callee = self.member(calls=False)
            e = {"type": "NewExpression", "callee": callee, "arguments": self.arguments() if self.sees("(") else []}
        else:
            e = self.primary()
        while True:
            if self.take("."):
                if self.kind != "name":
                    self.fail("a property expected")
                e = {"type": "StaticMemberExpression", "object": e, "property": self.token}
                self.advance()
            elif self.take("["):
                e = {"type": "ComputedMemberExpression", "object": e, "expression": self.expression()}
                self.need("]")
            elif calls and self.sees("("):
                e = {"type": "CallExpression", "callee": e, "arguments": self.arguments()}
            else:
                return e

    def primary(self) -> dict:
        kind, token = self.kind, self.token
        if kind == "number":
            self.advance()
            if re.fullmatch("0[0-7]+", token):
                value = float(int(token, 8))
            else:
                value = float(int(token, 0)) if token[:2].lower() in ("0x", "0o", "0b") else float(token)
            return {"type": "LiteralInfinityExpression"} if value == float("inf") else {"type": "LiteralNumericExpression", "value": value}
        if kind == "string":
            self.advance()
            return {"type": "LiteralStringExpression", "value": string_value(token[1:-1])}
        if kind == "mark" and token in ("/", "/="):
            m = _PATTERN.match(self.source, self.begin)
            if not m:
                self.fail("an expression expected")
            self.at = m.end()
            self.advance()
            return {"type": "LiteralRegExpExpression", "pattern": m[1]} | {flag: mark in m[2] for mark, flag in (("g", "global"), ("i", "ignoreCase"), ("m", "multiLine"), ("u", "unicode"), ("y", "sticky"))}
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("["):
            elements = []
            while not self.take("]"):
                if self.take(","):
                    elements.append(None)
                    continue
                elements.append(self.assignment())
                if not self.sees("]"):
                    self.need(",")
            return {"type": "ArrayExpression", "elements": elements}
        if self.take("{"):
            properties = []
            while not self.take("}"):
                properties.append(self.property_())
                if not self.sees("}"):
                    self.need(",")
            return {"type": "ObjectExpression", "properties": properties}
        if kind == "name":
            if token == "function":
                return self.function("FunctionExpression")
            simple = {"this": {"type": "ThisExpression"}, "null": {"type": "LiteralNullExpression"}, "true": {"type": "LiteralBooleanExpression", "value": True}, "false": {"type": "LiteralBooleanExpression", "value": False}}
            if token in simple:
                self.advance()
                return simple[token]
            return {"type": "IdentifierExpression", "name": self.name()}
        self.fail("an expression expected")

    def property_name(self) -> dict:
        kind, token = self.kind, self.token
        if kind == "number":
            value = self.primary().get("value", float("inf"))
            token = str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
        elif kind == "string":
            token = string_value(token[1:-1])
            self.advance()
        elif kind == "name":
            self.advance()
        else:
            self.fail("a property expected")
        return {"type": "StaticPropertyName", "value": token}

    def property_(self) -> dict:
        accessor, plain = self.token if self.sees("get", "set") else None, self.kind == "name" and self.token not in RESERVED
        name = self.property_name()
        if accessor and not self.sees(":", ",", "}", "("):
            name = self.property_name()
            self.need("(")
            made = {"type": "Getter" if accessor == "get" else "Setter", "name": name}
            if accessor == "set":
                made["param"] = {"type": "BindingIdentifier", "name": self.name()}
            self.need(")")
            return made | {"body": self.function_body()}
        if self.take(":"):
            return {"type": "DataProperty", "name": name, "expression": self.assignment()}
        if plain and self.sees(",", "}"):
            return {"type": "ShorthandProperty", "name": {"type": "IdentifierExpression", "name": name["value"]}}
        self.fail("':' expected")


def parse_script(source: str) -> dict:
    """The parser tree of a script."""
    return Parser(source).script()
