"""A schema of scripts with the interfaces that the tests need, and parser trees of small programs."""

#: Names of declarations and fields. Interfaces whose fields no test needs have none.
EXPRESSIONS = "LiteralBooleanExpression LiteralInfinityExpression LiteralNullExpression LiteralNumericExpression LiteralStringExpression LiteralRegExpExpression ArrayExpression EagerArrowExpression LazyArrowExpression AssignmentExpression BinaryExpression CallExpression CompoundAssignmentExpression ComputedMemberExpression ConditionalExpression ClassExpression EagerFunctionExpression LazyFunctionExpression IdentifierExpression NewExpression NewTargetExpression ObjectExpression UnaryExpression StaticMemberExpression TemplateExpression ThisExpression UpdateExpression YieldExpression YieldStarExpression AwaitExpression".split()
STATEMENTS = "Block BreakStatement ContinueStatement ClassDeclaration DebuggerStatement EmptyStatement ExpressionStatement EagerFunctionDeclaration LazyFunctionDeclaration IfStatement DoWhileStatement ForInStatement ForOfStatement ForStatement WhileStatement LabelledStatement ReturnStatement SwitchStatement SwitchStatementWithDefault ThrowStatement TryCatchStatement TryFinallyStatement VariableDeclaration WithStatement".split()
FIELDS = """
Script: AssertedScriptGlobalScope scope; FrozenArray<Directive> directives; FrozenArray<Statement> statements
Directive: string rawValue
Block: AssertedBlockScope scope; FrozenArray<Statement> statements
ExpressionStatement: Expression expression
ReturnStatement: Expression? expression
TryCatchStatement: Block body; CatchClause catchClause
CatchClause: AssertedBoundNamesScope bindingScope; Binding binding; Block body
SwitchStatementWithDefault: Expression discriminant; FrozenArray<SwitchCase> preDefaultCases; SwitchDefault defaultCase; FrozenArray<SwitchCase> postDefaultCases
SwitchCase: Expression test; FrozenArray<Statement> consequent
SwitchDefault: FrozenArray<Statement> consequent
VariableDeclaration: VariableDeclarationKind kind; FrozenArray<VariableDeclarator> declarators
VariableDeclarator: Binding binding; Expression? init
BindingIdentifier: Identifier name
ObjectBinding:
ArrayBinding:
AssignmentTargetIdentifier: Identifier name
ComputedMemberAssignmentTarget: (Expression or Super) _object; Expression expression
StaticMemberAssignmentTarget: (Expression or Super) _object; IdentifierName property
ObjectAssignmentTarget:
ArrayAssignmentTarget:
Super:
AssignmentExpression: AssignmentTarget binding; Expression expression
BinaryExpression: BinaryOperator operator; Expression left; Expression right
StaticMemberExpression: (Expression or Super) _object; PropertyString property
IdentifierExpression: Identifier name
LiteralNumericExpression: double value
LiteralStringExpression: string value
LiteralRegExpExpression: string pattern; string flags
EagerFunctionExpression: boolean isAsync; boolean isGenerator; BindingIdentifier? name; FrozenArray<Directive> directives; FunctionExpressionContents contents
EagerFunctionDeclaration: boolean isAsync; boolean isGenerator; BindingIdentifier name; FrozenArray<Directive> directives; FunctionOrMethodContents contents
FunctionExpressionContents: boolean isFunctionNameCaptured; boolean isThisCaptured; AssertedParameterScope parameterScope; FormalParameters params; AssertedVarScope bodyScope; FrozenArray<Statement> body
FunctionOrMethodContents: boolean isThisCaptured; AssertedParameterScope parameterScope; FormalParameters params; AssertedVarScope bodyScope; FrozenArray<Statement> body
FormalParameters: FrozenArray<Binding> items; Binding? rest
""".strip()
IDL = """
// Scopes aren't nodes.
typedef DOMString string;
[IdentifierType=ident] typedef string Identifier;
[IdentifierType=ident] typedef string IdentifierName;
[IdentifierType=prop] typedef string PropertyString;
enum VariableDeclarationKind { "var", "let", "const" };
enum AssertedDeclaredKind { "var", "non-const lexical", "const lexical" };
enum BinaryOperator { ",", "||", "&&", "|", "^", "&", "==", "!=", "===", "!==", "<", "<=", ">", ">=", "in", "instanceof", "<<", ">>", ">>>", "+", "-", "*", "/", "%", "**" };
interface Node { };
interface AssertedDeclaredName { attribute IdentifierName name; attribute AssertedDeclaredKind kind; attribute boolean isCaptured; };
interface AssertedBoundName { attribute IdentifierName name; attribute boolean isCaptured; };
interface AssertedScriptGlobalScope { attribute FrozenArray<AssertedDeclaredName> declaredNames; attribute boolean hasDirectEval; };
interface AssertedBlockScope { attribute FrozenArray<AssertedDeclaredName> declaredNames; attribute boolean hasDirectEval; };
interface AssertedVarScope { attribute FrozenArray<AssertedDeclaredName> declaredNames; attribute boolean hasDirectEval; };
interface AssertedBoundNamesScope { attribute FrozenArray<AssertedBoundName> boundNames; attribute boolean hasDirectEval; };
interface AssertedParameterScope { attribute FrozenArray<AssertedBoundName> boundNames; attribute boolean hasDirectEval; attribute boolean isSimpleParameterList; };
typedef (ObjectBinding or ArrayBinding) BindingPattern;
typedef (BindingPattern or BindingIdentifier) Binding;
typedef (AssignmentTargetIdentifier or ComputedMemberAssignmentTarget or StaticMemberAssignmentTarget) SimpleAssignmentTarget;
typedef (ObjectAssignmentTarget or ArrayAssignmentTarget or SimpleAssignmentTarget) AssignmentTarget;
""" + f"typedef ({' or '.join(EXPRESSIONS)}) Expression;\ntypedef ({' or '.join(STATEMENTS)}) Statement;\n"
_given = dict(line.partition(":")[::2] for line in FIELDS.splitlines())
for _name in dict.fromkeys([*EXPRESSIONS, *STATEMENTS, *_given]):
    IDL += f"interface {_name} : Node {{ {' '.join(f'attribute {f.strip()};' for f in _given.get(_name, '').split(';') if f.strip())} }};\n"


def ident(name):
    return {"type": "IdentifierExpression", "name": name}


def bound(name):
    return {"type": "BindingIdentifier", "name": name}


def number(value):
    return {"type": "LiteralNumericExpression", "value": value}


def run(expression):
    return {"type": "ExpressionStatement", "expression": expression}


def script(*statements, directives=()):
    return {"type": "Script", "directives": [{"type": "Directive", "rawValue": d} for d in directives], "statements": list(statements)}


def declare(kind, name, init=None):
    return {"type": "VariableDeclarationStatement", "declaration": {"type": "VariableDeclaration", "kind": kind, "declarators": [{"type": "VariableDeclarator", "binding": bound(name), "init": init}]}}


def assign(name, expression):
    return run({"type": "AssignmentExpression", "binding": {"type": "AssignmentTargetIdentifier", "name": name}, "expression": expression})


def plus(left, right):
    return {"type": "BinaryExpression", "operator": "+", "left": left, "right": right}


def function(kind, name, params, *statements):
    return {"type": kind, "isGenerator": False, "name": name and bound(name), "params": {"type": "FormalParameters", "items": [bound(p) for p in params], "rest": None}, "body": {"type": "FunctionBody", "directives": [], "statements": list(statements)}}


def block(*statements):
    return {"type": "BlockStatement", "block": {"type": "Block", "statements": list(statements)}}


#: ``x;`` and ``var x = 1; x = x + x.y;``
FIRST = script(run(ident("x")))
SECOND = script(declare("var", "x", number(1)), assign("x", plus(ident("x"), {"type": "StaticMemberExpression", "object": ident("x"), "property": "y"})))
