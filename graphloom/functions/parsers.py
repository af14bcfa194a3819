"""Parsers as table functions: s-expressions, logic formulas and Python code become rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

_SEXPR = re.compile(r'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')
_FOL = re.compile(r"\s*(->|<->|[∀∃¬∧∨→↔&|~!(),.]|\w+)")
_SAME = {"∧": "&", "∨": "|", "→": "->", "↔": "<->", "¬": "~", "!": "~", "∀": "forall", "∃": "exists"}


def parse_sexpr(text: str) -> list:
    """Nested lists of strings; a missing end is an error."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text.rstrip()):
        m = _SEXPR.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) < 2:
                raise ValueError("too many closing brackets")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[3]) if m[3] is not None else m[4])
    if len(stack) > 1:
        raise ValueError("missing closing bracket")
    return stack[0]


def write_sexpr(value: list | str) -> str:
    """The text of nested lists; parse_sexpr reads it back."""
    if isinstance(value, list):
        return "(" + " ".join(map(write_sexpr, value)) + ")"
    if value and not re.search(r'[\s()"\\]', value):
        return value
    return '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def parse_formula(text: str) -> tuple:
    """First-order formula -> nested tuples: (op, args...), with the usual precedence (not, and, or, implies, iff)."""
    tokens = [_SAME.get(t, t) for t in _FOL.findall(text)]
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(expected: str | None = None) -> str:
        nonlocal at
        token = peek()
        if token is None or (expected is not None and token != expected):
            raise ValueError(f"expected {expected or 'more'}, found {token}")
        at += 1
        return token

    def level(k: int) -> tuple:
        ops = ("<->", "->", "|", "&")
        if k == len(ops):
            return unary()
        left = level(k + 1)
        while peek() == ops[k]:
            take()
            left = (ops[k], left, level(k if ops[k] == "->" else k + 1))
        return left

    def unary() -> tuple:
        token = take()
        if token == "~":
            return ("~", unary())
        if token in ("forall", "exists"):
            name = take()
            if peek() == ".":
                take()
            return (token, name, unary() if peek() in ("(", "~", "forall", "exists") else level(0))
        if token == "(":
            inner = level(0)
            take(")")
            return inner
        if peek() == "(":
            take()
            args = [take()]
            while peek() == ",":
                take()
                args.append(take())
            take(")")
            return (token, *args)
        return (token,)

    out = level(0)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]}")
    return out


@udtf(returnType="depth: int, position: int, head: string, arguments: array<string>")
class SexprNodes:
    """One row for every list of an s-expression, outer ones first; none for a text that doesn't parse."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            queue = [(0, n) for n in parse_sexpr(text or "") if isinstance(n, list)]
        except ValueError:
            return
        position = 0
        while queue:
            depth, node = queue.pop(0)
            atoms = [a for a in node if isinstance(a, str)]
            yield depth, position, atoms[0] if atoms else None, atoms[1:]
            position += 1
            queue += [(depth + 1, n) for n in node if isinstance(n, list)]


@udtf(returnType="kind: string, name: string, line: int, calls: array<string>")
class CodeNodes:
    """One row for every function and class of Python code, with what it calls; none for code that doesn't parse."""

    def eval(self, code: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(code or "")
        except SyntaxError:
            return
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                called = [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
                yield "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, sorted(set(called))


_BIND = {"<->": 1, "->": 2, "|": 3, "&": 4, "~": 5}


def write_formula(formula: tuple, outer: int = 0) -> str:
    """The text of a formula in ASCII with the fewest brackets; parse_formula reads it back."""
    op = formula[0]
    if op in ("forall", "exists"):
        text = f"{op} {formula[1]} ({write_formula(formula[2])})"
        return f"({text})" if outer else text
    if op == "~":
        return "~" + write_formula(formula[1], 5)
    if op in _BIND:
        k = _BIND[op]
        # -> groups to the right, the others to the left
        left, right = (k + 1, k) if op == "->" else (k, k + 1)
        text = f"{write_formula(formula[1], left)} {op} {write_formula(formula[2], right)}"
        return f"({text})" if k < outer else text
    return f"{op}({', '.join(formula[1:])})" if len(formula) > 1 else op


def formula_nodes(formula: tuple) -> Iterator[tuple[int, int | None, str, list[str]]]:
    """number, parent, operator or predicate, arguments of every part, from the whole on."""
    stack, k = [(formula, None)], 0
    while stack:
        part, parent = stack.pop(0)
        deeper = [x for x in part[1:] if isinstance(x, tuple)]
        yield k, parent, part[0], [x for x in part[1:] if isinstance(x, str)]
        stack += [(x, k) for x in deeper]
        k += 1


@udtf(returnType="number: int, parent: int, op: string, arguments: array<string>")
class FormulaNodes:
    """One row for every part of a first-order formula; none for a text that doesn't parse."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            yield from formula_nodes(parse_formula(text or ""))
        except ValueError:
            return


@udtf(returnType="src: string, rel: string, dst: string")
class CodeGraph:
    """Edges of Python code: what a module, class or function defines, what it calls, imports and inherits; none for code that doesn't parse."""

    def eval(self, name: str, code: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(code or "")
        except SyntaxError:
            return
        yield from _code_edges(tree, name or "module")


def _code_edges(node: ast.AST, owner: str) -> Iterator[tuple[str, str, str]]:
    for child in ast.iter_child_nodes(node):
        inner = owner
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{owner}.{child.name}"
            yield owner, "DEFINES", inner
            for base in getattr(child, "bases", []):
                yield inner, "INHERITS", ast.unparse(base)
        elif isinstance(child, ast.Call):
            yield owner, "CALLS", ast.unparse(child.func)
        elif isinstance(child, (ast.Import, ast.ImportFrom)):
            for alias in child.names:
                yield owner, "IMPORTS", ".".join(filter(None, [getattr(child, "module", None), alias.name]))
        yield from _code_edges(child, inner)
