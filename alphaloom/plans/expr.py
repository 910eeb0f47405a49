"""The formula language: six fields, twenty-seven functions, arithmetic and numbers, parsed to hash-consed nodes.

Python's own parser reads the text; only the forms listed here become nodes, so nothing of a formula is ever run.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

#: The fields of a bar, and for each function its parameters (x: formula, n: window, s: number) with those that may be left out, and how its values depend on others (row: none, ts: the symbol's past, cs: the date's symbols).
FIELDS = ("open", "high", "low", "close", "volume", "amount")
FUNCTIONS: dict[str, tuple[str, int, str]] = {
    "rank": ("x", 0, "cs"),
    "zscore": ("x", 0, "cs"),
    "scale": ("xs", 1, "cs"),
    "ts_mean": ("xn", 0, "ts"),
    "ts_std": ("xn", 0, "ts"),
    "ts_max": ("xn", 0, "ts"),
    "ts_min": ("xn", 0, "ts"),
    "ts_sum": ("xn", 0, "ts"),
    "ts_zscore": ("xn", 0, "ts"),
    "ts_rank": ("xn", 0, "ts"),
    "ts_argmax": ("xn", 0, "ts"),
    "ts_argmin": ("xn", 0, "ts"),
    "correlation": ("xxn", 0, "ts"),
    "covariance": ("xxn", 0, "ts"),
    "decay_linear": ("xn", 0, "ts"),
    "adv": ("n", 0, "ts"),
    "delay": ("xn", 0, "ts"),
    "delta": ("xn", 0, "ts"),
    "returns": ("xn", 1, "ts"),
    "sign": ("x", 0, "row"),
    "log": ("x", 0, "row"),
    "abs": ("x", 0, "row"),
    "power": ("xs", 0, "row"),
    "signed_power": ("xs", 0, "row"),
    "min": ("xx", 0, "row"),
    "max": ("xx", 0, "row"),
    "clip": ("xss", 0, "row"),
}
DEFAULTS = {"scale": 1.0, "returns": 1}
LAGS = ("delay", "delta", "returns")
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
_STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "**": 4}


class ExpressionError(ValueError):
    """A formula that isn't of the language; at: the offset in its text."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(f"{message} (at {at})")
        self.at = at


@dataclass(frozen=True)
class Node:
    """kind: field, number, call or op. Equal formulas are equal nodes."""

    kind: str
    name: str
    args: tuple[Node, ...] = ()
    value: float = 0.0

    def __str__(self) -> str:
        return text(self)


def number(value: float) -> Node:
    return Node("number", "", (), float(value))


def parse(formula: str) -> Node:
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"syntax: {e.msg}", (e.offset or 1) - 1) from None
    return _node(tree.body)


def _node(tree: ast.expr) -> Node:
    at = tree.col_offset
    if isinstance(tree, ast.Constant) and isinstance(tree.value, (int, float)) and not isinstance(tree.value, bool):
        return number(tree.value)
    if isinstance(tree, ast.Name):
        if tree.id not in FIELDS:
            raise ExpressionError(f"unknown field {tree.id!r}", at)
        return Node("field", tree.id)
    if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, (ast.USub, ast.UAdd)):
        inner = _node(tree.operand)
        if isinstance(tree.op, ast.UAdd):
            return inner
        return number(-inner.value) if inner.kind == "number" else Node("op", "neg", (inner,))
    if isinstance(tree, ast.BinOp) and type(tree.op) in _BINARY:
        return _folded(Node("op", _BINARY[type(tree.op)], (_node(tree.left), _node(tree.right))), at)
    if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name):
        return _call(tree)
    raise ExpressionError(f"{type(tree).__name__} isn't part of the language", at)


def _folded(node: Node, at: int) -> Node:
    """Arithmetic of numbers is done here, so that a window may be written as one."""
    if any(a.kind != "number" for a in node.args):
        return node
    x, y = (a.value for a in node.args)
    try:
        return number({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "**": lambda: x**y}[node.name]())
    except (ArithmeticError, TypeError):
        raise ExpressionError("arithmetic without a result", at) from None


def _call(tree: ast.Call) -> Node:
    name, at = tree.func.id, tree.col_offset
    if name not in FUNCTIONS:
        raise ExpressionError(f"unknown function {name!r}", at)
    wanted, optional, _ = FUNCTIONS[name]
    if tree.keywords or not len(wanted) - optional <= len(tree.args) <= len(wanted):
        raise ExpressionError(f"{name} takes {len(wanted)} arguments by position", at)
    args = [_node(a) for a in tree.args]
    if len(args) < len(wanted):
        args.append(number(DEFAULTS[name]))
    for kind, arg, given in zip(wanted, args, [*tree.args, tree], strict=False):
        if kind != "x" and arg.kind != "number":
            raise ExpressionError(f"{name}: a number is wanted", given.col_offset)
        if kind == "n" and (arg.value != int(arg.value) or arg.value < 1):
            raise ExpressionError(f"{name}: look-ahead: a window must be a positive whole number" if name in LAGS else f"{name}: a window must be a positive whole number", given.col_offset)
    return Node("call", name, tuple(args))


def walk(node: Node):
    """The node's parts, each before what has it."""
    for arg in node.args:
        yield from walk(arg)
    yield node


def fields_of(node: Node) -> list[str]:
    return sorted({n.name for n in walk(node) if n.kind == "field"} | ({"volume"} if any(n.name == "adv" for n in walk(node)) else set()))


def depth(node: Node) -> int:
    return (node.kind == "call") + max(map(depth, node.args), default=0)


def calls(node: Node) -> int:
    return sum(n.kind == "call" for n in walk(node))


def _number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def text(node: Node) -> str:
    """The formula in one spelling; parse(text(n)) == n."""
    if node.kind == "field":
        return node.name
    if node.kind == "number":
        return _number_text(node.value)
    if node.kind == "call":
        return f"{node.name}({', '.join(map(text, node.args))})"
    mine = _STRENGTH[node.name]

    def part(arg: Node, tight: bool) -> str:
        inner = text(arg)
        weak = arg.kind == "op" and (_STRENGTH[arg.name] < mine or tight and _STRENGTH[arg.name] == mine)
        negative = arg.kind == "number" and arg.value < 0 and (tight or node.name == "**")
        return f"({inner})" if weak or negative else inner

    if node.name == "neg":
        return f"-{part(node.args[0], True)}"
    left, right = node.args
    return f"{part(left, node.name == '**')} {node.name} {part(right, node.name != '**')}"
