"""Formulas to columns: all factors together, one column for each distinct window, as few shuffles as their nesting needs.

Every part of a formula is a node; equal parts of different factors are one node and are computed once. Windows over a
symbol's past that are ready are added together, by slices of the history; then those over a date, and so on in turn.
What no later step reads isn't carried on. The number of shuffles is that of windows nested in one another on the
deepest path, whatever the number of factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions import panel
from alphaloom.plans import slices
from alphaloom.plans.expr import FUNCTIONS, Node, parse

KEYS = ("date", "t", "symbol")


class _Plan:
    def __init__(self, roots: dict[str, Node]):
        self.roots = roots
        self.names: dict[Node, str] = {}  # of nodes that are columns by now
        self.flags: dict[Node, str] = {}  # of windows whose value may be infinite: the columns that say so
        self.order: list[Node] = []
        self._collect(roots.values())

    def _collect(self, nodes) -> None:
        seen = set()

        def visit(node: Node) -> None:
            if node in seen:
                return
            seen.add(node)
            for arg in node.args:
                visit(arg)
            if node.kind == "call" and FUNCTIONS[node.name][2] != "row":
                self.order.append(node)

        for node in nodes:
            visit(node)

    def ready(self, node: Node) -> bool:
        """Whether it can be written with the columns there are."""
        if node in self.names or node.kind in ("field", "number"):
            return True
        if node.kind == "call" and FUNCTIONS[node.name][2] != "row":
            return False
        return all(map(self.ready, node.args))

    def column(self, node: Node) -> Column:
        if node in self.names:
            return F.col(self.names[node])
        if node.kind == "field":
            return F.col(node.name)
        if node.kind == "number":
            return F.lit(node.value)
        numbers = node.kind == "call"
        return panel.ROW[node.name](*(a.value if numbers and k == "s" else self.column(a) for a, k in zip(node.args, FUNCTIONS[node.name][0] if numbers else "xx", strict=False)))

    def infinite(self, node: Node) -> Column:
        """Whether the node's value is infinite: by a division of something by zero, the logarithm of zero, a power too large, or an operand that is infinite while none is missing. The value itself is missing then."""
        if node.kind in ("field", "number"):
            return F.lit(False)
        if node in self.names:
            return F.col(self.flags[node]) if node in self.flags else F.lit(False)
        args = [a for a in node.args if a.kind != "number"]
        ends = [self.infinite(a) for a in args]
        missing = lambda a, end: self.column(a).isNull() & ~end
        passed, whole = F.lit(False), F.lit(True)
        for a, end in zip(args, ends, strict=True):
            passed, whole = passed | end, whole & ~missing(a, end)
        x = self.column(node.args[0])
        own = F.lit(False)
        if node.name == "/":
            own = (x != 0) & (self.column(node.args[1]) == 0)
        elif node.name == "log":
            own = x == 0
        elif node.name in ("power", "signed_power", "**"):
            base = F.abs(x) if node.name == "signed_power" else x
            own = F.abs(F.pow(base, self.column(node.args[1]))) == float("inf")
        else:
            own = F.abs(self.column(node)) == float("inf")
        return F.coalesce(own, F.lit(False)) | (passed & whole)

    def read_by(self, nodes) -> set[str]:
        """The columns there are that nodes will read."""
        found: set[str] = set(self.flags.values())
        for node in nodes:
            if node in self.names:
                found.add(self.names[node])
            elif node.kind == "field":
                found.add(node.name)
            else:
                found |= self.read_by(node.args) | ({"volume"} if node.name == "adv" else set())
        return found


def _numbers(node: Node) -> list:
    return [int(a.value) if k == "n" else a.value for a, k in zip(node.args, FUNCTIONS[node.name][0], strict=True) if k != "x"]


def evaluate(grid: DataFrame, factors: dict[str, str | Node], carry: tuple[str, ...] = (), told: bool = False) -> DataFrame:
    """date, t, symbol, the columns of carry, and one double column for each factor, over a dense grid. told: with a column `{factor} infinite` for each, whether a value is missing because it is infinite."""
    plan = _Plan({name: parse(f) if isinstance(f, str) else f for name, f in factors.items()})
    df = grid
    pending = plan.order
    while pending:
        for kind in ("ts", "cs"):
            while batch := [n for n in pending if FUNCTIONS[n.name][2] == kind and all(plan.ready(a) for a in n.args)]:
                pending = [n for n in pending if n not in set(batch)]
                df = _add(df, plan, kind, batch, carry, pending, told)
    roots = [plan.column(node).cast("double").alias(name) for name, node in plan.roots.items()]
    ends = [plan.infinite(node).alias(f"{name} infinite") for name, node in plan.roots.items()] if told else []
    return df.select(*KEYS, *carry, *roots, *ends)


def _add(df: DataFrame, plan: _Plan, kind: str, batch: list[Node], carry: tuple[str, ...], pending: list[Node], told: bool = False) -> DataFrame:
    """One column for each window of the batch, besides what pending ones and the factors read. What a window reads is made a column first, so that it is computed once."""
    inputs: dict[str, Column] = {}
    of: dict[Node, list[str]] = {}
    names: dict[Node, str] = {}
    for node in batch:
        own = ["volume"] if node.name == "adv" else []
        for arg, what in zip(node.args, FUNCTIONS[node.name][0], strict=True):
            if what != "x":
                continue
            if arg in plan.names or arg.kind == "field":
                own.append(plan.names.get(arg, arg.name))
                continue
            if arg not in names:
                names[arg] = f"_i{len(plan.names)}_{len(names)}"
                inputs[names[arg]] = plan.column(arg).cast("double")
            own.append(names[arg])
        of[node] = own
    ends = {}
    if told and kind == "ts":  # lags hand on that a value is infinite; other windows pass over such values
        for node in (n for n in batch if n.name in ("delay", "delta") and n.args[0].kind != "field"):
            ends[node] = f"_e{len(plan.names)}_{len(ends)}"
            inputs[ends[node]] = plan.infinite(node.args[0]).cast("double")
    df = df.withColumns(inputs) if inputs else df
    made = {}
    for node in batch:
        plan.names[node] = f"_w{len(plan.names)}"
        if kind == "cs":
            made[plan.names[node]] = panel.CROSS_SECTION[node.name](*map(F.col, of[node]), *_numbers(node))
        else:
            made[plan.names[node]] = slices.Rolling("ts_mean" if node.name == "adv" else node.name, tuple(of[node]), *_numbers(node))
    if kind == "cs":
        return df.withColumns(made)
    flags: dict[Node, Column] = {}
    for node in batch if told else ():
        n, own = int(_numbers(node)[0]), plan.names[node]
        if node in ends:
            made[f"{own}e"] = slices.Rolling("delay", (ends[node],), n)
            flags[node] = F.coalesce(F.col(f"{own}e") == 1, F.lit(False)) | (F.col(ends[node]) == 1 if node.name == "delta" else F.lit(False))
        elif node.name == "returns":
            made |= {f"{own}b": slices.Rolling("base", tuple(of[node]), n), f"{own}f": slices.Rolling("filled", tuple(of[node]), 0)}
            flags[node] = F.coalesce((F.col(f"{own}b") == 0) & (F.col(f"{own}f") != 0), F.lit(False))
    later = plan.read_by([*pending, *plan.roots.values()]) - set(made)
    read = {c for own in of.values() for c in own} | set(ends.values())
    wanted = {*KEYS, *carry, *later, *read}
    df = df.select(*(F.col(c).cast("double").alias(c) if c in read else c for c in df.columns if c in wanted))
    df = slices.add(df, made)
    plan.flags |= {node: f"{plan.names[node]} infinite" for node in flags}
    return df.withColumns({plan.flags[node]: end for node, end in flags.items()}) if flags else df


def long_form(wide: DataFrame, factors: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """factor, date, t, symbol, the columns of carry, score: a row for each factor and cell."""
    pairs = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("score")) for f in factors))
    return wide.select(*KEYS, *carry, F.explode(pairs).alias("_f")).select("_f.factor", *KEYS, *carry, "_f.score")
