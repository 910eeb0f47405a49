"""Checks of formulas: what can be said from the tree, and what a small panel shows."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.config import Validation
from alphaloom.plans.compile import evaluate
from alphaloom.plans.expr import FUNCTIONS, LAGS, ExpressionError, calls, parse, walk


@dataclass
class Checked:
    name: str
    expression: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    eval_time_ms: float = 0.0

    @property
    def ok(self) -> bool:
        return not self.errors


def parentheses(expression: str) -> int:
    """How deep parentheses nest."""
    return max(accumulate(((c == "(") - (c == ")") for c in expression), initial=0))


def static(name: str, expression: str, config: Validation = Validation()) -> Checked:
    """Errors: what isn't of the language, windows that look ahead. Warnings: long, deep or busy formulas, odd windows, high powers."""
    out = Checked(name, expression)
    try:
        node = parse(expression)
    except ExpressionError as e:
        out.errors.append(str(e))
        return out
    for what, n, most in (("length", len(expression), config.max_length), ("nesting", parentheses(expression), config.max_depth), ("calls", calls(node), config.max_calls)):
        if n > most:
            out.warnings.append(f"{what} {n} exceeds {most}")
    for part in walk(node):
        if part.kind != "call":
            continue
        for arg, kind in zip(part.args, FUNCTIONS[part.name][0], strict=True):
            if kind == "n" and (arg.value > config.max_window or arg.value < config.min_window and part.name not in LAGS):
                out.warnings.append(f"{part.name}: window {int(arg.value)} is outside {config.min_window} to {config.max_window}")
        if part.name in ("power", "signed_power") and abs(part.args[1].value) > config.max_exponent:
            out.warnings.append(f"{part.name}: exponent {part.args[1].value:g}")
    return out


def complexity(factors: DataFrame) -> DataFrame:
    """factor, length, n_calls and depth (how deep parentheses nest) of factors (factor, expression)."""
    step = lambda acc, c: F.struct((acc["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(c == "(", 1).otherwise(0)).alias("most"))
    depth = F.aggregate(F.split("expression", ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    return factors.select("factor", F.length("expression").alias("length"), F.regexp_count("expression", F.lit(r"[a-z_0-9]+\(")).alias("n_calls"), depth.alias("depth"))


def numeric_shares(grid: DataFrame, factors: dict[str, str]) -> DataFrame:
    """factor, missing and infinite (shares of cells) and huge (share of values over 1e6 in size), of all factors in one job."""
    wide = evaluate(grid, factors, told=True)
    ends = lambda f: F.col(f"`{f} infinite`")
    each = [F.struct(F.lit(f).alias("factor"), F.avg((F.col(f).isNull() & ~ends(f)).cast("double")).alias("missing"), F.avg(ends(f).cast("double")).alias("infinite"), F.coalesce(F.avg((F.abs(F.col(f)) > 1e6).cast("double")), F.lit(0.0)).alias("huge")) for f in factors]
    return wide.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def validate(grid: DataFrame, specs: list[dict], config: Validation = Validation()) -> list[Checked]:
    """Every spec, in order; those that parse are computed together on grid, a small panel. At most half of the values may be missing, a tenth infinite, and a tenth huge."""
    out = [static(s["name"], s["expression"], config) for s in specs]
    good = {f"f{i}": c.expression for i, c in enumerate(out) if c.ok}
    began = time.perf_counter()
    rows = numeric_shares(grid, good).collect() if good else []
    # One job evaluates all formulas; a formula is charged its share.
    each = 1000 * (time.perf_counter() - began) / max(1, len(good))
    for row in rows:
        checked = out[int(row["factor"][1:])]
        checked.eval_time_ms = round(each, 1)
        if row["missing"] + row["infinite"] >= 1:
            checked.errors.append("no values")
        elif row["missing"] > 0.5:
            checked.errors.append(f"{row['missing']:.0%} of values are missing")
        if row["infinite"] > 0.1:
            checked.errors.append(f"{row['infinite']:.0%} of values are infinite")
        if row["huge"] > 0.1:
            checked.errors.append(f"{row['huge']:.0%} of values exceed 1e6")
    return out


def passed(specs: list[dict], results: list[Checked]) -> list[dict]:
    keys = ("name", "expression", "description", "rationale", "generation", "parent", "transformation")
    return [{k: s.get(k) for k in keys} for s, r in zip(specs, results, strict=True) if r.ok]


def batch_summary(results: list[Checked]) -> dict:
    """How many formulas were checked, passed and failed, and what was found of each."""
    return {"total": len(results), "passed": sum(r.ok for r in results), "failed": sum(not r.ok for r in results), "results": [asdict(r) | {"ok": r.ok} for r in results]}


def correction_prompt(results: list[Checked]) -> str:
    """What to tell the author of formulas that failed; empty if none did."""
    bad = [r for r in results if not r.ok]
    return "\n".join(["These factors failed; correct and return them:", *(f"- {r.name}: {r.expression}\n  " + "\n  ".join(r.errors) for r in bad)]) if bad else ""
