"""SQL for DuckDB that gives the rows of queries.py, written apart from the Spark code."""

from __future__ import annotations

from alphaloom.plans.expr import FUNCTIONS, Node, parse

PANEL = """
price AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS symbol, l_extendedprice / l_quantity AS price,
         l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
bars AS (
  SELECT date, symbol, arg_min(price, row(l_shipdate, l_orderkey, l_linenumber, price)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, row(l_shipdate, l_orderkey, l_linenumber, price)) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM price GROUP BY ALL),
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
grid AS (
  SELECT date, t, symbol, open, high, low, close, volume, amount
  FROM days CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN bars USING (date, symbol))"""


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_SYM, _CS = "(PARTITION BY symbol ORDER BY t)", "(PARTITION BY date)"


def _enough(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} >= {max(1, n // 2)} THEN {value} END"


def _windowed(name: str, x: list[str], a: list[float]) -> tuple[str, str]:
    """(a column to make before, or nothing; the window's value), over columns x and numbers a. The former is called `pre`."""
    v = x[0] if x else "volume"
    n = int(a[0]) if a and name != "scale" else 0
    w = _frame(n)
    if name == "rank":
        return "", f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({v}) OVER {_CS} END"
    if name == "zscore":
        return "", f"({v} - avg({v}) OVER {_CS}) / CASE WHEN stddev_samp({v}) OVER {_CS} = 0 THEN 1e-8 ELSE stddev_samp({v}) OVER {_CS} END"
    if name == "scale":
        return "", f"{v} / CASE WHEN sum(abs({v})) OVER {_CS} = 0 THEN 1e-8 ELSE sum(abs({v})) OVER {_CS} END * {a[0]}"
    simple = {"ts_mean": "avg", "adv": "avg", "ts_std": "stddev_samp", "ts_max": "max", "ts_min": "min", "ts_sum": "sum"}
    if name in simple:
        return "", _enough(v, n, f"{simple[name]}({v}) OVER {w}")
    if name == "ts_zscore":
        sd = _enough(v, n, f"stddev_samp({v}) OVER {w}")
        return "", f"({v} - {_enough(v, n, f'avg({v}) OVER {w}')}) / CASE WHEN {sd} = 0 THEN 1e-8 ELSE {sd} END"
    if name == "ts_rank":
        seen = f"list_filter(list({v}) OVER {w}, lambda q: q IS NOT NULL)"
        return seen, _enough(v, n, f"CASE WHEN {v} IS NOT NULL THEN (len(list_filter(pre, lambda q: q < {v})) + (len(list_filter(pre, lambda q: q = {v})) + 1) / 2.0) / len(pre) END")
    if name in ("ts_argmax", "ts_argmin"):
        pick = "max" if name == "ts_argmax" else "min"
        return f"{pick}({v}) OVER {w}", _enough(v, n, f"CAST(t - list_min(list_transform(list_filter(list({{'v': {v}, 't': t}}) OVER {w}, lambda q: q.v = pre), lambda q: q.t)) AS DOUBLE)")
    if name in ("correlation", "covariance"):
        both = f"{x[0]} IS NOT NULL AND {x[1]} IS NOT NULL"
        p, q = f"CASE WHEN {both} THEN {x[0]} END", f"CASE WHEN {both} THEN {x[1]} END"
        cov = f"covar_samp({p}, {q}) OVER {w}"
        value = cov if name == "covariance" else f"{cov} / nullif((stddev_samp({p}) OVER {w}) * (stddev_samp({q}) OVER {w}), 0)"
        return "", _enough(p, n, value)
    if name == "decay_linear":
        size = f"least({n}, t)"
        return f"list({v}) OVER {w}", f"CASE WHEN count({v}) OVER {w} = {size} AND {size} >= {max(1, n // 2)} THEN list_sum(list_transform(pre, lambda q, i: q * i)) / ({size} * ({size} + 1) / 2.0) END"
    if name == "delay":
        return "", f"lag({v}, {n}) OVER {_SYM}"
    if name == "delta":
        return "", f"{v} - lag({v}, {n}) OVER {_SYM}"
    if name == "returns":
        return f"last_value({v} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)", f"pre / nullif(lag(pre, {n}) OVER {_SYM}, 0) - 1"
    raise ValueError(name)


_ROWS = {
    "sign": "sign({0})",
    "log": "CASE WHEN {0} > 0 THEN ln({0}) END",
    "abs": "abs({0})",
    "min": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END",
    "max": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END",
    "clip": "CASE WHEN {0} IS NOT NULL THEN greatest({1}, least({2}, {0})) END",
    "power": "CASE WHEN isfinite(pow({0}, {1})) THEN pow({0}, {1}) END",
    "**": "CASE WHEN isfinite(pow({0}, {1})) THEN pow({0}, {1}) END",
    "signed_power": "sign({0}) * pow(abs({0}), {1})",
    "neg": "(-{0})",
    "+": "({0} + {1})",
    "-": "({0} - {1})",
    "*": "({0} * {1})",
    "/": "({0} / nullif({1}, 0))",
}


def rounded(x: str, places: int = 6) -> str:
    """Half away from zero by binary arithmetic."""
    return f"(CASE WHEN {x} >= 0 THEN floor(({x}) * 1e{places} + 0.5) ELSE -floor(-({x}) * 1e{places} + 0.5) END / 1e{places} + 0.0)"


def factors_sql(factors: dict[str, str], carry: str = "") -> str:
    """CTEs ending in `f` (date, t, symbol, carry, one column for each factor): each window and each row expression is a step of its own."""
    steps: list[str] = [PANEL.strip()]
    made: dict[Node, str] = {}
    source = "grid"

    def add(value: str, name: str) -> str:
        nonlocal source
        steps.append(f"{name}_ AS (SELECT *, {value} AS {name} FROM {source})")
        source = f"{name}_"
        return name

    def visit(node: Node) -> str:
        if node.kind == "field":
            return node.name
        if node.kind == "number":
            return f"CAST({node.value!r} AS DOUBLE)"
        if node not in made:
            args = [visit(a) for a in node.args]
            if node.kind == "call" and FUNCTIONS[node.name][2] != "row":
                kinds = FUNCTIONS[node.name][0]
                x = [a for a, k in zip(args, kinds, strict=True) if k == "x"]
                pre, value = _windowed(node.name, x, [a.value for a, k in zip(node.args, kinds, strict=True) if k != "x"])
                n = len(made)
                if pre:
                    value = value.replace("pre", add(pre, f"p{n}")) if node.name != "decay_linear" else value.replace("(pre,", f"({add(pre, f'p{n}')},")
                made[node] = add(value, f"w{n}")
            else:
                made[node] = add(_ROWS[node.name].format(*args), f"r{len(made)}")
        return made[node]

    columns = [f"CAST({visit(parse(e))} AS DOUBLE) AS {name}" for name, e in factors.items()]
    steps.append(f"f AS (SELECT date, t, symbol, {carry}{', '.join(columns)} FROM {source})")
    return "WITH " + ",\n".join(steps)


def value_sql(expression: str) -> str:
    return f"{factors_sql({'value': expression})}\nSELECT date, symbol, {rounded('value')} AS value FROM f"


def backtest_sql(factors: dict[str, str], h: int, cost: float, long_pct: float, short_pct: float) -> str:
    """CTEs of a backtest: s (scores), legs, periods, turn, dd, ics."""
    base = factors_sql(factors, "close, ")
    union = " UNION ALL ".join(f"SELECT '{n}' AS factor, date, t, symbol, close, fwd, {n} AS score FROM ff" for n in factors)
    return f"""{base},
pad AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS pc FROM f),
ff AS (SELECT *, lead(pc, {h}) OVER (PARTITION BY symbol ORDER BY t) / nullif(pc, 0) - 1 AS fwd FROM pad),
s AS ({union}),
cal AS (SELECT date, t FROM days WHERE (t - 1) % {h} = 0 AND t < (SELECT max(t) FROM days WHERE (t - 1) % {h} = 0)),
uni AS (SELECT factor, count(*) AS n_symbols, CAST(greatest(1, floor(count(*) * {long_pct})) AS INTEGER) AS n_long,
               CAST(greatest(1, floor(count(*) * {short_pct})) AS INTEGER) AS n_short
        FROM (SELECT factor, symbol FROM s GROUP BY ALL HAVING count(score) > 0 AND count(close) > 0) GROUP BY factor),
ranked AS (SELECT s.*, n_long, n_short, count(*) OVER (PARTITION BY factor, date) AS n,
                  row_number() OVER (PARTITION BY factor, date ORDER BY score DESC, symbol) AS hi,
                  row_number() OVER (PARTITION BY factor, date ORDER BY score, symbol) AS lo
           FROM s JOIN cal USING (date, t) JOIN uni USING (factor) WHERE score IS NOT NULL),
legs AS (SELECT factor, date, t, 'long' AS side, hi AS place, symbol, score, fwd FROM ranked WHERE n >= n_long + n_short AND hi <= n_long
         UNION ALL SELECT factor, date, t, 'short', lo, symbol, score, fwd FROM ranked WHERE n >= n_long + n_short AND lo <= n_short),
periods AS (SELECT factor, date, t, avg(fwd) FILTER (side = 'long') AS long_return, avg(fwd) FILTER (side = 'short') AS short_return,
                   avg(fwd) FILTER (side = 'long') - avg(fwd) FILTER (side = 'short') - {cost} / 10000 * 4 AS period_return, list(DISTINCT symbol) AS names
            FROM legs GROUP BY factor, date, t HAVING count(fwd) > 0),
turn AS (SELECT factor, date, 1 - CAST(len(list_intersect(names, was)) AS DOUBLE) / len(list_distinct(list_concat(names, was))) AS turnover
         FROM (SELECT *, lag(names) OVER (PARTITION BY factor ORDER BY t) AS was FROM periods) WHERE was IS NOT NULL),
cum AS (SELECT factor, date, t, exp(sum(ln(1 + greatest(period_return, -0.99))) OVER (PARTITION BY factor ORDER BY t ROWS UNBOUNDED PRECEDING)) AS cumulative FROM periods),
dd AS (SELECT factor, date, t, cumulative, (cumulative - top) / greatest(top, 1e-8) AS drawdown
       FROM (SELECT *, max(cumulative) OVER (PARTITION BY factor ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM cum)),
rk AS (SELECT factor, date, t, rank() OVER (PARTITION BY factor, date ORDER BY score) + (count(*) OVER (PARTITION BY factor, date, score) - 1) / 2.0 AS x,
              rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS y
       FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT factor, date, t, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic FROM rk GROUP BY ALL
        HAVING count(*) > 10 AND stddev_samp(x) * stddev_samp(y) > 0),
icsum AS (SELECT factor, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, CASE WHEN stddev_pop(ic) > 0 THEN avg(ic) / stddev_pop(ic) ELSE 0.0 END AS icir, count(*) AS n_dates FROM ics GROUP BY factor),
ret AS (SELECT factor, count(*) AS n_periods, avg(period_return) AS m, stddev_pop(period_return) AS sd, product(1 + period_return) - 1 AS total,
               avg(long_return) AS lr, avg(short_return) AS sr FROM periods GROUP BY factor),
summary AS (
  SELECT factor, CAST(NULL AS VARCHAR) AS error, round(m, 6) AS mean_return, round(sd, 6) AS std_return,
         round(CASE WHEN sd > 0 THEN m / sd * sqrt(252.0 / {h}) ELSE 0.0 END, 4) AS sharpe,
         round(CASE WHEN total <= -1 THEN -1.0 ELSE pow(1 + total, 1 / greatest(n_periods * {h} / 252.0, 0.25)) - 1 END, 4) AS annual_return,
         round((SELECT min(drawdown) FROM dd WHERE dd.factor = ret.factor), 4) AS max_drawdown,
         round(coalesce((SELECT avg(turnover) FROM turn WHERE turn.factor = ret.factor), 0.0), 4) AS turnover,
         CAST({long_pct + short_pct} AS DOUBLE) AS coverage, round(coalesce(ic_mean, 0.0), 4) AS ic_mean, round(coalesce(ic_std, 0.0), 4) AS ic_std,
         round(coalesce(icir, 0.0), 4) AS icir, round(lr, 4) AS long_return, round(sr, 4) AS short_return, n_periods
  FROM ret LEFT JOIN icsum USING (factor) WHERE n_periods >= 10)"""
