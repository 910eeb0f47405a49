import pytest

from alphaloom.operators.variants import Parent, choose, generate, infer_transform, read_suggestions, rewrite
from alphaloom.plans.expr import ExpressionError, parse, text


@pytest.mark.parametrize("formula", ["rank(delta(close, 5))", "-(close - ts_mean(close, 20)) / ts_std(close, 20)", "(2 - close) ** 2 - (3 - (low - high))", "clip(close, -3, 3) * -1", "close ** (-2)"])
def test_text_is_parsed_back(formula):
    assert parse(text(parse(formula))) == parse(formula)


@pytest.mark.parametrize("formula", ["close.shift(-1)", "delay(close, 0 - 1)", "delay(close, n=1)", "foo(close)", "price", "close > 1", "ts_mean(close, open)", "(close, 1)", "__import__('os')", "ts_mean(close)", "rank("])
def test_what_is_not_of_the_language(formula):
    with pytest.raises(ExpressionError):
        parse(formula)


def test_rewrites():
    assert rewrite("rank(close)", "flip-sign") == "-rank(close)"
    assert rewrite("delta(high, 5) - delta(low, 5)", "adjust-lookback") == "delta(high, 10) - delta(low, 10)"
    assert rewrite("ts_rank(close, 10)", "adjust-normalization") == "rank(ts_rank(close, 10))"
    assert rewrite("scale(close, 2)", "adjust-normalization") == "zscore(close)"
    assert rewrite("decay_linear(close, 20)", "adjust-smoothing") == "close"
    assert rewrite("close", "simplify") is None
    assert infer_transform("rank(close)", "ts_mean(rank(close), 20)") == "reduce-turnover"


def test_choice_and_generation():
    weak = Parent("Bad one", "rank(close)", sharpe=-1.0, turnover=0.9)
    assert choose(weak)[:3] == ["flip-sign", "reduce-turnover", "adjust-smoothing"]
    specs = generate([weak, Parent("other", "ts_mean(volume, 5)")])
    assert len({s["name"] for s in specs}) == len(specs) <= 12
    assert specs[-1]["transformation"] == "combine-factors"
    assert all(parse(s["expression"]) for s in specs)


def test_suggestions():
    got = read_suggestions('[{"parent": "p", "expression": "close", "rank": 2}, {"expression": "bad(", "rank": 1}, {"name": "New", "expression": "rank(low)", "transformation": "custom", "rank": 3}]', [Parent("p", "close")])
    assert [s["expression"] for s in got] == ["rank(low)"]
