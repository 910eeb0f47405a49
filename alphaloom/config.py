"""Settings, with the values in force unless a JSON file says otherwise. The defaults are fixed values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Backtest:
    cost_bps: float = 5.0
    holding_days: int = 5
    long_pct: float = 0.2
    short_pct: float = 0.2
    lookback_min_days: int = 252
    n_quantiles: int = 5  # shown in reports only
    universe: str = "000300"
    start_date: str = "20240101"
    end_date: str = "20251231"
    exclude_st: bool = True


@dataclass(frozen=True)
class Classification:
    coverage_min: float = 0.10
    overfit_sharpe: float = 3.0
    overfit_ic: float = 0.01
    unstable_ratio: float = 20.0
    duplicate_corr: float = 0.85
    weak_sharpe: float = 0.3
    weak_ic: float = 0.02
    weak_icir: float = 0.3
    promising_ic: float = 0.01
    promising_icir: float = 0.05
    promising_sharpe: float = 0.3
    promising_turnover: float = 0.85
    promising_coverage: float = 0.25


@dataclass(frozen=True)
class Selection:
    min_parents: int = 2
    max_parents: int = 3
    max_corr: float = 0.7
    relaxed: tuple[float, ...] = (0.85, 0.95)


@dataclass(frozen=True)
class Tags:
    high_sharpe: float = 0.5
    low_sharpe_abs: float = 0.2
    high_ic_abs: float = 0.02
    low_ic_abs: float = 0.01
    high_turnover: float = 0.85
    low_turnover: float = 0.5
    high_drawdown: float = -0.5


@dataclass(frozen=True)
class Transforms:
    min_per_parent: int = 5
    max_per_parent: int = 5
    max_candidates: int = 12
    high_turnover: float = 0.8
    low_turnover: float = 0.3
    flip_sharpe: float = -0.3


@dataclass(frozen=True)
class Stopping:
    max_iterations: int = 10
    stall_iterations: int = 3
    stall_range: float = 0.001
    diminishing: float = 0.02
    worth_keeping: float = 0.3


@dataclass(frozen=True)
class Validation:
    max_length: int = 500
    max_depth: int = 5
    max_calls: int = 15
    min_window: int = 2
    max_window: int = 252
    max_exponent: float = 5.0


@dataclass(frozen=True)
class Config:
    backtest: Backtest = field(default_factory=Backtest)
    classification: Classification = field(default_factory=Classification)
    selection: Selection = field(default_factory=Selection)
    tags: Tags = field(default_factory=Tags)
    transforms: Transforms = field(default_factory=Transforms)
    stopping: Stopping = field(default_factory=Stopping)
    validation: Validation = field(default_factory=Validation)


def load(path: str) -> Config:
    """A Config from a JSON file of {section: {setting: value}}; what it doesn't name keeps its default, what isn't a setting is an error."""
    with open(path, encoding="utf-8-sig") as f:
        given = json.load(f)
    config = Config()
    for section, values in given.items():
        if section not in {x.name for x in fields(Config)}:
            raise ValueError(f"no section {section!r}")
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        config = replace(config, **{section: replace(getattr(config, section), **values)})
    return config
