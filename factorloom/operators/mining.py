"""A whole mining run: bars to samples, an evolution on the training rows, and the table of its factors."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Series
from ..plans.compile import compile_factors
from ..plans.expr import depth, length, parse
from .backtest import factor_table, upsert, with_percent_ranks
from .evolve import EvolveConfig, Evolution
from .features import ACTIVE
from .labels import SampleConfig, samples, with_split
from .metrics import Scoring
from .resample import annual_bars

PRICES = ("o", "h", "l", "c", "vol", "vol_ccy", "trades")


@dataclass(frozen=True)
class MiningConfig:
    """Sampling periods in seconds, times as text, and what to score. ``evolve`` steers the search."""

    sampling: SampleConfig
    train: tuple[str, str]
    test: tuple[str, str]
    evolve: EvolveConfig = EvolveConfig()
    metrics: tuple[str, ...] = ("avg_pic", "avg_sic", "max_dd", "calmar", "sharp")
    features: tuple[str, ...] = (*PRICES, *ACTIVE)

    @classmethod
    def from_dict(cls, raw: dict) -> "MiningConfig":
        """From nested mappings, as a YAML or JSON file gives them. Unknown names are an error."""

        def build(kind: type, values: dict):
            known = {f.name for f in fields(kind)}
            if extra := sorted(set(values) - known):
                raise ValueError(f"{kind.__name__} has no settings {extra}")
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

        parts = dict(raw)
        parts["sampling"] = build(SampleConfig, parts.get("sampling", {}))
        if "evolve" in parts:
            parts["evolve"] = build(EvolveConfig, parts["evolve"])
        return build(cls, parts)

    @classmethod
    def from_yaml(cls, path: str) -> "MiningConfig":
        """From a YAML file; needs PyYAML. A driver-side file: it holds settings, not data."""
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML needs PyYAML; pass the settings to from_dict instead") from missing
        with open(path, encoding="utf-8") as file:
            return cls.from_dict(yaml.safe_load(file) or {})

    @property
    def horizon(self) -> int:
        return self.sampling.step * self.sampling.horizon_steps

    @property
    def scoring(self) -> Scoring:
        return Scoring(periods=annual_bars(self.sampling.step), window=self.sampling.window)


def prepared(bars: DataFrame, config: MiningConfig) -> DataFrame:
    """Samples of both parts; rows between them, whose labels would reach over the edge, are left out."""
    rows = samples(bars, config.sampling)
    return with_split(rows, config.train, config.test, config.horizon).where("split is not null")


def scored(rows: DataFrame, expressions: list[str], config: MiningConfig) -> DataFrame:
    """(expression, symbol, depth, length, order, scores of both parts): factors are computed over all rows in time order
    and scored on each part; labels for correlations, plain returns for results."""
    names = {f"f{k}": text for k, text in enumerate(expressions)}
    frame = compile_factors(rows, names, Series(), config.evolve.norm_window, keep=["split", "ret_rolling_zscore", "return_f"])
    table = factor_table(frame, list(names), list(config.metrics), "ret_rolling_zscore", "return_f", config.scoring)
    trees = {n: parse(text) for n, text in names.items()}
    about = [(n, text, depth(trees[n]), length(trees[n]), k) for k, (n, text) in enumerate(names.items())]
    # One small row for each expression.
    said = rows.sparkSession.createDataFrame(about, "factor string, expression string, depth int, length int, place int")
    return table.join(F.broadcast(said), "factor").drop("factor")


def mine(bars: DataFrame, config: MiningConfig, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """rows, best (the evolution's table), factors (their scores and percentile ranks), and table: ``known`` with the new
    factors added, where an expression that is already there keeps its row."""
    rows = prepared(bars, config)
    train = rows.where("split = 'train'").select("symbol", "ts", *config.features, "ret_rolling_zscore", "return_f")
    run = Evolution(train, list(config.features), "ret_rolling_zscore", config.evolve, "return_f", config.scoring)
    best = run.run()
    factors = scored(rows, [p.text for p in best], config)
    factors = with_percent_ranks(factors, [f"fitness_{m}_train" for m in config.metrics])
    return {"rows": rows, "best": run.table(best), "factors": factors, "table": upsert(known, factors)}
