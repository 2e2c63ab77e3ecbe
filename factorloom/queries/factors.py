"""One query for each family of the factor language, over six-hour bars of events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import NORM_WINDOW, compile_factors
from ..plans.longseries import compile_long_factors
from ..sources.tables import load
from .common import BASE, SIX_HOURS, bars, base_cte, frame, lagged, most_bars, over, presented, rounded, running, sql_round, tidy


@dataclass
class Family:
    """``calls``: column -> expression; ``sql``: column -> raw value over ``base`` and the ``stages`` before it; ``tables``:
    more common tables, each joined by (symbol, rn)."""

    calls: dict[str, str]
    sql: dict[str, str] = field(default_factory=dict)
    stages: list[dict[str, str]] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    joined: list[str] = field(default_factory=list)
    normalised: bool = True
    long_frames: bool = True
    seconds: int = SIX_HOURS

    def query(self) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(compile_factors(bars(spark, sf_dir, self.seconds), self.calls, long_frames=self.long_frames, longest=most_bars(spark, sf_dir, self.seconds)), list(self.calls))

        return run

    def text(self) -> str:
        parts, last = [base_cte(self.seconds), *self.tables], "base"
        for k, stage in enumerate(self.stages):
            parts.append(f"stage{k} AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in stage.items())} FROM {last})")
            last = f"stage{k}"
        joins = "".join(f" LEFT JOIN {t} USING (symbol, rn)" for t in self.joined)
        values = ", ".join(f"{v} AS x_{n}" for n, v in self.sql.items())
        parts.append(f"raw AS (SELECT symbol, bar, {values} FROM {last}{joins})")
        parts.append("kept AS (SELECT symbol, bar, " + ", ".join(f"{tidy(f'x_{n}')} AS x_{n}" for n in self.sql) + " FROM raw)")
        if self.normalised:
            devs = ", ".join(f"stddev_samp(x_{n}) OVER {frame(NORM_WINDOW - 1)} AS s_{n}" for n in self.sql)
            parts.append(f"dev AS (SELECT *, {devs} FROM kept)")
            out = ", ".join(f"{sql_round(f'CASE WHEN s_{n} > 0 THEN x_{n} / s_{n} ELSE 0 END')} AS {n}" for n in self.sql)
        else:
            parts.append("dev AS (SELECT * FROM kept)")
            out = ", ".join(f"{sql_round(f'x_{n}')} AS {n}" for n in self.sql)
        recursive = "RECURSIVE " if self.tables else ""
        return f"WITH {recursive}{', '.join(parts)} SELECT symbol, bar, {out} FROM dev"


def gate(x: str, rows: int) -> str:
    return f"CASE WHEN rn >= {rows} THEN {x} ELSE 0.0 END"


def _each(prefix: str, periods: tuple[int, ...], args: str, sql: Callable[[int], str] | None = None, column: str | None = None, **more) -> Family:
    calls = {f"{column or prefix.lower()}_{t}": f"{prefix}_{t}({args})" for t in periods}
    values = {f"{column or prefix.lower()}_{t}": sql(t) for t in periods} if sql else {}
    return Family(calls, values, **more)


def _lists(periods: tuple[int, ...], x: str = "c") -> list[dict[str, str]]:
    """Stages with the list, least and greatest of each frame."""
    first = {}
    for t in periods:
        first |= {f"v{t}": over(f"list({x})", t), f"lo{t}": over(f"min({x})", t), f"hi{t}": over(f"max({x})", t)}
    return [first]


def _before(periods: tuple[int, ...], x: str, pick: str) -> list[dict[str, str]]:
    stage = {}
    for t in periods:
        w = frame(t, "1 PRECEDING")
        stage |= {f"v{t}": f"list({x}) OVER {w}", f"m{t}": f"{pick}({x}) OVER {w}"}
    return [stage]


def ema_tables(name: str, source: str, x: str, t: int, k: str, first: int) -> list[str]:
    """Tables ending in ``name`` (symbol, rn, e): recursion from the mean of the first ``t`` values at or after row ``first``."""
    return [
        f"{name}_s AS (SELECT symbol, rn, {x} AS x, avg({x}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW) AS seed "
        f"FROM {source} WHERE rn >= {first})",
        f"{name} AS (SELECT symbol, rn, seed AS e FROM {name}_s WHERE rn = {first + t - 1} UNION ALL "
        f"SELECT s.symbol, s.rn, p.e + {k} * (s.x - p.e) FROM {name} p JOIN {name}_s s ON s.symbol = p.symbol AND s.rn = p.rn + 1)",
    ]


def wilder_sum_tables(name: str, source: str, x: str, t: int) -> list[str]:
    """(symbol, rn, e): t-1 values from row 2 on added up, then a t-th part leaves for each that comes."""
    return [
        f"{name}_s AS (SELECT symbol, rn, {x} AS x, sum({x}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {t - 2} PRECEDING AND CURRENT ROW) AS seed "
        f"FROM {source} WHERE rn >= 2)",
        f"{name} AS (SELECT symbol, rn, seed AS e FROM {name}_s WHERE rn = {t} UNION ALL "
        f"SELECT s.symbol, s.rn, p.e - p.e / {t} + s.x FROM {name} p JOIN {name}_s s ON s.symbol = p.symbol AND s.rn = p.rn + 1)",
    ]


def stop_tables(name: str, start: float = 0.02, more: float = 0.02, most: float = 0.2) -> list[str]:
    """``name`` (symbol, rn, rising, e): parabolic stops. The row before the second bar holds the state to begin with."""
    outside = lambda x: f"CASE WHEN rising THEN least({x}, l0, l) ELSE greatest({x}, h0, h) END"
    return [
        f"{name}_d AS (SELECT symbol, rn, h, l, CASE WHEN rn = 2 THEN h ELSE {lagged('h')} END AS h0, CASE WHEN rn = 2 THEN l ELSE {lagged('l')} END AS l0, {lagged('h')} AS hp, {lagged('l')} AS lp FROM base)",
        f"{name}_1 AS (SELECT symbol, h, l, hp, lp, NOT (lp - l > 0 AND h - hp < lp - l) AS rising FROM {name}_d WHERE rn = 2)",
        f"{name} AS (SELECT symbol, CAST(1 AS BIGINT) AS rn, rising, CASE WHEN rising THEN lp ELSE hp END AS stop, CASE WHEN rising THEN h ELSE l END AS extreme, CAST({start} AS DOUBLE) AS speed, CAST(NULL AS DOUBLE) AS e FROM {name}_1 UNION ALL "
        f"SELECT symbol, rn, rising, {outside('held + speed * (extreme - held)')}, extreme, speed, held FROM ("
        f"SELECT symbol, rn, rising, h, l, h0, l0, CASE WHEN crossed THEN {outside('extreme')} ELSE stop END AS held, "
        f"CASE WHEN crossed THEN {start} WHEN (rising AND h > extreme) OR (NOT rising AND l < extreme) THEN least(speed + {more}, {most}) ELSE speed END AS speed, "
        f"CASE WHEN crossed OR (rising AND h > extreme) OR (NOT rising AND l < extreme) THEN CASE WHEN rising THEN h ELSE l END ELSE extreme END AS extreme FROM ("
        f"SELECT d.symbol, d.rn, d.h, d.l, d.h0, d.l0, s.stop, s.extreme, s.speed, CASE WHEN s.rising THEN d.l <= s.stop ELSE d.h >= s.stop END AS crossed, "
        f"s.rising <> CASE WHEN s.rising THEN d.l <= s.stop ELSE d.h >= s.stop END AS rising FROM {name} s JOIN {name}_d d ON d.symbol = s.symbol AND d.rn = s.rn + 1)))",
    ]


def _picked(tables: list[str], values: dict[str, str]) -> tuple[list[str], list[str]]:
    """A last table for each value (a query with columns symbol, rn, e), renamed for the join."""
    return [*tables, *[f"j_{n} AS (SELECT symbol, rn, e AS e_{n} FROM ({q}))" for n, q in values.items()]], [f"j_{n}" for n in values]


def _recursive(calls: dict[str, str], tables: list[str], values: dict[str, str]) -> Family:
    more, joined = _picked(tables, values)
    return Family(calls, {n: f"e_{n}" for n in values}, tables=more, joined=joined)


def _ema_family(prefix: str, periods: tuple[int, ...], combine: Callable[[int], str], depth: int) -> Family:
    tables, values = [], {}
    for t in periods:
        k = f"(2.0 / {t + 1})"
        tables += ema_tables(f"a{t}", "base", "c", t, k, 1)
        if depth > 1:
            tables += ema_tables(f"b{t}", f"a{t}", "e", t, k, t)
        if depth > 2:
            tables += ema_tables(f"d{t}", f"b{t}", "e", t, k, 2 * t - 1)
        values[f"{prefix}_{t}"] = combine(t)
    return _recursive({n: f"{n}(c)" for n in values}, tables, values)


def _join(t: int, *names: str) -> str:
    out = f"{names[0]}{t} x0"
    for i, n in enumerate(names[1:], 1):
        out += f" JOIN {n}{t} x{i} ON x{i}.symbol = x0.symbol AND x{i}.rn = x0.rn"
    return out


MOVES = f"moves AS (SELECT symbol, rn, greatest(c - {lagged('c')}, 0) AS up, greatest({lagged('c')} - c, 0) AS down FROM base)"
RANGES = (
    f"ranges0 AS (SELECT symbol, rn, h, l, c, h - {lagged('h')} AS up, {lagged('l')} - l AS down, greatest(h - l, abs(h - {lagged('c')}), abs(l - {lagged('c')})) AS tr FROM base), "
    "ranges AS (SELECT symbol, rn, c, tr, CASE WHEN up > 0 AND up > down THEN up ELSE 0 END AS plus, CASE WHEN down > 0 AND up < down THEN down ELSE 0 END AS minus FROM ranges0)"
)


def _moves_family(prefix: str, periods: tuple[int, ...], top: str) -> Family:
    tables, values = [MOVES], {}
    for t in periods:
        tables += ema_tables(f"u{t}", "moves", "up", t, f"(1.0 / {t})", 2) + ema_tables(f"v{t}", "moves", "down", t, f"(1.0 / {t})", 2)
        values[f"{prefix}_{t}"] = f"SELECT x0.symbol, x0.rn, CASE WHEN x0.e + x1.e = 0 THEN 0 ELSE 100 * ({top}) / (x0.e + x1.e) END AS e FROM {_join(t, 'u', 'v')}"
    return _recursive({n: f"{n}(c)" for n in values}, tables, values)


def _direction_tables(periods: tuple[int, ...]) -> list[str]:
    tables = [RANGES]
    for t in periods:
        for n, x in (("p", "plus"), ("m", "minus"), ("r", "tr")):
            tables += wilder_sum_tables(f"{n}{t}", "ranges", x, t)
        tables.append(
            f"di{t} AS (SELECT x0.symbol, x0.rn, 100 * x0.e / x2.e AS plus, 100 * x1.e / x2.e AS minus FROM {_join(t, 'p', 'm', 'r')} WHERE x0.rn > {t})"
        )
        tables.append(f"dx{t} AS (SELECT symbol, rn, CASE WHEN plus + minus = 0 THEN 0 ELSE 100 * abs(plus - minus) / (plus + minus) END AS e FROM di{t})")
        tables += ema_tables(f"adx{t}", f"dx{t}", "e", t, f"(1.0 / {t})", t + 1)
    return tables


def _direction_family(prefix: str, value: Callable[[int], str], args: str = "h, l, c", periods: tuple[int, ...] = (14, 25)) -> Family:
    values = {f"{prefix}_{t}": value(t) for t in periods}
    return _recursive({n: f"{n}({args})" for n in values}, _direction_tables(periods), values)


def _range_family(prefix: str, value: Callable[[int], str], periods: tuple[int, ...] = (14, 25)) -> Family:
    tables = [RANGES]
    for t in periods:
        tables += ema_tables(f"atr{t}", "ranges", "tr", t, f"(1.0 / {t})", 2)
    values = {f"{prefix}_{t}": value(t) for t in periods}
    return _recursive({n: f"{n}(h, l, c)" for n in values}, tables, values)


def _kama() -> Family:
    tables, values = [], {}
    for t in (8, 21, 55):
        tables += [
            f"k{t}_0 AS (SELECT symbol, rn, c, abs(c - {lagged('c', t)}) AS straight, abs(c - {lagged('c')}) AS step, {lagged('c')} AS before FROM base)",
            f"k{t}_1 AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW) AS walked FROM k{t}_0)",
            f"k{t}_s AS (SELECT symbol, rn, c, before, power(CASE WHEN walked = 0 OR straight >= walked THEN 1 ELSE straight / walked END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS speed FROM k{t}_1)",
            f"k{t} AS (SELECT symbol, rn, before + speed * (c - before) AS e FROM k{t}_s WHERE rn = {t + 1} UNION ALL "
            f"SELECT s.symbol, s.rn, p.e + s.speed * (s.c - p.e) FROM k{t} p JOIN k{t}_s s ON s.symbol = p.symbol AND s.rn = p.rn + 1)",
        ]
        values[f"ta_kama_{t}"] = f"SELECT symbol, rn, e FROM k{t}"
    return _recursive({n: f"{n}(c)" for n in values}, tables, values)


def _long_averages() -> Family:
    """Triple means of 55 bars begin at bar 163, so they take hourly bars."""
    a, b, d = (ema_tables(n, source, x, 55, "(2.0 / 56)", first) for n, source, x, first in (("a55", "base", "c", 1), ("b55", "a55", "e", 55), ("d55", "b55", "e", 109)))
    values = {
        "ta_tema_55": f"SELECT x0.symbol, x0.rn, 3 * x0.e - 3 * x1.e + x2.e AS e FROM {_join(55, 'a', 'b', 'd')}",
        "ta_trix_55": "SELECT symbol, rn, 100 * (e / lag(e) OVER (PARTITION BY symbol ORDER BY rn) - 1) AS e FROM d55",
    }
    family = _recursive({n: f"{n}(c)" for n in values}, [*a, *b, *d], values)
    family.seconds = 3600
    return family


def _slope(t: int) -> str:
    return f"{over('covar_pop(c, CAST(rn AS DOUBLE))', t)} * (12.0 / {t * t - 1})"


def _line(t: int, ahead: float) -> str:
    return f"{over('avg(c)', t)} + ({_slope(t)}) * {ahead}"


_PRICE = {"tp": "(h + l + c) / 3"}
_TP_STEP = {"step": f"tp - {lagged('tp')}"}
_FIVE = (5, 10, 20)
_TEN = (10, 20, 40)
_THREE = (3, 8, 17)
_EIGHT = (8, 21, 55)
_MONTH = (14, 25)
_constant = lambda t, value, other: f"CASE WHEN {over('max(c)', t)} = {over('min(c)', t)} THEN {other} ELSE {value} END"
_return_of = lambda x: f"CASE WHEN abs({lagged(x)}) > 1e-14 THEN ({x} - {lagged(x)}) / {lagged(x)} ELSE 0 END"
_from_end = lambda v, m: f"list_position(list_reverse({v}), {m})"

FAMILIES: dict[str, Family] = {
    "fn_arithmetic": Family(
        {
            "f_add": "add(c, vol)", "f_sub": "sub(c, o)", "f_mul": "mul(c, 0.5)", "f_div": "div(c, sub(h, l))", "f_sqrt": "sqrt(sub(o, c))", "f_log": "log(sub(c, o))",
            "f_neg": "neg(c)", "f_inv": "inv(sub(c, o))", "f_abs": "abs(sub(o, c))", "f_max": "max(o, c)", "f_min": "min(o, c)", "f_sin": "sin(c)", "f_cos": "cos(c)", "f_tan": "tan(div(c, h))",
        },
        {
            "f_add": "c + vol", "f_sub": "c - o", "f_mul": "c * 0.5", "f_div": "CASE WHEN abs(h - l) > 0.001 THEN c / (h - l) ELSE 1 END", "f_sqrt": "sqrt(abs(o - c))",
            "f_log": "CASE WHEN abs(c - o) > 0.001 THEN ln(abs(c - o)) ELSE 0 END", "f_neg": "-c", "f_inv": "CASE WHEN abs(c - o) > 0.001 THEN 1 / (c - o) ELSE 0 END",
            "f_abs": "abs(o - c)", "f_max": "greatest(o, c)", "f_min": "least(o, c)", "f_sin": "sin(c)", "f_cos": "cos(c)", "f_tan": "tan(CASE WHEN abs(h) > 0.001 THEN c / h ELSE 1 END)",
        },
        normalised=False,
    ),
    "fn_activations": Family(
        {"f_sig": "sig(div(c, h))", "f_tanh": "tanh(div(c, h))", "f_elu": "elu(sub(div(c, h), 0.9))"},
        {"f_sig": "1 / (1 + exp(-q))", "f_tanh": "tanh(q)", "f_elu": "CASE WHEN q - 0.9 > 0 THEN q - 0.9 ELSE exp(q - 0.9) - 1 END"},
        [{"q": "CASE WHEN abs(h) > 0.001 THEN c / h ELSE 1 END"}],
    ),
    "fn_ta_bop": Family({"ta_bop": "TA_BOP(o, h, l, c)"}, {"ta_bop": "CASE WHEN h - l > 0 THEN (c - o) / (h - l) ELSE 0 END"}),
    "fn_ta_ad": Family({"ta_ad": "TA_AD(h, l, c, vol)"}, {"ta_ad": running("sum(CASE WHEN h - l > 0 THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END * vol)")}),
    "fn_ta_obv": Family({"ta_obv": "TA_OBV(c, vol)"}, {"ta_obv": running("sum(move)")}, [{"move": f"CASE WHEN {lagged('c')} IS NULL OR c > {lagged('c')} THEN vol WHEN c < {lagged('c')} THEN -vol ELSE 0 END"}]),
    "fn_ta_trange": Family({"ta_trange": "TA_TRANGE(h, l, c)"}, {"ta_trange": f"CASE WHEN {lagged('c')} IS NULL THEN 0 ELSE greatest(h - l, abs(h - {lagged('c')}), abs(l - {lagged('c')})) END"}),
    "fn_ts_cov": _each("TS_COV", (20, 40), "c, vol", lambda t: gate(over("covar_samp(c, vol)", t), t // 2)),
    "fn_ts_corr": _each("TS_CORR", (20, 40), "c, vol", lambda t: gate(f"{over('covar_samp(c, vol)', t)} / nullif({over('stddev_samp(c)', t)} * {over('stddev_samp(vol)', t)}, 0)", t // 2)),
    "fn_ts_day_min": _each("TS_DAY_MIN", _TEN, "c", lambda t: gate(f"{t} + 1 - list_position(v{t}, m{t})", t + 1), stages=_before(_TEN, "c", "min")),
    "fn_ts_day_max": _each("TS_DAY_MAX", _TEN, "c", lambda t: gate(f"{t} + 1 - list_position(v{t}, m{t})", t + 1), stages=_before(_TEN, "c", "max")),
    "fn_ts_sma": _each("ts_sma", _EIGHT, "c", lambda t: gate(over("avg(c)", t), t // 2)),
    "fn_ts_wma": _each("ts_wma", _EIGHT, "c", lambda t: gate(f"list_sum(list_transform(v{t}, lambda v, i: v * i)) / {t * (t + 1) / 2}", t), stages=_lists(_EIGHT)),
    "fn_ts_lag": _each("ts_lag", _THREE, "c", lambda t: f"coalesce({lagged('c', t)}, 0)"),
    "fn_ts_delta": _each("ts_delta", _THREE, "c", lambda t: f"c - coalesce({lagged('c', t)}, 0)"),
    "fn_ts_sum": _each("ts_sum", _THREE, "c", lambda t: gate(over("sum(c)", t), t)),
    "fn_ts_prod": _each("ts_prod", _THREE, "div(c, h)", lambda t: gate(over("product(q)", t), t), stages=[{"q": "CASE WHEN abs(h) > 0.001 THEN c / h ELSE 1 END"}]),
    "fn_ts_std": _each("ts_std", _TEN, "c", lambda t: gate(over("stddev_samp(c)", t), t // 2)),
    "fn_ts_skew": _each("ts_skew", _TEN, "c", lambda t: gate(_constant(t, over("skewness(c)", t), "0"), max(t // 2, 3))),
    "fn_ts_kurt": _each("ts_kurt", _TEN, "c", lambda t: gate(_constant(t, over("kurtosis(c)", t), "-3"), max(t // 2, 4))),
    "fn_ts_min": _each("ts_min", _FIVE, "c", lambda t: gate(over("min(c)", t), t // 2)),
    "fn_ts_max": _each("ts_max", _FIVE, "c", lambda t: gate(over("max(c)", t), t // 2)),
    "fn_ts_range": _each("ts_range", _FIVE, "c", lambda t: gate(f"{over('max(c)', t)} - {over('min(c)', t)}", t // 2)),
    "fn_ts_argmin": _each("ts_argmin", _FIVE, "c", lambda t: gate(f"list_position(v{t}, lo{t})", t), stages=_lists(_FIVE)),
    "fn_ts_argmax": _each("ts_argmax", _FIVE, "c", lambda t: gate(f"list_position(v{t}, hi{t})", t), stages=_lists(_FIVE)),
    "fn_ts_argrange": _each("ts_argrange", _FIVE, "c", lambda t: gate(f"list_position(v{t}, hi{t}) - list_position(v{t}, lo{t})", t), stages=_lists(_FIVE)),
    "fn_ts_rank": _each("ts_rank", _FIVE, "c", lambda t: gate(f"(len(list_filter(v{t}, lambda v: v < c)) + len(list_filter(v{t}, lambda v: v <= c)) + 1) * {5000.0 / t}", t), stages=_lists(_FIVE)),
    "fn_ts_mean_return": _each(
        "ts_mean_return", _FIVE, "c", lambda t: gate(over("avg(ret)", t - 1), t),
        stages=[{"ret": f"CASE WHEN abs(coalesce({lagged('c')}, 0)) > 1e-5 THEN c / {lagged('c')} ELSE 0 END - 1"}],
    ),
    "fn_ta_beta": _each("ta_beta", _FIVE, "c, h", lambda t: gate(f"coalesce({over('covar_pop(ra, rb)', t)} / nullif({over('var_pop(ra)', t)}, 0), 0)", t + 1), stages=[{"ra": _return_of("c"), "rb": _return_of("h")}]),
    "fn_ta_lr_slope": _each("ta_lr_slope", _FIVE, "c", lambda t: gate(_slope(t), t)),
    "fn_ta_lr_intercept": _each("ta_lr_intercept", _FIVE, "c", lambda t: gate(_line(t, -(t - 1) / 2), t)),
    "fn_ta_lr_angle": _each("ta_lr_angle", _FIVE, "c", lambda t: gate(f"degrees(atan({_slope(t)}))", t)),
    "fn_ta_tsf": _each("ta_tsf", _FIVE, "c", lambda t: gate(_line(t, (t + 1) / 2), t)),
    "fn_ta_trima": _each(
        "ta_trima", _EIGHT, "c", lambda t: gate(over(f"avg(i{t})", (t + 1) // 2 if t % 2 else t // 2 + 1), t),
        stages=[{f"i{t}": over("avg(c)", (t + 1) // 2 if t % 2 else t // 2) for t in _EIGHT}],
    ),
    "fn_ta_mom": _each("ta_mom", (12, 25), "c", lambda t: gate(f"c - {lagged('c', t)}", t + 1)),
    "fn_ta_roc": _each("ta_roc", _MONTH, "c", lambda t: gate(f"(c / nullif({lagged('c', t)}, 0) - 1) * 100", t + 1)),
    "fn_ta_rocp": _each("ta_rocp", _MONTH, "c", lambda t: gate(f"(c - {lagged('c', t)}) / nullif({lagged('c', t)}, 0)", t + 1)),
    "fn_ta_rocr": _each("ta_rocr", _MONTH, "c", lambda t: gate(f"c / nullif({lagged('c', t)}, 0)", t + 1)),
    "fn_ta_aroonosc": _each(
        "ta_aroonosc", _MONTH, "h, l", lambda t: gate(f"({_from_end(f'low{t}', f'least{t}')} - {_from_end(f'high{t}', f'most{t}')}) * {100.0 / t}", t + 1),
        stages=[{n: v for t in _MONTH for n, v in ((f"high{t}", over("list(h)", t + 1)), (f"most{t}", over("max(h)", t + 1)), (f"low{t}", over("list(l)", t + 1)), (f"least{t}", over("min(l)", t + 1)))}],
    ),
    "fn_ta_cci": _each(
        "ta_cci", _MONTH, "h, l, c", lambda t: gate(f"(tp - m{t}) / nullif(0.015 * list_sum(list_transform(v{t}, lambda v: abs(v - m{t}))) / {t}, 0)", t),
        stages=[_PRICE, {n: v for t in _MONTH for n, v in ((f"v{t}", over("list(tp)", t)), (f"m{t}", over("avg(tp)", t)))}],
    ),
    "fn_ta_mfi": _each(
        "ta_mfi", _MONTH, "h, l, c, vol", lambda t: gate(f"CASE WHEN up{t} + dn{t} < 1 THEN 0 ELSE 100 * up{t} / (up{t} + dn{t}) END", t + 1),
        stages=[_PRICE, _TP_STEP, {n: v for t in _MONTH for n, v in ((f"up{t}", over("sum(CASE WHEN step > 0 THEN tp * vol ELSE 0 END)", t)), (f"dn{t}", over("sum(CASE WHEN step < 0 THEN tp * vol ELSE 0 END)", t)))}],
    ),
    "fn_ta_willr": _each("ta_willr", _MONTH, "h, l, c", lambda t: gate(f"({over('max(h)', t)} - c) / nullif({over('max(h)', t)} - {over('min(l)', t)}, 0) * -100", t)),
    "fn_ta_ema": _ema_family("ta_ema", _EIGHT, lambda t: f"SELECT symbol, rn, e FROM a{t}", 1),
    "fn_ta_dema": _ema_family("ta_dema", _EIGHT, lambda t: f"SELECT x0.symbol, x0.rn, 2 * x0.e - x1.e AS e FROM {_join(t, 'a', 'b')}", 2),
    "fn_ta_tema": _ema_family("ta_tema", (8, 21), lambda t: f"SELECT x0.symbol, x0.rn, 3 * x0.e - 3 * x1.e + x2.e AS e FROM {_join(t, 'a', 'b', 'd')}", 3),
    "fn_ta_trix": _ema_family("ta_trix", (8, 21), lambda t: f"SELECT symbol, rn, 100 * (e / lag(e) OVER (PARTITION BY symbol ORDER BY rn) - 1) AS e FROM d{t}", 3),
    "fn_ta_kama": _kama(),
    "fn_ta_rsi": _moves_family("ta_rsi", (6, 12, 24), "x0.e"),
    "fn_ta_cmo": _moves_family("ta_cmo", _MONTH, "x0.e - x1.e"),
    "fn_ta_atr": _range_family("ta_atr", lambda t: f"SELECT symbol, rn, e FROM atr{t}"),
    "fn_ta_natr": _range_family("ta_natr", lambda t: f"SELECT a.symbol, a.rn, CASE WHEN c = 0 THEN 0 ELSE 100 * e / c END AS e FROM atr{t} a JOIN ranges USING (symbol, rn)"),
    "fn_ta_minus_dm": _direction_family("ta_minus_dm", lambda t: f"SELECT symbol, rn, e FROM m{t}", "h, l"),
    "fn_ta_minus_di": _direction_family("ta_minus_di", lambda t: f"SELECT symbol, rn, minus AS e FROM di{t}"),
    "fn_ta_dx": _direction_family("ta_dx", lambda t: f"SELECT symbol, rn, e FROM dx{t}"),
    "fn_ta_adx": _direction_family("ta_adx", lambda t: f"SELECT symbol, rn, e FROM adx{t}"),
    "fn_ta_adxr": _direction_family("ta_adxr", lambda t: f"SELECT symbol, rn, (e + lag(e, {t - 1}) OVER (PARTITION BY symbol ORDER BY rn)) / 2 AS e FROM adx{t}"),
    "fn_long_averages": _long_averages(),
    "fn_ta_sar": _recursive({"ta_sar": "TA_SAR(h, l)"}, stop_tables("sar"), {"ta_sar": "SELECT symbol, rn, e FROM sar"}),
    # Held against a plain restatement in the tests instead of SQL.
    "fn_ta_ht": Family({n.lower(): f"{n}(c)" for n in ("TA_HT_DCPERIOD", "TA_HT_DCPHASE", "TA_HT_TRENDLINE")}),
}

NESTED = {
    "deep_a": "sub(ts_sma_8(c), ts_sma_21(c))",
    "deep_b": "div(ts_delta_3(ts_sma_8(c)), ts_std_10(c))",
    "deep_c": "TS_CORR_20(ts_sma_8(c), ts_lag_3(vol))",
    "deep_d": "add(ts_sma_8(c), 0.25)",
}


def nested_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that share subtrees, three levels deep."""
    return presented(compile_factors(bars(spark, sf_dir), NESTED, longest=most_bars(spark, sf_dir)), list(NESTED), digits=5)


def _scaled(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER {frame(NORM_WINDOW - 1)} > 0 THEN {x} / stddev_samp({x}) OVER {frame(NORM_WINDOW - 1)} ELSE 0 END"


NESTED_SQL = f"""WITH {BASE},
a AS (SELECT *, {gate(over('avg(c)', 8), 4)} AS s8, {gate(over('avg(c)', 21), 10)} AS s21, {gate(over('stddev_samp(c)', 10), 5)} AS d10, coalesce({lagged('vol', 3)}, 0) AS g3 FROM base),
b AS (SELECT *, {_scaled('s8')} AS n8, {_scaled('s21')} AS n21, {_scaled('d10')} AS nd, {_scaled('g3')} AS ng FROM a),
d AS (SELECT *, n8 - coalesce({lagged('n8', 3)}, 0) AS e3,
  CASE WHEN rn >= 10 THEN coalesce({over('covar_samp(n8, ng)', 20)} / nullif({over('stddev_samp(n8)', 20)} * {over('stddev_samp(ng)', 20)}, 0), 0) ELSE 0 END AS k FROM b),
f AS (SELECT *, {_scaled('e3')} AS ne, {_scaled('k')} AS nk FROM d)
SELECT symbol, bar, {sql_round('n8 - n21', 5)} AS deep_a, {sql_round('CASE WHEN abs(nd) > 0.001 THEN ne / nd ELSE 1 END', 5)} AS deep_b,
       {sql_round('nk', 5)} AS deep_c, {sql_round('n8 + 0.25', 5)} AS deep_d FROM f"""


def all_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active operator in one plan."""
    from ..functions.registry import active_operators

    args = {1: "c", 2: "h, l", 3: "h, l, c", 4: "h, l, c, vol"}
    calls = {op.name.lower(): f"{op.name}({args[op.arity]})" for op in active_operators()}
    return presented(compile_factors(bars(spark, sf_dir), calls, longest=most_bars(spark, sf_dir)), list(calls))


LONG = {"sma": "ts_sma_8(c)", "std": "ts_std_10(c)", "balance": "TA_OBV(c, c)", "nested": "ts_lag_3(TA_OBV(c, c))"}


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, cut into blocks of about 5000 rows with their halos."""
    ticks = load(spark, sf_dir, "events").select(F.lit("all").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("c"))
    found = compile_long_factors(ticks, LONG, block_rows=5_000)
    return found.select(F.unix_micros("ts").alias("at"), *[rounded(c, 5).alias(c) for c in LONG])


LONG_SQL = f"""WITH t AS (SELECT 'all' AS symbol, epoch_us(ts) AS "at", epoch_us(ts) AS bar, value AS c, row_number() OVER (ORDER BY ts) AS rn FROM events),
a AS (SELECT *, {gate(over('avg(c)', 8), 4)} AS s, {gate(over('stddev_samp(c)', 10), 5)} AS d, CASE WHEN rn = 1 OR c > {lagged('c')} THEN c WHEN c < {lagged('c')} THEN -c ELSE 0 END AS step FROM t),
b AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS line FROM a),
e AS (SELECT *, {_scaled('line')} AS balance FROM b),
g AS (SELECT *, coalesce({lagged('balance', 3)}, 0) AS later FROM e)
SELECT "at", {sql_round(_scaled('s'), 5)} AS sma, {sql_round(_scaled('d'), 5)} AS std, {sql_round('balance', 5)} AS balance, {sql_round(_scaled('later'), 5)} AS nested FROM g"""

FAMILIES["norm_sliding_frames"] = Family({"ts_sma_8": "ts_sma_8(c)"}, {"ts_sma_8": gate(over("avg(c)", 8), 4)}, long_frames=False)

QUERIES = {name: family.query() for name, family in FAMILIES.items()} | {"expression_dag": nested_expressions, "fn_all_active": all_active, "long_series": long_series}
SQL = {name: family.text() for name, family in FAMILIES.items() if family.sql} | {"expression_dag": NESTED_SQL, "long_series": LONG_SQL}
