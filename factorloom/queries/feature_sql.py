"""SQL of the base features: framed ones as windows, recursive ones as recursive tables."""

from __future__ import annotations

import math

from .common import BASE, frame, lagged, over, running, sql_round, tidy
from .factors import MOVES, ema_tables, gate, stop_tables

NORM = 2000


def _half(x: str, t: int) -> str:
    return gate(x, -(-t // 2))


def _slope(x: str, t: int) -> str:
    return f"{over(f'covar_pop({x}, CAST(rn AS DOUBLE))', t)} * (12.0 / {t * t - 1})"


def _place(x: str, t: int, pick: str) -> str:
    """Place from 1 of the first extreme in a frame."""
    return f"list_position({over(f'list({x})', t)}, {over(f'{pick}({x})', t)})"


def _spread(x: str, t: int) -> str:
    return f"{over(f'max({x})', t)} - {over(f'min({x})', t)}"


def _argrange(x: str, t: int) -> str:
    return _half(f"{_place(x, t, 'max')} - {_place(x, t, 'min')}", t)


def _since(x: str, t: int, pick: str) -> str:
    w = frame(t, "1 PRECEDING")
    return gate(f"{t + 1} - list_position(list({x}) OVER {w}, {pick}({x}) OVER {w})", t + 1)


def _band(side: int) -> str:
    return gate(f"{over('avg(c)', 20)} + {2 * side} * {over('stddev_pop(c)', 20)}", 20)


def _money_flow(t: int) -> str:
    up, down = (over(f"sum(CASE WHEN tp_step {sign} 0 THEN tp * vol ELSE 0 END)", t) for sign in "><")
    return gate(f"CASE WHEN {up} + {down} < 1 THEN 0 ELSE 100 * {up} / ({up} + {down}) END", t + 1)


def _channel(t: int) -> str:
    mean = over("avg(tp)", t)
    return gate(f"(tp - {mean}) / nullif(0.015 * list_sum(list_transform(tp{t}, lambda v: abs(v - tp_mean{t}))) / {t}, 0)", t)


RANGE = f"CASE WHEN {lagged('c')} IS NULL THEN 0 ELSE greatest(h - l, abs(h - {lagged('c')}), abs(l - {lagged('c')})) END"
LINE = running("sum(CASE WHEN h - l > 0 THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END * vol)")
OBV = running("sum(move)")
STAGES = [
    {
        "tp": "(h + l + c) / 3", "move": f"CASE WHEN {lagged('c')} IS NULL OR c > {lagged('c')} THEN vol WHEN c < {lagged('c')} THEN -vol ELSE 0 END",
        "fast_k": f"coalesce((c - {over('min(l)', 9)}) / nullif({over('max(h)', 9)} - {over('min(l)', 9)}, 0) * 100, 0)",
    },
    {"tp_step": f"tp - {lagged('tp')}", "slow_k": over("avg(fast_k)", 3), **{n: v for t in (14, 25, 55) for n, v in ((f"tp{t}", over("list(tp)", t)), (f"tp_mean{t}", over("avg(tp)", t)))}},
]
BOP = "CASE WHEN h - l > 0 THEN (c - o) / (h - l) ELSE 0 END"
FRAMED = {
    "lgp_shortcut_illiq_6": over("avg(2 * (h - l) - abs(c - o))", 6),
    "h_ts_std_10": _half(over("stddev_samp(h)", 10), 10),
    "v_ts_argrange_10": _argrange("vol", 10),
    "c_ts_argrange_10": _argrange("c", 10),
    "c_ts_day_min_40": _since("c", 40, "min"),
    "l_ts_prod_8": _half(over("product(l)", 8), 8),
    "v_ts_std_20": _half(over("stddev_samp(vol)", 20), 20),
    "h_ta_lr_angle_10": gate(f"degrees(atan({_slope('h', 10)}))", 10),
    "v_ts_sma_21": _half(over("avg(vol)", 21), 21),
    "h_ts_kurt_20": gate(f"CASE WHEN {over('max(h)', 20)} = {over('min(h)', 20)} THEN -3 ELSE {over('kurtosis(h)', 20)} END", 10),
    "v_ts_range_5": _half(_spread("vol", 5), 5),
    "c_ts_sma_21": _half(over("avg(c)", 21), 21),
    "o_ts_argmin_10": _half(_place("o", 10, "min"), 10),
    "o_ta_lr_slope_10": gate(_slope("o", 10), 10),
    "l_ts_argmax_20": _half(_place("l", 20, "max"), 20),
    "o_ts_range_10": _half(_spread("o", 10), 10),
    "h_ts_argmax_5": _half(_place("h", 5, "max"), 5),
    "l_ts_day_min_40": _since("l", 40, "min"),
    "v_ts_day_max_20": _since("vol", 20, "max"),
    "c_ta_tsf_5": gate(f"{over('avg(c)', 5)} + ({_slope('c', 5)}) * 3", 5),
    "c_power_c": "c * c * c",
    "l_ts_argrange_5": _argrange("l", 5),
    "v_power_a": "vol * vol * vol",
    "ori_ta_bop": BOP,
    "ori_ta_obv": OBV,
    "ori_ta_ad": LINE,
    **{f"ma{t}_c": f"{gate(over('avg(c)', t), t)} / c" for t in (8, 15, 25, 35, 55)},
    "h_line": _band(1),
    "m_line": _band(0),
    "l_line": _band(-1),
    "stdevrate": f"({_band(1)} - {_band(-1)}) / (c * 4)",
    "mfi_index": _money_flow(14),
    "mfi_30": _money_flow(30),
    "ppo": gate(f"({over('avg(c)', 12)} - {over('avg(c)', 26)}) / {over('avg(c)', 26)} * 100", 26),
    "ad_index": LINE,
    "tr_index": RANGE,
    "kdj_d": gate(over("avg(slow_k)", 3), 13),
    "kdj_k": gate("slow_k", 13),
    "obv_v": OBV,
    **{f"cci_{t}": _channel(t) for t in (14, 25, 55)},
}
PLAIN, TWICE = ("kdj_d", "kdj_k"), ("ori_ta_macd",)


def _deviation(x: str) -> str:
    return f"{x} / greatest(coalesce(stddev_samp({x}) OVER {frame(NORM - 1)}, 0), 1e-6)"


def _stages(last: str) -> tuple[list[str], str]:
    out = []
    for k, stage in enumerate(STAGES):
        out.append(f"stage{k} AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in stage.items())} FROM {last})")
        last = f"stage{k}"
    return out, last


def _framed() -> str:
    parts, last = _stages("base")
    names = list(FRAMED)
    parts.append(f"raw AS (SELECT symbol, bar, {', '.join(f'{v} AS {n}' for n, v in FRAMED.items())} FROM {last})")
    parts.append(f"kept AS (SELECT symbol, bar, {', '.join(f'{tidy(n)} AS {n}' for n in names)} FROM raw)")
    out = ", ".join(f"{sql_round(n if n in PLAIN else _deviation(n), 4)} AS {n}" for n in names)
    return f"WITH {BASE}, {', '.join(parts)} SELECT symbol, bar, {out} FROM kept"


def moves_tables(name: str, x: str, t: int) -> list[str]:
    """``name`` (symbol, rn, up, down): Wilder means of rises and falls of ``x``."""
    source = f"{name}_m"
    return [
        MOVES.replace("moves AS", f"{source} AS").replace("(c ", f"({x} ").replace("- c,", f"- {x},").replace("lag(c,", f"lag({x},"),
        *ema_tables(f"{name}_u", source, "up", t, f"(1.0 / {t})", 2),
        *ema_tables(f"{name}_d", source, "down", t, f"(1.0 / {t})", 2),
        f"{name} AS (SELECT u.symbol, u.rn, u.e AS up, d.e AS down FROM {name}_u u JOIN {name}_d d ON u.symbol = d.symbol AND u.rn = d.rn)",
    ]


def trix_tables(name: str, t: int) -> list[str]:
    k = f"(2.0 / {t + 1})"
    return [
        *ema_tables(f"{name}_a", "base", "c", t, k, 1), *ema_tables(f"{name}_b", f"{name}_a", "e", t, k, t), *ema_tables(f"{name}_c", f"{name}_b", "e", t, k, 2 * t - 1),
        f"{name} AS (SELECT symbol, rn, 100 * (e / lag(e) OVER (PARTITION BY symbol ORDER BY rn) - 1) AS e FROM {name}_c)",
    ]


def macd_tables(name: str, x: str) -> list[str]:
    """MACD(12, 26) less its signal of 9; the fast mean starts where its seed ends with the slow one's."""
    return [
        *ema_tables(f"{name}_f", "base", x, 12, "(2.0 / 13)", 15), *ema_tables(f"{name}_s", "base", x, 26, "(2.0 / 27)", 1),
        f"{name}_g AS (SELECT f.symbol, f.rn, f.e - s.e AS e FROM {name}_f f JOIN {name}_s s ON f.symbol = s.symbol AND f.rn = s.rn)",
        *ema_tables(f"{name}_n", f"{name}_g", "e", 9, "(2.0 / 10)", 26),
        f"{name} AS (SELECT g.symbol, g.rn, g.e - n.e AS e FROM {name}_g g JOIN {name}_n n ON g.symbol = n.symbol AND g.rn = n.rn)",
    ]


def smoother_tables(name: str, p: int) -> list[str]:
    a = math.exp(-1.414 * math.pi / p)
    b, c3 = 2 * a * math.cos(1.414 * 180 / p), -a * a
    c1 = 1 - b - c3
    return [
        f"{name}_b AS (SELECT symbol, rn, body, {lagged('body', order='rn')} AS before FROM (SELECT symbol, rn, greatest(-1, least(1, 10 * (c - o))) AS body FROM base))",
        f"{name} AS (SELECT symbol, rn, CAST(body AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS past FROM {name}_b WHERE rn = 1 UNION ALL "
        f"SELECT n.symbol, n.rn, CASE WHEN n.rn = 2 THEN n.body ELSE {c1!r} * (n.body + n.before) / 2 + {b!r} * s.e + {c3!r} * s.past END, s.e FROM {name} s JOIN {name}_b n ON n.symbol = s.symbol AND n.rn = s.rn + 1)",
    ]


def _share(name: str, top: str) -> str:
    return f"SELECT symbol, rn, CASE WHEN up + down = 0 THEN 0 ELSE 100 * ({top}) / (up + down) END AS e FROM {name}"


def _recursive() -> str:
    tables: list[str] = []
    values: dict[str, str] = {}
    tables += moves_tables("vm25", "vol", 25)
    values["v_ta_cmo_25"] = _share("vm25", "up - down")
    for t in (8, 21, 55):
        tables += trix_tables(f"trix{t}", t)
        values[f"ori_trix_{t}"] = f"SELECT symbol, rn, e FROM trix{t}"
    for t in (6, 12, 14, 24, 25):
        tables += moves_tables(f"cm{t}", "c", t)
        if t in (6, 12, 24):
            values[f"ori_rsi_{t}"] = _share(f"cm{t}", "up")
        else:
            values[f"ori_cmo_{t}"] = _share(f"cm{t}", "up - down")
    for p in (20, 30, 40, 60):
        tables += smoother_tables(f"smooth{p}", p)
        values[f"fm{p}"] = f"SELECT symbol, rn, e FROM smooth{p}"
    tables += macd_tables("macd_c", "c") + macd_tables("macd_v", "vol")
    values |= {"ori_ta_macd": "SELECT symbol, rn, e FROM macd_c", "volume_macd": "SELECT symbol, rn, e FROM macd_v", "close_macd": "SELECT symbol, rn, e FROM macd_c"}
    tables += stop_tables("sar") + stop_tables("frozen", 0, 0, 0)
    values |= {"sar_index": "SELECT symbol, rn, e FROM sar", "sarext": "SELECT symbol, rn, CASE WHEN rising THEN e ELSE -e END AS e FROM frozen"}
    tables += [
        f"line AS (SELECT symbol, rn, {LINE} AS line FROM base)",
        "osc AS (SELECT symbol, rn, line AS fast, line AS slow FROM line WHERE rn = 1 UNION ALL "
        "SELECT n.symbol, n.rn, s.fast + 0.5 * (n.line - s.fast), s.slow + 2.0 / 11.0 * (n.line - s.slow) FROM osc s JOIN line n ON n.symbol = s.symbol AND n.rn = s.rn + 1)",
    ]
    values["ad_real"] = "SELECT symbol, rn, CASE WHEN rn >= 10 THEN fast - slow END AS e FROM osc"
    tables += [f"j_{n} AS (SELECT symbol, rn, e AS {n} FROM ({q}))" for n, q in values.items()]
    stages, last = _stages("base")
    raw = [*values, "cci_25_hlc", "ori_ta_bop"]
    parts = [*tables, *stages]
    picked = {n: n for n in values} | {"cci_25_hlc": _channel(25), "ori_ta_bop": BOP}
    parts.append(f"raw AS (SELECT symbol, bar, rn, c, vol, {', '.join(f'{v} AS {n}' for n, v in picked.items())} FROM {last} {' '.join(f'LEFT JOIN j_{n} USING (symbol, rn)' for n in values)})")
    parts.append(f"kept AS (SELECT symbol, bar, rn, c, vol, {', '.join(f'{tidy(n)} AS {n}' for n in raw)} FROM raw)")
    close = tidy("(sar_index - c) / nullif(c, 0)")
    parts.append(f"closed AS (SELECT *, {close} AS sar_close FROM kept)")
    scaled = [*raw, "sar_close"]
    parts.append(f"once AS (SELECT symbol, bar, rn, vol, {', '.join(f'{_deviation(n)} AS {n}' for n in scaled)} FROM closed)")
    parts.append(f"scaled AS (SELECT symbol, bar, rn, vol, {', '.join(f'{_deviation(n) if n in TWICE else n} AS {n}' for n in scaled)} FROM once)")
    second = {"v_cci_25_obv": "cci_25_hlc", "v_trix_8_obv": "ori_trix_8", "v_sar_obv": "sar_index", "v_cmo_14_obv": "ori_cmo_14", **{f"v_rsi_{t}_obv": f"ori_rsi_{t}" for t in (6, 12, 24)}}
    sums = {"v_cci_25_sum": "cci_25_hlc", "v_bop_sum": "ori_ta_bop", **{f"v_rsi_{t}_sum": f"ori_rsi_{t}" for t in (6, 12, 24)}}
    steps = ", ".join(f"CASE WHEN {lagged(x)} IS NULL OR {x} > {lagged(x)} THEN vol WHEN {x} < {lagged(x)} THEN -vol ELSE 0 END AS m_{n}" for n, x in second.items())
    parts.append(f"stepped AS (SELECT *, {steps} FROM scaled)")
    totals = [*[f"{running(f'sum(m_{n})')} AS {n}" for n in second], *[f"{running(f'sum({x} * vol)')} AS {n}" for n, x in sums.items()]]
    parts.append(f"summed AS (SELECT *, {', '.join(totals)} FROM stepped)")
    plain = [*values, "sar_close"]
    out = [*[f"{sql_round(n, 4)} AS {n}" for n in plain], *[f"{sql_round(_deviation(n), 4)} AS {n}" for n in [*second, *sums]]]
    return f"WITH RECURSIVE {BASE}, {', '.join(parts)} SELECT symbol, bar, {', '.join(out)} FROM summed"


SQL = {"framed_features": _framed(), "recursive_features": _recursive()}
