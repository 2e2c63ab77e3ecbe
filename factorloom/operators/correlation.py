"""Correlations of very many factors by blocks of their Gram matrix.

A frame with some factors becomes one row of values for each of its rows (``stacked``), and frames of the same rows are put
under each other, so no plan ever has a column for each of thousands of factors. For every pair of tiles of ``TILE``
factors and every part of the rows, one task multiplies two matrices of bounded size; the centred moments of the parts
are merged in a tree, ``FAN`` of them in a task, and what leaves the cluster is the pairs beyond a limit.

A correlation is null where a factor doesn't vary. Rows must be unique by series and order. Factors hold no nulls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Series

#: Factors in a tile, rows that one task multiplies at once, and rows of a product that travel together.
TILE = 500
ROWS_PER_TASK = 8_000
CHUNK = 50
#: Parts that one task merges, of up to 8 * TILE * CHUNK bytes each.
FAN = 64


def stacked(df: DataFrame, factors: list[str], first: int = 0, series: Series = Series()) -> DataFrame:
    """(row, first, x): the values of ``factors``, which are numbered from ``first`` on, for each row of ``df``."""
    return df.select(F.struct(*series.keys, *series.order).alias("row"), F.lit(first).alias("first"), F.array(*[F.col(f).cast("double") for f in factors]).alias("x"))


def _tile(number: Column) -> Column:
    return F.floor(number / TILE).cast("int")


def _matrix(rows: pd.DataFrame, tile: int, size: int) -> np.ndarray:
    """The values of one tile, a line for each row of the frame in the order of the rows' names."""
    pieces = []
    for first, part in rows.groupby("first"):
        values = np.stack(part.sort_values("name")["x"].to_numpy())
        lo, hi = max(first, tile * size), min(first + values.shape[1], (tile + 1) * size)
        pieces.append((lo, values[:, lo - first : hi - first]))
    return np.concatenate([x for _, x in sorted(pieces, key=lambda p: p[0])], axis=1)


def _product(size: int, chunk: int):
    """Centred moments of one part of the rows: of every factor of tile ``i`` with all of tile ``j``."""

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, part = (int(rows[c].iloc[0]) for c in ("i", "j", "part"))
        whole = rows[rows["tile"] == i]
        a = _matrix(whole, i, size)
        b = a if i == j else _matrix(rows[rows["tile"] == j], j, size)
        start_a, start_b = a[0].copy(), b[0].copy()
        # From the first row on, so that a factor that is constant has exactly no moments.
        a, b = a - start_a, b - start_b
        mean_a, mean_b = a.mean(0), b.mean(0)
        a, b = a - mean_a, b - mean_b
        products, square_a, square_b = a.T @ b, (a * a).sum(0), (b * b).sum(0)
        out = []
        for lo in range(0, a.shape[1], chunk):
            s = slice(lo, lo + chunk)
            out.append((i, j, lo, part, len(a), (start_a + mean_a)[s].tolist(), square_a[s].tolist(), (start_b + mean_b).tolist(), square_b.tolist(), np.ascontiguousarray(products[s]).tobytes()))
        return pd.DataFrame(out, columns=["i", "j", "lo", "part", "n", "mean_a", "square_a", "mean_b", "square_b", "products"])

    return of_part


def _together(parts: pd.DataFrame) -> tuple:
    """(n, mean_a, square_a, mean_b, square_b, products) of all rows of some parts."""
    n = parts["n"].to_numpy(float)
    mean_a, mean_b = np.stack(parts["mean_a"].to_numpy()), np.stack(parts["mean_b"].to_numpy())
    start_a, start_b = mean_a[0].copy(), mean_b[0].copy()
    mean_a, mean_b = mean_a - start_a, mean_b - start_b
    whole_a, whole_b = n @ mean_a / n.sum(), n @ mean_b / n.sum()
    away_a, away_b = mean_a - whole_a, mean_b - whole_b
    products = sum(np.frombuffer(p).reshape(len(start_a), len(start_b)) for p in parts["products"]) + (away_a * n[:, None]).T @ away_b
    square_a = np.stack(parts["square_a"].to_numpy()).sum(0) + n @ (away_a * away_a)
    square_b = np.stack(parts["square_b"].to_numpy()).sum(0) + n @ (away_b * away_b)
    return int(n.sum()), start_a + whole_a, square_a, start_b + whole_b, square_b, products


def _combined(parts: pd.DataFrame) -> pd.DataFrame:
    """One part in place of some: a step of the tree in which parts are merged."""
    n, mean_a, square_a, mean_b, square_b, products = _together(parts)
    first = parts.iloc[0]
    row = (first["i"], first["j"], first["lo"], first["into"], n, mean_a.tolist(), square_a.tolist(), mean_b.tolist(), square_b.tolist(), np.ascontiguousarray(products).tobytes())
    return pd.DataFrame([row], columns=["i", "j", "lo", "part", "n", "mean_a", "square_a", "mean_b", "square_b", "products"])


def _merged(size: int, least: float):
    """Correlations of the factors of one chunk with those of tile ``j``, from the moments of the last parts."""

    def of_chunk(parts: pd.DataFrame) -> pd.DataFrame:
        i, j, lo = (int(parts[c].iloc[0]) for c in ("i", "j", "lo"))
        _, _, square_a, _, square_b, products = _together(parts)
        with np.errstate(all="ignore"):
            r = products / np.sqrt(np.outer(square_a, square_b))
        first, second = np.arange(len(square_a)) + i * size + lo, np.arange(len(square_b)) + j * size
        wanted = (first[:, None] < second[None, :]) & ((np.abs(r) > least) | ((least < 0) & ~np.isfinite(r)))
        x, y = np.nonzero(wanted)
        r = r[x, y]
        return pd.DataFrame({"a": first[x], "b": second[y], "r": pd.array(r, dtype="Float64") if np.isfinite(r).all() else [v if np.isfinite(v) else None for v in r]})

    return of_chunk


def correlated(rows: DataFrame, factors: int, least: float = -1.0) -> DataFrame:
    """(a, b, r): the pairs a < b of the numbers of ``factors`` stacked factors with \\|r\\| over ``least``; all pairs, undefined
    ones too, if that is negative."""
    size, tiles = TILE, -(-factors // TILE)
    here = rows.select("row", "first", "x", F.explode(F.sequence(_tile(F.col("first")), _tile(F.col("first") + F.size("x") - 1))).alias("tile"))
    parts = max(1, -(-rows.where("first = 0").count() // ROWS_PER_TASK))
    name = F.xxhash64("row")
    # Every tile meets all tiles, itself included, as the first or the second of the pair.
    pairs = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    dealt = here.select(F.pmod(name, F.lit(parts)).alias("part"), name.alias("name"), "first", "x", "tile", F.explode(pairs).alias("p"))
    dealt = dealt.select("part", "name", "first", "x", "tile", "p.i", "p.j")
    schema = "i int, j int, lo int, part long, n long, mean_a array<double>, square_a array<double>, mean_b array<double>, square_b array<double>, products binary"
    moments = dealt.groupBy("i", "j", "part").applyInPandas(_product(size, CHUNK), schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        into = F.pmod(F.col("part"), F.lit(parts)).alias("into")
        moments = moments.select("*", into).groupBy("i", "j", "lo", "into").applyInPandas(_combined, schema)
    return moments.groupBy("i", "j", "lo").applyInPandas(_merged(size, least), "a int, b int, r double")
