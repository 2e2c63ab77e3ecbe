"""Genetic programming over the factor language.

Programs are small trees and are bred on the driver. Scoring is the work: all new programs of a generation are compiled
into batches of factor columns, so that equal subtrees are computed once for the whole generation, and each batch is one
Spark job that returns one row for each program. Redundant programs are found from the correlated pairs that Spark
computes block by block, over the whole generation at once, so results depend on the seed and not on the number of cores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Series
from ..functions.registry import Operator, active_operators
from ..plans.compile import NORM_WINDOW, compile_factors
from ..plans.expr import Call, Const, Feature, Node, depth, length, to_text, walk
from .correlation import correlated, stacked
from .metrics import METRICS, Scoring, evaluate


#: Pairs of programs that reach the driver at once when the hall of fame is thinned.
PAIRS_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class EvolveConfig:
    population: int = 200
    generations: int = 2
    hall_of_fame: int = 100
    components: int = 50
    tournament: int = 8
    init_depth: tuple[int, int] = (1, 3)
    init_method: str = "half and half"
    const_range: tuple[float, float] | None = (-1.0, 1.0)
    crossover: float = 0.9
    subtree: float = 0.01
    hoist: float = 0.01
    point: float = 0.01
    point_replace: float = 0.05
    parsimony: float | str = 0.001
    metric: str = "avg_sic"
    stopping: float = 1.0
    max_correlation: float = 0.9
    #: Share of rows that a program is fitted on; the rest is its out-of-bag sample.
    max_samples: float = 1.0
    seed: int = 42
    batch: int = 50
    #: Children deeper than this give way to their parents; None: no limit. Plans grow with depth.
    max_depth: int | None = None
    norm_window: int = NORM_WINDOW

    def __post_init__(self) -> None:
        if self.init_method not in ("full", "grow", "half and half"):
            raise ValueError(f"no way {self.init_method!r} to build programs")
        if self.metric not in METRICS or not METRICS[self.metric].objective:
            raise ValueError(f"{self.metric!r} can't steer an evolution")
        if self.crossover + self.subtree + self.hoist + self.point > 1 + 1e-12:
            raise ValueError("the probabilities of the genetic operations are over 1")
        if not 0 < self.max_samples <= 1:
            raise ValueError("max_samples must be over 0 and at most 1")
        if not 0 < self.components <= self.hall_of_fame <= self.population:
            raise ValueError("components, hall of fame and population must not decrease in this order")
        if self.init_depth[0] > self.init_depth[1] or self.init_depth[0] < 1:
            raise ValueError("init_depth must be a range from 1 up")


@dataclass
class Program:
    tree: Node
    raw: float = math.nan
    penalised: float = math.nan
    oob: float = math.nan
    born: int = 0
    method: str = "new"
    parents: tuple[int, ...] = ()

    @property
    def text(self) -> str:
        return to_text(self.tree)


class Breeder:
    """Builds and changes trees with one random stream."""

    def __init__(self, features: list[str], operators: list[Operator], config: EvolveConfig, seed: int):
        self.features, self.operators, self.config = features, operators, config
        self.random = np.random.RandomState(seed)
        self.by_arity: dict[int, list[Operator]] = {}
        for op in operators:
            self.by_arity.setdefault(op.arity, []).append(op)

    def terminal(self) -> Node:
        extra = self.config.const_range is not None
        k = self.random.randint(len(self.features) + extra)
        return Const(float(self.random.uniform(*self.config.const_range))) if k == len(self.features) else Feature(self.features[k])

    def build(self) -> Node:
        """A tree whose root is an operator; "full" reaches its depth on every branch, "grow" may end before."""
        goal = self.random.randint(self.config.init_depth[0], self.config.init_depth[1] + 1)
        method = self.config.init_method
        if method == "half and half":
            method = "full" if self.random.randint(2) else "grow"

        def grow(level: int) -> Node:
            if level >= goal:
                return self.terminal()
            choices = len(self.features) + len(self.operators)
            if level and method == "grow" and self.random.randint(choices) > len(self.operators):
                return self.terminal()
            op = self.operators[self.random.randint(len(self.operators))]
            return Call(op.name, tuple(grow(level + 1) for _ in range(op.arity)))

        return grow(0)

    def place(self, tree: Node) -> int:
        """A node in the order of ``walk``: operators with nine times the chance of terminals."""
        weights = np.array([0.9 if isinstance(x, Call) else 0.1 for x in walk(tree)])
        return int(self.random.choice(len(weights), p=weights / weights.sum()))

    def crossover(self, tree: Node, donor: Node) -> Node:
        return graft(tree, self.place(tree), subtree(donor, self.place(donor)))

    def subtree_mutation(self, tree: Node) -> Node:
        return self.crossover(tree, self.build())

    def hoist_mutation(self, tree: Node) -> Node:
        at = self.place(tree)
        below = subtree(tree, at)
        return graft(tree, at, subtree(below, self.place(below)))

    def point_mutation(self, tree: Node) -> Node:
        rate = self.config.point_replace

        def change(x: Node) -> Node:
            hit = self.random.uniform() < rate
            if isinstance(x, Call):
                name = x.name
                if hit:
                    same = self.by_arity[len(x.args)]
                    name = same[self.random.randint(len(same))].name
                return Call(name, tuple(change(a) for a in x.args))
            return self.terminal() if hit else x

        return change(tree)

    def tournament(self, pool: list[Program], better: int) -> int:
        drawn = self.random.randint(0, len(pool), self.config.tournament)
        worth = [better * pool[k].penalised if math.isfinite(pool[k].penalised) else -math.inf for k in drawn]
        return int(drawn[int(np.argmax(worth))])

    def breed(self, pool: list[Program], better: int, generation: int) -> Program:
        c, u = self.config, self.random.uniform()
        k = self.tournament(pool, better)
        tree = pool[k].tree
        if u < c.crossover:
            d = self.tournament(pool, better)
            new, method, parents = self.crossover(tree, pool[d].tree), "crossover", (k, d)
        elif u < c.crossover + c.subtree:
            new, method, parents = self.subtree_mutation(tree), "subtree mutation", (k,)
        elif u < c.crossover + c.subtree + c.hoist:
            new, method, parents = self.hoist_mutation(tree), "hoist mutation", (k,)
        elif u < c.crossover + c.subtree + c.hoist + c.point:
            new, method, parents = self.point_mutation(tree), "point mutation", (k,)
        else:
            new, method, parents = tree, "reproduction", (k,)
        if (c.max_depth and depth(new) > c.max_depth) or not isinstance(new, Call):
            # Roots are operators, and there may be a limit; such a child gives way to its parent.
            new, method = tree, "reproduction"
        return Program(new, born=generation, method=method, parents=parents)


def subtree(tree: Node, at: int) -> Node:
    return list(walk(tree))[at]


def graft(tree: Node, at: int, new: Node) -> Node:
    """``tree`` with its node number ``at`` replaced."""
    k = -1

    def change(x: Node) -> Node:
        nonlocal k
        k += 1
        if k == at:
            k += length(x) - 1
            return new
        return Call(x.name, tuple(change(a) for a in x.args)) if isinstance(x, Call) else x

    return change(tree)


def parsimony_rate(config: EvolveConfig, programs: list[Program]) -> float:
    """The penalty for each node; "auto": covariance of length and fitness over the variance of length."""
    if config.parsimony != "auto":
        return float(config.parsimony)
    known = [(length(p.tree), p.raw) for p in programs if math.isfinite(p.raw)]
    if len(known) < 2:
        return 0.0
    sizes, worth = np.array(known, float).T
    variance = sizes.var()
    return float(np.cov(sizes, worth)[1, 0] / variance) if variance else 0.0


def independent(pairs: Mapping[int, np.ndarray] | Iterable[tuple[int, np.ndarray]], fitness: np.ndarray) -> np.ndarray:
    """Which programs stay, given for each the later ones that it resembles too much: a mapping, or pairs in the order of programs,
    of which one is looked at at a time.

    Programs take their turn in order, unless an earlier one has thrown them out: all that are no fitter go, and the program
    itself goes if any is fitter.
    """
    stays = np.ones(len(fitness), bool)
    for turn, rivals in sorted(pairs.items()) if isinstance(pairs, Mapping) else pairs:
        if stays[turn]:
            fitter = fitness[rivals] > fitness[turn]
            stays[rivals[~fitter]] = False
            stays[turn] = not fitter.any()
    return stays


def thinned(pairs: list[tuple[int, int]], left: set[int], wanted: int) -> set[int]:
    """``left`` without the later member of each pair whose members are both still there, until ``wanted`` are left."""
    left = set(left)
    for a, b in pairs:
        if len(left) <= wanted:
            break
        if a in left and b in left:
            left.remove(b)
    return left


class Evolution:
    """Evolves factors of ``df`` (keys, order, features, label) and keeps the fittest that differ."""

    def __init__(self, df: DataFrame, features: list[str], y: str, config: EvolveConfig = EvolveConfig(), raw_y: str | None = None, scoring: Scoring = Scoring(), operators: list[Operator] | None = None):
        self.df, self.features, self.y, self.raw_y, self.config, self.scoring = df, features, y, raw_y, config, scoring
        self.operators = operators or active_operators()
        self.series = Series(scoring.keys, (scoring.order,))
        self.scores: dict[str, tuple[float, float]] = {}
        self.generations: list[list[Program]] = []
        self.aside: list[Program] = []
        self.report: list[dict] = []

    @property
    def better(self) -> int:
        return METRICS[self.config.metric].sign

    def _factor_frame(self, programs: dict[str, Node]) -> DataFrame:
        labels = list(dict.fromkeys(x for x in (self.y, self.raw_y) if x))
        return compile_factors(self.df, programs, self.series, self.config.norm_window, keep=labels)

    def _batches(self, items: list) -> list[list]:
        return [items[k : k + self.config.batch] for k in range(0, len(items), self.config.batch)]

    def score(self, programs: list[Program]) -> None:
        """Raw fitness of every program; a text is scored once in the whole run. Several symbols: the mean."""
        new = {p.text: p.tree for p in programs if p.text not in self.scores}
        metric, share = self.config.metric, self.config.max_samples
        for batch in self._batches(list(new.items())):
            names = {f"f{k}": tree for k, (_, tree) in enumerate(batch)}
            frame = self._factor_frame(names)
            if share < 1:
                # The draw is by row, from the seed alone.
                frame = frame.withColumn("__in", F.pmod(F.xxhash64(F.lit(self.config.seed), *self.scoring.keys, self.scoring.order), F.lit(10_000)) < int(share * 10_000))
                frame = frame.withColumns({"__w_in": F.col("__in").cast("double"), "__w_out": (~F.col("__in")).cast("double")})
            got = {}
            for k, w in enumerate(["__w_in", "__w_out"] if share < 1 else [None]):
                table = evaluate(frame, list(names), [metric], self.y, self.raw_y, self.scoring, w)
                for row in table.groupBy("factor").agg(F.avg(metric).alias("v")).collect():
                    got.setdefault(row["factor"], [math.nan, math.nan])[k] = math.nan if row["v"] is None else float(row["v"])
            for k, (text, _) in enumerate(batch):
                self.scores[text] = tuple(got.get(f"f{k}", (math.nan, math.nan)))
        for p in programs:
            p.raw, p.oob = self.scores[p.text]

    def filtered(self, programs: list[Program]) -> list[Program]:
        """The programs that the correlation filter leaves; equal texts are one, and a single one doesn't stay."""
        unique = list({p.text: p for p in programs if math.isfinite(p.raw)}.values())
        if len(unique) < 2:
            return []
        close = self.correlated(unique, self.config.max_correlation).groupBy("a").agg(F.collect_list("b").alias("b"))
        # In a population that has converged most pairs are beyond the limit, so the driver reads them in order and keeps none.
        pairs = ((r["a"], np.array(r["b"])) for r in close.orderBy("a").toLocalIterator())
        stays = independent(pairs, np.array([self.better * p.raw for p in unique]))
        return [p for p, k in zip(unique, stays) if k]

    def correlated(self, programs: list[Program], least: float = -1.0) -> DataFrame:
        """(a, b, r) of the numbers of correlated programs, a batch of them in a plan."""
        rows, first = None, 0
        for batch in self._batches([p.tree for p in programs]):
            names = {f"f{k}": tree for k, tree in enumerate(batch)}
            part = stacked(self._factor_frame(names), list(names), first, self.series)
            if len(programs) > len(batch):
                part = part.checkpoint()
            rows, first = part if rows is None else rows.unionByName(part), first + len(batch)
        return correlated(rows, len(programs), least)

    def run(self, warm: list[Program] | None = None) -> list[Program]:
        """The best programs, at most ``components``. ``warm``: programs of an earlier run to go on from."""
        c = self.config
        pool = warm
        for g in range(c.generations):
            breeder = Breeder(self.features, self.operators, c, c.seed + g)
            if pool:
                programs = [breeder.breed(pool, self.better, g) for _ in range(c.population)]
            else:
                programs = [Program(breeder.build(), born=g) for _ in range(c.population)]
            self.score(programs)
            kept = self.filtered(programs) or [p for p in programs if math.isfinite(p.raw)][:1]
            if not kept:
                break
            rate = parsimony_rate(c, kept)
            for p in kept:
                p.penalised = p.raw - rate * length(p.tree) * self.better
            if pool is not None and g:
                self._set_aside(pool, kept)
            self.generations.append(kept)
            best = max(kept, key=lambda p: self.better * p.raw)
            self.report.append({"generation": g, "kept": len(kept), "mean_length": float(np.mean([length(p.tree) for p in kept])), "best": best.raw, "best_oob": best.oob, "best_text": best.text})
            pool = kept
            if self.better * best.raw >= self.better * c.stopping:
                break
        return self.selection()

    def _set_aside(self, parents: list[Program], children: list[Program]) -> None:
        """Programs that no child came from but that are fitter than the average parent are kept for the end."""
        used = {k for p in children for k in p.parents}
        mean = np.mean([self.better * parents[k].raw for k in used]) if used else -math.inf
        self.aside += [p for k, p in enumerate(parents) if k not in used and self.better * p.raw > mean]

    def selection(self) -> list[Program]:
        """The hall of fame, thinned: of the pair that correlates most the less fit goes, until ``components`` are left."""
        everyone = [p for g in self.generations[-1:] for p in g] + self.aside
        pool = self.filtered(everyone) or everyone
        fame = sorted({p.text: p for p in pool}.values(), key=lambda p: (-self.better * p.raw, p.text))[: self.config.hall_of_fame]
        if len(fame) <= self.config.components:
            return fame
        everything = self.correlated(fame).select("a", "b", F.coalesce(F.abs("r"), F.lit(0.0)).alias("r"))
        if len(fame) > PAIRS_AT_ONCE**0.5:
            everything = everything.checkpoint()
        left = set(range(len(fame)))
        while len(left) > self.config.components:
            # Fame is sorted, so the later of a pair is the less fit. The largest pairs are settled first, so those among
            # programs that are left go on where the last ones ended.
            there = F.broadcast(self.df.sparkSession.createDataFrame([(k,) for k in sorted(left)], "k int"))
            rest = everything.join(there.withColumnRenamed("k", "a"), "a").join(there.withColumnRenamed("k", "b"), "b")
            top = rest.orderBy(F.desc("r"), F.desc("b"), F.desc("a")).limit(PAIRS_AT_ONCE).select("a", "b").collect()
            left = thinned([(r["a"], r["b"]) for r in top], left, self.config.components)
        return [p for k, p in enumerate(fame) if k in left]

    def table(self, programs: list[Program]) -> DataFrame:
        """(expression, raw_fitness, oob_fitness, depth, length, generation, place)."""
        rows = [(p.text, p.raw, p.oob, depth(p.tree), length(p.tree), p.born, k) for k, p in enumerate(programs)]
        return self.df.sparkSession.createDataFrame(rows, "expression string, raw_fitness double, oob_fitness double, depth int, length int, generation int, place int")


class FactorTransformer(Transformer):
    """A pipeline stage that adds evolved factors to a frame."""

    def __init__(self, expressions: dict[str, str], series: Series = Series(), norm_window: int = NORM_WINDOW):
        super().__init__()
        self.expressions, self.series, self.norm_window = expressions, series, norm_window

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return compile_factors(dataset, self.expressions, self.series, self.norm_window, keep=dataset.columns)


class FactorRegressor(FactorTransformer):
    """Predicts with one factor."""

    def __init__(self, expression: str, **options):
        super().__init__({"prediction": expression}, **options)


class FactorClassifier(FactorTransformer):
    """Classes 0 and 1 from the logistic function of one factor, so that probabilities lie between 0 and 1."""

    def __init__(self, expression: str, **options):
        super().__init__({"__raw": expression}, **options)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        now = super()._transform(dataset)
        return now.withColumn("probability", 1.0 / (1.0 + F.exp(-F.col("__raw")))).withColumn("prediction", (F.col("probability") > 0.5).cast("int")).drop("__raw")


def continued(config: EvolveConfig, more: int) -> EvolveConfig:
    """The settings for going on with a run: other seeds, more generations."""
    return replace(config, seed=config.seed + config.generations, generations=more)
