"""Learned combinations of features: regression, selection, evolved weights and formulas, a small network.

The searches run on the driver, but all candidates of a round are scored by one job.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.functions.network import Network, train
from stemmata.operators.evaluate import auc
from stemmata.session import BROADCAST_BYTES, Scratch

MAX_TRAIN_ROWS = 20_000


def logistic(table: DataFrame, features: list[str], penalty: str = "l2", strength: float = 0.01, balanced: bool = False):
    """A fitted ``pyspark.ml`` pipeline over ``table(actual, *features)``, and its coefficients by feature.

    ``balanced`` gives both classes the same weight. Rows with a null or NaN feature are skipped.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    t = table
    if balanced:
        share = t.agg(F.avg("actual").alias("s")).first()["s"] or 0.5
        t = t.withColumn("_w", F.when(F.col("actual") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    lr = LogisticRegression(labelCol="actual", regParam=strength, elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=50, **({"weightCol": "_w"} if balanced else {}))
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), lr]).fit(t)
    return model, dict(zip(features, model.stages[-1].coefficients.toArray().tolist()))


def logistic_scores(model, table: DataFrame) -> DataFrame:
    """``table`` with the model's probability of plagiarism as ``confidence``."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(table).withColumn("confidence", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "_w")


def _plain(v: Column) -> Column:
    return F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))


def _won(batches: Iterator[pa.RecordBatch], few: Broadcast, positive: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one class to twice the pairs that the positive side wins against the sorted values of the other, by candidate; ``positive`` says which class ``few`` is."""
    total = [0] * len(few.value)
    for batch in batches:
        for k, own in enumerate(few.value):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            both = int((np.searchsorted(own, x, "left") + np.searchsorted(own, x, "right")).sum())
            total[k] += 2 * len(own) * len(x) - both if positive else both
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["k", "won"])


class _Judge:
    """AUCs of expressions over ``table(actual, ...)``, one job for all of a round; 0.5 where they are undefined.

    The rarer class, written once, goes to every task sorted by each expression where it is small (32 MB): each row of the other
    is placed in it, and nothing is shuffled or sorted as a whole. The figures are those of ``evaluate.auc`` to the last bit.
    """

    def __init__(self, table: DataFrame):
        self.table = table
        found = {r["actual"]: r["n"] for r in table.groupBy("actual").agg(F.count("*").alias("n")).collect()}
        self.count = [found.get(0, 0), found.get(1, 0)]
        self.rare = int(self.count[1] <= self.count[0])
        self.few = Scratch(table.sparkSession, "rare").keep(table.where(F.col("actual") == self.rare).coalesce(8), "table")

    def aucs(self, values: list[Column]) -> list[float]:
        if not min(self.count):
            return [0.5] * len(values)
        if self.count[self.rare] * 8 * len(values) > BROADCAST_BYTES:
            return self.by_sorting(values)
        made = [_plain(v).alias(f"v{k}") for k, v in enumerate(values)]
        rare = self.few.select(*made).toPandas()
        few = self.table.sparkSession.sparkContext.broadcast([np.sort(rare[c].to_numpy(np.float64)) for c in rare])
        rest = self.table.where(F.col("actual") == 1 - self.rare).select(*made)
        won = rest.mapInArrow(partial(_won, few=few, positive=self.rare == 1), "k int, won bigint").groupBy("k").agg(F.sum("won").alias("won")).collect()
        few.destroy()
        by = {r["k"]: r["won"] / 2 / (self.count[0] * self.count[1]) for r in won}
        return [by[k] for k in range(len(values))]

    def by_sorting(self, values: list[Column]) -> list[float]:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("double").alias("confidence")) for k, v in enumerate(values))))
        scored = self.table.select("actual", each.alias("c")).select("actual", "c.k", _plain(F.col("c.confidence")).alias("confidence"))
        found = {r["k"]: r["auc"] for r in auc(scored, ["k"]).collect()}  # a row for each candidate
        return [found.get(k) if found.get(k) is not None else 0.5 for k in range(len(values))]


def _weighted(features: list[str], weights: list[float]):
    total = sum(weights) or 1.0
    return sum((F.col(f"`{f}`") * (w / total) for f, w in zip(features, weights)), F.lit(0.0))


def stepwise(table: DataFrame, features: list[str]) -> list[tuple[str, float]]:
    """Greedy selection: always the feature that, added to the mean of those chosen, gives the best AUC, while it grows."""
    chosen: list[tuple[str, float]] = []
    left, judge = list(features), _Judge(table)
    while left:
        names = [f for f, _ in chosen]
        scores = judge.aucs([_weighted([*names, f], [1.0] * (len(names) + 1)) for f in left])
        best = int(np.argmax(scores))
        if chosen and scores[best] <= chosen[-1][1]:
            break
        chosen.append((left.pop(best), scores[best]))
    return chosen


def evolve_weights(table: DataFrame, features: list[str], population: int = 12, generations: int = 100, mutation: float = 0.7, top: float = 100.0, seed: int = 1) -> tuple[list[float], float]:
    """A genetic search for weights of per-feature confidences by AUC: the better half survives, crossed and mutated."""
    rng = random.Random(seed)
    pool = [[rng.uniform(0, top) for _ in features] for _ in range(population)]
    best: tuple[list[float], float] = (pool[0], -1.0)
    judge, known = _Judge(table), {}
    for _ in range(generations):
        new = [w for w in pool if tuple(w) not in known]  # parents have been judged
        known |= {tuple(w): a for w, a in zip(new, judge.aucs([_weighted(features, w) for w in new]))} if new else {}
        scores = [known[tuple(w)] for w in pool]
        order = sorted(range(len(pool)), key=lambda k: -scores[k])
        if scores[order[0]] > best[1]:
            best = (pool[order[0]], scores[order[0]])
        parents = [pool[k] for k in order[: max(2, population // 2)]]
        children = []
        while len(parents) + len(children) < population:
            a, b = rng.sample(parents, 2)
            child = [rng.choice(pair) for pair in zip(a, b)]
            if rng.random() < mutation:
                child[rng.randrange(len(child))] = rng.uniform(0, top)
            children.append(child)
        pool = parents + children
    return best


Formula = tuple | str | float
OPERATORS = ["+", "-", "*", "**"]


def formula_sql(f: Formula) -> str:
    """A formula tree as SQL; a power that is undefined is null."""
    if isinstance(f, tuple):
        op, a, b = f
        return f"power({formula_sql(a)}, {formula_sql(b)})" if op == "**" else f"({formula_sql(a)} {op} {formula_sql(b)})"
    return f"`{f}`" if isinstance(f, str) else f"double({f!r})"


def evaluate_formula(table: DataFrame, f: Formula) -> DataFrame:
    """``table`` with the formula's value as ``confidence``; overflow and undefined values are 1e255."""
    v = F.expr(formula_sql(f))
    return table.withColumn("confidence", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1e255).otherwise(v))


def evolve_formula(table: DataFrame, features: list[str], population: int = 10, children: int = 20, generations: int = 10, depth: int = 6, seed: int = 1) -> tuple[Formula, float]:
    """Genetic programming over + - * ** formulas of features, by 1 - AUC; returns the best tree and its AUC."""
    rng = random.Random(seed)

    def grow(d: int) -> Formula:
        if d <= 1 or rng.random() < 0.3:
            return rng.choice(features) if rng.random() < 0.8 else round(rng.uniform(-10, 10), 2)
        return (rng.choice(OPERATORS), grow(d - 1), grow(d - 1))

    def swap(f: Formula, d: int, new: Callable[[int], Formula]) -> Formula:
        if not isinstance(f, tuple) or rng.random() < 0.3:
            return new(d)
        op, a, b = f
        return (op, swap(a, d - 1, new), b) if rng.random() < 0.5 else (op, a, swap(b, d - 1, new))

    def part(f: Formula, d: int) -> Formula:
        while isinstance(f, tuple) and (height(f) > d or rng.random() < 0.6):
            f = f[rng.choice((1, 2))]
        return f

    def height(f: Formula) -> int:
        return 1 + max(height(f[1]), height(f[2])) if isinstance(f, tuple) else 1

    pool = [grow(depth) for _ in range(population)]
    scored: list[tuple[float, Formula]] = []
    judge = _Judge(table)
    for _ in range(generations):
        bred = [swap(rng.choice(pool), depth, (lambda d, o=rng.choice(pool): part(o, d)) if rng.random() < 0.7 else grow) for _ in range(children)]
        new = [f for f in [*pool, *bred] if f not in [g for _, g in scored]]
        finite = [F.when(F.abs(F.expr(formula_sql(f))) < 1e255, F.expr(formula_sql(f))).otherwise(1e255) for f in new]
        scored += zip(judge.aucs(finite), new) if new else []
        scored = sorted(scored, key=lambda s: -s[0])[:population]
        pool = [f for _, f in scored]
    return scored[0][1], scored[0][0]


def train_network(table: DataFrame, features: list[str], hidden: int = 20, max_rows: int = MAX_TRAIN_ROWS) -> tuple[Network, float]:
    """A network fitted on three quarters of at most ``max_rows`` rows of ``table(doc_id, atom_num, actual, ...)``, and the mean square error on the rest.

    Rows are drawn and split by the hash of their key.
    """
    key = F.xxhash64("doc_id", "atom_num")
    rows = table.select("actual", key.alias("_k"), *(F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features))).orderBy("_k").limit(max_rows).toPandas()
    x, y = np.nan_to_num(rows[[f"_{i}" for i in range(len(features))]].to_numpy(float)), rows["actual"].to_numpy(float)
    held = (rows["_k"].to_numpy() % 4) == 0
    mean, sd = x[~held].mean(axis=0), x[~held].std(axis=0)
    sd = np.where(sd == 0, 1.0, sd)
    net = train((x[~held] - mean) / sd, y[~held], hidden)
    w1 = net.w1 / sd  # the scaling goes into the weights
    net = net._replace(w1=w1, b1=net.b1 - w1 @ mean)
    return net, float(((net(x[held])[:, 0] - y[held]) ** 2).mean()) if held.any() else float("nan")
