"""How well a ranking agrees with labels, votes and paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank.functions.columns import base_name
from takerank.operators.order import running
from takerank.operators.scoring import percentile_ranks


def auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Chance that a positive scores above a negative, ties counting a half, from rank sums; one row."""
    c = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"), F.sum(F.col(positive).cast("long")).alias("p"))
    won = running(c, [F.col("s")], {"before": F.col("c") - F.col("p")}).withColumn("won", F.col("p") * (F.col("before") + (F.col("c") - F.col("p")) / 2))
    g = won.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum(F.col("c") - F.col("p")).alias("n"))
    return g.select(F.col("p").alias("n_positive"), F.col("n").alias("n_negative"), F.try_divide("won", F.col("p") * F.col("n")).alias("auc"))


def precision_at(ranked: DataFrame, ks: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """k, hits and precision of a ranking (rank, positive); the denominator is the smaller of k and the positives."""
    n = ranked.agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("p"), *[F.sum((F.col("positive") & (F.col("rank") <= k)).cast("long")).alias(f"h{k}") for k in ks])
    rows = n.select("n", "p", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("v")).select("n", "p", "v.*")
    return rows.where("k <= n").select("k", "hits", F.try_divide("hits", F.least("k", "p")).alias("precision"))


def positive_percentiles(ranked: DataFrame, key: str) -> DataFrame:
    """Percentile position of each positive of a ranking (rank, positive)."""
    n = ranked.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where("positive").select(key, "rank", (100 * (1 - F.col("rank") / F.col("n"))).alias("pct"))


def median_percentile(ranked: DataFrame, key: str) -> DataFrame:
    """One row: the median of the percentile positions of the positives."""
    return positive_percentiles(ranked, key).agg(F.count("*").alias("n"), F.median("pct").alias("median"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def p_value(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def spearman(df: DataFrame, key: str, target: str, features: list[str], p: bool = True) -> DataFrame:
    """feature, n, rho, p and stars (.01, .05) against the target, strongest first, for features with two values or more and five rows or more.

    One row a file or segment is ranked, for each feature apart.
    """
    rows = df.where(F.col(target).isNotNull())
    long = rows.select(key, target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("v")).select(key, target, "v.*").where("x IS NOT NULL")
    mean_rank = lambda c: F.rank().over(W.Window.partitionBy("feature").orderBy(c)) + (F.count("*").over(W.Window.partitionBy("feature", c)) - 1) / 2
    r = long.withColumns({"rx": mean_rank("x"), "ry": mean_rank(target)})
    out = r.groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("x").alias("k"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho")).where("n >= 5 AND k > 1").drop("k")
    if not p:
        return out

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[p_value(r, n) for r, n in zip(b.rho, b.n, strict=True)])

    out = out.mapInPandas(add, "feature string, n long, rho double, p double")
    return out.withColumn("stars", F.when(F.col("p") < 0.01, "***").when(F.col("p") < 0.05, "*").otherwise("")).orderBy(F.abs("rho").desc(), "feature")


def win_matrix(answers: DataFrame) -> DataFrame:
    """winner, loser, weight of answers (a, b, choice): A, B, or a tie, both or none, which gives half a win each way; no answer gives nothing."""
    row = lambda w, l, x: F.struct(F.col(w).alias("winner"), F.col(l).alias("loser"), F.lit(x).alias("w"))  # noqa: E731, E741
    rows = F.when(F.col("choice") == "A", F.array(row("a", "b", 1.0))).when(F.col("choice") == "B", F.array(row("b", "a", 1.0))).when(F.col("choice").isin("ambos", "ninguno"), F.array(row("a", "b", 0.5), row("b", "a", 0.5)))
    return answers.select(F.explode(rows).alias("r")).select("r.*").groupBy("winner", "loser").agg(F.sum("w").alias("weight"))


def bradley_terry(matrix: DataFrame, iterations: int = 200, prior: float = 0.05) -> DataFrame:
    """item and strength (log) from a win matrix, by minorisation and maximisation with a small prior.

    The items are those a human compared; their matrix is one group.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted(set(pdf.winner) | set(pdf.loser))
        n = len(items)
        at = {x: i for i, x in enumerate(items)}
        wins = np.full((n, n), prior / n)
        np.fill_diagonal(wins, 0.0)
        np.add.at(wins, ([at[x] for x in pdf.winner], [at[x] for x in pdf.loser]), pdf.weight.to_numpy())
        games, won, theta = wins + wins.T, wins.sum(axis=1), np.ones(n)
        for _ in range(iterations):
            share = games / (theta[:, None] + theta[None, :])
            np.fill_diagonal(share, 0.0)
            theta = won / share.sum(axis=1)
            theta /= np.exp(np.log(theta).mean())
        return pd.DataFrame({"item": items, "bt": np.log(theta)})

    kind = dict(matrix.dtypes)["winner"]
    return matrix.groupBy().applyInPandas(fit, f"item {kind}, bt double")


def close_pairs(ranked: DataFrame, distance: int = 6) -> DataFrame:
    """Pairs of neighbours in a ranking (item, rank, topic, group) that differ in topic and duplicate group."""
    a = ranked.select(F.col("item").alias("a"), F.col("rank").alias("ra"), F.col("topic").alias("ta"), F.col("group").alias("ga"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + distance)).alias("rb"))
    b = ranked.select(F.col("item").alias("b"), F.col("rank").alias("rb"), F.col("topic").alias("tb"), F.col("group").alias("gb"))
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    return a.join(b, "rb").where(~same("ta", "tb") & ~same("ga", "gb")).select("a", "b", (F.col("rb") - F.col("ra")).alias("apart"))


def unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs that were not asked in either order."""
    key = lambda d: d.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
    return key(pairs).join(key(seen).select("_x", "_y").distinct(), ["_x", "_y"], "left_anti").drop("_x", "_y")


def sampled(df: DataFrame, key: str, n: int, seed: int = 0, include: DataFrame | None = None) -> DataFrame:
    """n rows drawn by a hash of the seed and key, the same on every run, and the rows whose key is to be included beside them."""
    if include is None:
        return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    keep = include.select(key).distinct()
    pool = df.join(keep, key, "left_anti")
    return df.join(keep, key, "left_semi").unionByName(sampled(pool, key, n, seed))


def named_like(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """Rows whose file name holds one of the parts, whatever the case; all rows without parts."""
    low = F.lower(base_name(F.col(name)))
    return df.where(reduce(lambda a, b: a | b, (low.contains(p.lower()) for p in parts))) if parts else df


__all__ = ["auc", "bradley_terry", "close_pairs", "median_percentile", "named_like", "p_value", "percentile_ranks", "positive_percentiles", "precision_at", "sampled", "spearman", "unseen", "win_matrix"]
