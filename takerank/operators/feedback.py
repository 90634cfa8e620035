"""Paired comparisons: segments shown, pairs drawn and asked, answers, and what they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank.functions.columns import base_name, quota
from takerank.operators.ledger import latest
from takerank.operators.order import ranked
from takerank.operators.scoring import quantile_row
from takerank.operators.segments import best_run

CHOICES = ("A", "B", "ambos", "ninguno")


def segment_id(path: str = "path", start: str = "start", end: str = "end"):
    """The id of a stretch: a hash of what makes it, so that asking for it twice gives the same."""
    return F.xxhash64(path, F.col(start).cast("double"), F.col(end).cast("double"))


def with_segments(stretches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, path, start and end of the stretches (path, start, end), each once, that the table of known ones lacks."""
    new = stretches.select(segment_id().alias("id"), "path", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).dropDuplicates(["id"])
    return new if known is None else new.join(known.select("id"), "id", "left_anti")


def candidates(windows: DataFrame, files: DataFrame, n: int, column: str = "score", **cut: float) -> DataFrame:
    """files of at least n windows with start and end of their best run of n windows."""
    run = best_run(windows, n, column, **cut).select("path", F.col("ini").alias("start"), F.col("fin").alias("end"))
    return files.where(F.col("n_win") >= n).join(run, "path")


def opposite_tails(c: DataFrame) -> DataFrame:
    """c with gem (much interest, little execution) and perf (the other way round), by the quantiles 0.7 and 0.5 over all rows."""
    a = quantile_row(c, "interes", {"i7": 0.7, "i5": 0.5})
    b = quantile_row(c, "ejecucion", {"e7": 0.7, "e5": 0.5})
    q = c.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # a row each
    gem, perf = (F.col("interes") >= F.col("i7")) & (F.col("ejecucion") <= F.col("e5")), (F.col("ejecucion") >= F.col("e7")) & (F.col("interes") <= F.col("i5"))
    return q.withColumns({"gem": gem, "perf": perf}).drop("i7", "i5", "e7", "e5")


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("path", "topic", "group")], *[c for c in df.columns if c in {"_key", "_near"}])


def _fits(seed: int):
    """Pairs of different files, topics and duplicate groups; what is not known differs from all. And their order in the draw."""
    differ = lambda c: ~F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    return differ("path") & differ("topic") & differ("group"), F.xxhash64(F.lit(seed), F.least("path_a", "path_b"), F.greatest("path_a", "path_b"))


def draw_pairs(c: DataFrame, n: int, seed: int = 0, seen: DataFrame | None = None, column: str = "score_med") -> DataFrame:
    """num, a, b and kind of n pairs of candidates c (path, topic, group, column, interes, ejecucion) that were not seen (a, b) before.

    Half of them are close (at most six places apart by column), three tenths random, the rest a gem against
    a performance; what a kind cannot fill goes to the random ones. The draw is by a hash of the seed and
    the pair, the same on every run; each pair occurs once, and its sides are turned by the hash. So that no table of all pairs is made, each
    file offers, for every kind, the partners next to it in the order of a hash of the seed and file.
    """
    fits, draw = _fits(seed)
    tails = opposite_tails(c)
    rows = tails.select("path", "topic", "group", "gem", "perf", F.col(column).alias("_by"))
    by_score = ranked(rows, [F.col("_by"), F.col("path")], "_key")
    by_hash = ranked(rows, [F.xxhash64(F.lit(seed), "path"), F.col("path")], "_key")

    def neighbours(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
        l = _side(left.withColumn("_near", F.explode(F.sequence(F.col("_key") + 1, F.col("_key") + reach))), "a").drop("_key")  # noqa: E741
        return l.join(_side(right, "b").withColumnRenamed("_key", "_near"), "_near").drop("_near")

    def places(df: DataFrame) -> DataFrame:
        return ranked(df, [F.xxhash64(F.lit(seed), "path"), F.col("path")], "_key")

    gems, perfs = places(rows.where("gem")), places(rows.where("perf"))
    size = perfs.agg(F.greatest(F.max("_key"), F.lit(1)).alias("_m"))
    reach = max(8, n)
    turned = gems.crossJoin(F.broadcast(size)).withColumn("_near", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda i: (F.col("_key") + i) % F.col("_m") + 1))).drop("_key", "_m")
    opposed = _side(turned, "a").join(_side(perfs, "b").withColumnRenamed("_key", "_near"), "_near").drop("_near").distinct()
    kinds = [("gem_vs_perf", opposed), ("parejos", neighbours(by_score, by_score, 6)), ("azar", neighbours(by_hash, by_hash, reach))]
    offered = None
    for place, (kind, pairs) in enumerate(kinds):
        own = pairs.where(fits).select(F.least("path_a", "path_b").alias("x"), F.greatest("path_a", "path_b").alias("y"), F.lit(kind).alias("kind"), F.lit(place).alias("place"), draw.alias("draw")).distinct()
        offered = own if offered is None else offered.unionByName(own)
    if seen is not None:
        old = seen.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        offered = offered.join(old, ["x", "y"], "left_anti")
    # a pair counts for the first kind that takes it; more than n + n of a kind are never wanted
    want = quotas(n)
    first = W.Window.partitionBy("kind").orderBy("draw", "x", "y")
    few = offered.withColumn("i", F.row_number().over(first)).where(F.col("i") <= 3 * n).drop("i")

    def take(pool: DataFrame, kind: str, limit) -> DataFrame:
        own = pool.where(F.col("kind") == kind).withColumn("i", F.row_number().over(W.Window.orderBy("draw", "x", "y")))  # at most 3 n rows
        return own.where(F.col("i") <= limit).drop("i")

    a = take(few, "gem_vs_perf", want["gem_vs_perf"])
    b = take(few.join(a.select("x", "y"), ["x", "y"], "left_anti"), "parejos", want["parejos"])
    have = a.unionByName(b)
    left = few.join(have.select("x", "y"), ["x", "y"], "left_anti").where("kind = 'azar'").withColumn("i", F.row_number().over(W.Window.orderBy("draw", "x", "y")))
    count = have.agg((F.lit(n) - F.count("*")).alias("_want"))  # one row
    filled = left.crossJoin(F.broadcast(count)).where("i <= _want").drop("i", "_want")
    out = have.unionByName(filled)
    turn = F.pmod(F.col("draw"), F.lit(2)) == 0
    out = out.withColumn("num", F.row_number().over(W.Window.orderBy("place", "draw", "x", "y")).cast("long"))  # n rows
    return out.select("num", F.when(turn, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(turn, F.col("y")).otherwise(F.col("x")).alias("b"), "kind")


def next_batch(pairs: DataFrame) -> DataFrame:
    """One row: the number of the next batch."""
    return pairs.agg((F.coalesce(F.max("lote"), F.lit(0)) + 1).alias("lote"))


def new_pairs(drawn: DataFrame, stretches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unanswered rows (lote, num, seg_a, seg_b, tipo) for the table of pairs, of pairs drawn among stretches (path, start, end)."""
    s = stretches.select("path", segment_id().alias("id"))
    out = drawn.join(s.select(F.col("path").alias("a"), F.col("id").alias("seg_a")), "a").join(s.select(F.col("path").alias("b"), F.col("id").alias("seg_b")), "b")
    return out.crossJoin(F.broadcast(next_batch(pairs))).select("lote", "num", "seg_a", "seg_b", F.col("kind").alias("tipo"))


def answered(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """pairs (lote, num, ...) with eleccion, tags and ts of the last answer (lote, num, eleccion, tags, ts), null if there is none.

    Answers outside of CHOICES are left out; see unknown_answers().
    """
    valid = answers.where(F.col("eleccion").isin(*CHOICES))
    last = latest(valid.select("lote", "num", "eleccion", "tags", "ts"), ["lote", "num"], F.struct("ts", "eleccion"))
    return pairs.drop("eleccion", "tags", "ts").join(last, ["lote", "num"], "left")


def unknown_answers(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers whose pair does not exist or whose choice is none, with the reason."""
    known = pairs.select("lote", "num", F.lit(True).alias("_known")).distinct()
    reason = F.when(~F.coalesce(F.col("eleccion").isin(*CHOICES), F.lit(False)), "no choice").when(F.col("_known").isNull(), "no such pair")
    return answers.join(known, ["lote", "num"], "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("_known")


def _sides(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    one = segments.select(F.col("id").alias("seg_a"), F.col("path").alias("path_a"), F.col("start").alias("start_a"))
    two = segments.select(F.col("id").alias("seg_b"), F.col("path").alias("path_b"), F.col("start").alias("start_b"))
    return pairs.join(one, "seg_a").join(two, "seg_b")


def pending(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """lote, num and the names of both sides of the pairs without an answer, sorted."""
    out = _sides(pairs.where("eleccion IS NULL"), segments)
    return out.select("lote", "num", base_name(F.col("path_a")).alias("a"), base_name(F.col("path_b")).alias("b")).orderBy("lote", "num")


def pending_batch(pairs: DataFrame) -> DataFrame:
    """One row: the last batch that has pairs without an answer, to which answers without a batch belong."""
    return pairs.where("eleccion IS NULL").agg(F.max("lote").alias("lote"))


def seen_pairs(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The files of all pairs that were ever made."""
    return _sides(pairs, segments).select(F.col("path_a").alias("a"), F.col("path_b").alias("b"))


def gem_wins(pairs: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """n and wins of the answered pairs of a gem against a performance; the gem is the side with more interest over its execution, and only a choice of it counts."""
    gain = files.select("path", (F.col("interes") - F.col("ejecucion")).alias("gain"))
    p = _sides(pairs.where("tipo = 'gem_vs_perf' AND eleccion IS NOT NULL"), segments)
    p = p.join(gain.select(F.col("path").alias("path_a"), F.col("gain").alias("gain_a")), "path_a").join(gain.select(F.col("path").alias("path_b"), F.col("gain").alias("gain_b")), "path_b")
    first = F.col("gain_a") > F.col("gain_b")
    won = ((F.col("eleccion") == "A") & first) | ((F.col("eleccion") == "B") & ~first)
    return p.agg(F.count("*").alias("n"), F.count_if(won).alias("wins"), F.avg(won.cast("double")).alias("rate"))


def latent_dimensions(strengths: DataFrame, segments: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """item, toma, bt and file columns of the compared segments whose file is known."""
    s = strengths.join(segments.select(F.col("id").alias("item"), "path"), "item")
    return s.join(files.select("path", *columns), "path").select("item", base_name(F.col("path")).alias("toma"), "bt", *columns)


def quotas(n: int) -> dict[str, int]:
    """How many pairs of each kind are asked for, halves rounded to even."""
    close, other = round(n * 0.5), round(n * 0.3)
    return {"parejos": close, "azar": other, "gem_vs_perf": n - close - other}


__all__ = ["answered", "candidates", "draw_pairs", "gem_wins", "latent_dimensions", "new_pairs", "next_batch", "opposite_tails", "pending", "pending_batch", "quota", "quotas", "seen_pairs", "segment_id", "unknown_answers", "with_segments"]
