"""Contiguous stretches of windows: best runs, streaks, budgets and positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank import model
from takerank.functions.columns import overlap
from takerank.operators.order import ranked, running

HOP = 30.0


def _rolling(column: str, n: int, hop: float) -> tuple[Column, Column]:
    """(mean over the last n rows or null, whether these rows are contiguous) by path and start."""
    order = W.Window.partitionBy("path").orderBy("start")
    frame = order.rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("start").over(frame) == n, F.avg(column).over(frame))
    return mean, F.abs(F.col("start") - F.lag("start", n - 1).over(order) - (n - 1) * hop) < 5e-4


def best_run(windows: DataFrame, n: int, column: str = "score", win: float = HOP, hop: float = HOP) -> DataFrame:
    """path, ini, fin of the best contiguous run of n windows of each file.

    A file of at most n windows gives its whole span; one without a contiguous run its best window.
    """
    mean, contiguous = _rolling(column, n, hop)
    w = windows.select("path", "start", F.col(column).alias("s"), mean.alias("m"), contiguous.alias("ok"))
    run = F.when(F.col("ok"), F.round("m", 9))
    g = w.groupBy("path").agg(
        F.count("*").alias("n"),
        F.min("start").alias("first"),
        F.max("start").alias("last"),
        F.max_by("start", F.when(run.isNotNull(), F.struct(run, -F.col("start")))).alias("end_of_run"),
        F.max_by("start", F.struct(F.round("s", 9), -F.col("start"))).alias("single"),
    )
    short = F.col("n") <= n
    ini = F.when(short, F.col("first")).otherwise(F.coalesce(F.col("end_of_run") - (n - 1) * hop, F.col("single")))
    fin = F.when(short, F.col("last")).otherwise(F.coalesce("end_of_run", "single")) + win
    return g.select("path", ini.alias("ini"), fin.alias("fin"), "n")


def streaks(windows: DataFrame, threshold: Column | float, column: str = "score", least: int = 2, most: int = 0, silence: float = 0.08, win: float = HOP, hop: float = HOP) -> DataFrame:
    """path, island, ini, fin, n, mean and tempo of the contiguous runs of good windows; longer ones are cut to their best ``most``."""
    order = W.Window.partitionBy("path").orderBy("start")
    good = (F.col(column) >= threshold) & (F.coalesce("silence_ratio", F.lit(0.0)) <= silence)
    g = windows.where(good).select("path", "start", F.col(column).alias("s"), "tempo")
    new = F.coalesce(F.abs(F.col("start") - F.lag("start").over(order) - hop) >= 1e-3, F.lit(True))
    g = g.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    size = F.count("*").over(W.Window.partitionBy("path", "island"))
    g = g.withColumn("size", size).where(F.col("size") >= least)
    if most:
        inside = W.Window.partitionBy("path", "island").orderBy("start")
        frame = inside.rowsBetween(-(most - 1), 0)
        g = g.withColumn("m", F.when(F.count("*").over(frame) == most, F.round(F.avg("s").over(frame), 9)))
        whole = W.Window.partitionBy("path", "island")
        g = g.withColumn("stop", F.max_by("start", F.when(F.col("m").isNotNull(), F.struct("m", -F.col("start")))).over(whole))
        g = g.where((F.col("size") <= most) | ((F.col("start") <= F.col("stop")) & (F.col("start") > F.col("stop") - most * hop + 1e-3)))
    out = g.groupBy("path", "island").agg(F.min("start").alias("ini"), (F.max("start") + win).alias("fin"), F.count("*").alias("n"), F.avg("s").alias("mean"), F.median("tempo").alias("tempo"))
    return out


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def capped(df: DataFrame, topic: str, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each topic, in order; rows without a topic are not limited."""
    known = top_per(df.where(F.col(topic).isNotNull()), [topic], order, cap)
    return known.unionByName(df.where(F.col(topic).isNull()))


def budget(segments: DataFrame, order: list[Column], limit: float, length: Column) -> DataFrame:
    """Segments in order while what came before is shorter than the limit; the one that crosses it stays."""
    return running(segments, order, {"before_s": length.cast("double")}).where(F.col("before_s") < limit)


def positions(segments: DataFrame, order: list[Column], crossfade: float, length: Column) -> DataFrame:
    """Nominal position of each segment of a playlist."""
    return running(segments, order, {"pos_s": (length - crossfade).cast("double")})


def criterion(column: str) -> str:
    """The window column by which stretches are chosen: what a file alone has gives way to the score."""
    return column if column in (*model.WINDOW_DIMENSIONS, "ejec_ventana", "ejec_limpia") else "score"


def long_enough(pieces: DataFrame, crossfade: float) -> DataFrame:
    """Pieces (ini, fin) of at least two crossfades."""
    return pieces.where(F.col("fin") - F.col("ini") >= 2 * crossfade)


def level_gains(pieces: DataFrame, level: str = "dbfs", cap: float = -16.0) -> DataFrame:
    """pieces with gain_db: what lifts a piece to the loudest one, at most to the cap; silence and what is within 0.5 dB stay."""
    loud = pieces.where(F.col(level) > float("-inf")).agg(F.least(F.max(level), F.lit(cap)).alias("_target"))  # one row
    low = F.col(level) < F.coalesce("_target", F.lit(cap)) - 0.5
    gain = F.when(low & (F.col(level) > float("-inf")), F.coalesce("_target", F.lit(cap)) - F.col(level)).otherwise(0.0)
    return pieces.crossJoin(F.broadcast(loud)).withColumn("gain_db", gain).drop("_target")


def snap_to_beat(points: DataFrame, beats: DataFrame, at: str = "t", margin: float = 1.5) -> DataFrame:
    """points (path, t) with snapped: the nearest beat (path, beat) of the file within the margin, the earlier of two as near; else t.

    Beats and points meet in buckets of the margin's length, so that a file's beats are not all compared with all its points.
    """
    places = points.select("path", F.col(at).alias("_t")).distinct()
    bucket = F.floor(F.col("_t") / margin)
    near = places.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    found = near.join(beats.select("path", "beat", F.floor(F.col("beat") / margin).alias("_bucket")), ["path", "_bucket"]).where(F.abs(F.col("beat") - F.col("_t")) <= margin)
    best = found.groupBy(F.col("path").alias("_path"), "_t").agg(F.min_by("beat", F.struct(F.abs(F.col("beat") - F.col("_t")), "beat")).alias("_beat"))
    out = points.join(best, (F.col("path") == F.col("_path")) & (F.col(at) == F.col("_t")), "left")
    return out.select(*points.columns, F.coalesce("_beat", at).alias("snapped"))


def in_selection_order(df: DataFrame, chosen: DataFrame, key: str = "path", place: str = "pick") -> DataFrame:
    """The rows of df that were chosen (key, place), with their place, sorted by it."""
    return df.join(chosen.select(key, place), key).orderBy(place)


def fresh_streaks(windows: DataFrame, threshold: Column | float, used: DataFrame, k: int, spare: int = 4, **options) -> DataFrame:
    """The k best streaks of each file that no used stretch covers: some to spare are taken first, so that what is left can take their place."""
    best = [F.round("mean", 9).desc(), F.col("ini")]
    found = top_per(streaks(windows, threshold, **options), ["path"], best, k + spare)
    return top_per(avoid_used(found, used), ["path"], best, k)


def tempo_chain(pieces: DataFrame, order: list[Column]) -> DataFrame:
    """path, ini, fin, tempo and position of the pieces of one playlist, chained by tempo.

    The slowest piece begins; then always comes the nearest in tempo (an octave costs 0.15, a piece of the
    same file is 0.05 nearer), of equal ones the earliest start, then the slower, then the first in order.
    Each step needs the one before, so the chain is made in one task: of a playlist that a budget bounds.
    """
    rows = ranked(pieces, order, "place").select("path", *[F.col(c).cast("double").alias(c) for c in ("ini", "fin", "tempo")], "place")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.assign(slow=pdf.tempo.fillna(1e9)).sort_values(["slow", "place"]).reset_index(drop=True)
        tempo, ini, path = p.tempo.to_numpy(float), p.ini.to_numpy(float), p.path.to_numpy()
        left, taken = np.arange(1, len(p)), [0]
        while len(left):
            now = taken[-1]
            with np.errstate(all="ignore"):
                cost = np.min([np.abs(np.log(tempo[now] / (tempo[left] * m))) + (0.0 if m == 1 else 0.15) for m in (0.5, 1.0, 2.0)], axis=0)
            cost = np.where((tempo[now] > 0) & (tempo[left] > 0), cost, 1.0) - 0.05 * (path[left] == path[now])
            i = np.lexsort((left, ini[left], np.round(cost, 9)))[0]
            taken.append(int(left[i]))
            left = np.delete(left, i)
        out = p.iloc[taken][["path", "ini", "fin", "tempo"]].reset_index(drop=True)
        return out.assign(position=np.arange(1, len(out) + 1, dtype=np.int64))

    return rows.groupBy().applyInPandas(chain, "path string, ini double, fin double, tempo double, position long")


def avoid_used(segments: DataFrame, used: DataFrame) -> DataFrame:
    """Segments (path, ini, fin) that share at most half of the shorter length with any used one of their file."""
    u = used.select(F.col("path").alias("u_path"), F.col("ini").alias("u_ini"), F.col("fin").alias("u_fin"))
    shared = overlap(F.col("ini"), F.col("fin"), F.col("u_ini"), F.col("u_fin"))
    shorter = F.least(F.col("fin") - F.col("ini"), F.col("u_fin") - F.col("u_ini"))
    return segments.join(u, (F.col("path") == F.col("u_path")) & (shared > 0) & (shared > shorter / 2), "left_anti")


def segment_medians(segments: DataFrame, windows: DataFrame, columns: list[str]) -> DataFrame:
    """Medians of window columns over each segment (path, ini, fin); null for a segment without windows."""
    w = windows.select(F.col("path").alias("w_path"), F.col("start").alias("w_start"), *[F.col(c).alias(f"w_{c}") for c in columns])
    j = segments.join(w, (F.col("path") == F.col("w_path")) & (F.col("w_start") >= F.col("ini") - 1) & (F.col("w_start") < F.col("fin") - 1), "left")
    return j.groupBy(*segments.columns).agg(*[F.median(f"w_{c}").alias(f"med_{c}") for c in columns])


def tempo_adjusted(playlist: DataFrame, order: str, most: float = 0.04) -> DataFrame:
    """Playlist rows with the ratio by which each is stretched to the tempo before it: a fold over one playlist."""
    rows = F.sort_array(F.collect_list(F.struct(order, "path", "ini", "tempo")))
    empty = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        options = F.transform(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), lambda m: F.struct(F.abs(s.prev / (x.tempo * m) - 1).alias("off"), (s.prev / (x.tempo * m)).alias("r")))
        ratio = F.when((s.prev > 0) & (x.tempo > 0), F.array_min(options).r)
        used = F.when(F.abs(ratio - 1) <= most, ratio).otherwise(1.0)
        return F.struct(F.coalesce(x.tempo * used, s.prev).alias("prev"), F.concat(s.out, F.array(used)).alias("out"))

    folded = playlist.agg(rows.alias("rows")).select("rows", F.aggregate("rows", empty, step, lambda s: s.out).alias("ratios"))
    return folded.select(F.explode(F.arrays_zip("rows", "ratios")).alias("z")).select(f"z.rows.{order}", "z.rows.path", "z.rows.ini", F.col("z.ratios").alias("ratio"))
