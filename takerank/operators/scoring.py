"""Percentile normalisation, window dimensions and scores, and their reduction to files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank import model
from takerank.functions.columns import base_name, clock, folder, number
from takerank.model import Settings
from takerank.operators.order import ranked
from takerank.operators.shared import saved

#: Parts into which the values of a feature are cut for ranking, so that no task holds a whole feature.
PARTS = 64


#: A value that more than one in so many rows of a feature hold is hot; a feature has fewer such values than that.
HOT = 1000


def _long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(F.col(f)).alias("x")) for f in features])).alias("v")).select(*keys, "v.feature", "v.x")


def value_counts(long: DataFrame) -> DataFrame:
    """feature, x, c, start and n: each value with its count, the number of smaller ones and of all, without nulls.

    Equal values are counted before they are sorted, the sorted values are cut at approximate quantiles,
    and each part adds the counts of the parts before it. The counts are stored, as all that follows reads them.
    """
    counts = saved(long.where("x IS NOT NULL").groupBy("feature", "x").agg(F.count("*").alias("c")))
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"))
    # a row for each feature, whose number is that of the columns
    parts = counts.join(F.broadcast(cuts), "feature").withColumn("part", F.size(F.filter("cuts", lambda q: q < F.col("x"))))
    sums = parts.groupBy("feature", "part").agg(F.sum("c").alias("own"))
    in_feature = W.Window.partitionBy("feature")
    sums = sums.select("feature", "part", F.coalesce(F.sum("own").over(in_feature.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("own").over(in_feature).alias("n"))
    run = F.sum("c").over(W.Window.partitionBy("feature", "part").orderBy("x"))
    ranks = parts.withColumn("run", run).join(F.broadcast(sums), ["feature", "part"])  # at most PARTS rows a feature
    return ranks.select("feature", "x", "c", (F.col("before") + F.col("run") - F.col("c")).alias("start"), "n")


def _quantile(q: float) -> tuple[Column, Column]:
    """The values at the places below and above a quantile, over rows of value_counts()."""
    place = q * (F.col("n") - 1)
    held = lambda p: F.max(F.when((F.col("start") <= p) & (p < F.col("start") + F.col("c")), F.col("x")))
    low, high = held(F.floor(place)), held(F.ceil(place))
    return low, high


def quantiles(counts: DataFrame, qs: dict[str, float]) -> DataFrame:
    """feature, n and exact quantiles, interpolated between values, of value_counts()."""
    cols = [c.alias(f"_{side}{name}") for name, q in qs.items() for side, c in zip("lh", _quantile(q), strict=True)]
    out = counts.groupBy("feature").agg(F.max("n").alias("n"), *cols)
    mix = lambda name, q: F.col(f"_l{name}") + (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))) * (F.col(f"_h{name}") - F.col(f"_l{name}"))
    return out.select("feature", "n", *[mix(name, q).alias(name) for name, q in qs.items()])


def quantile_row(df: DataFrame, column: str, qs: dict[str, float]) -> DataFrame:
    """One row of exact quantiles of a column over all rows."""
    found = quantiles(value_counts(_long(df, [], [column])), qs)
    return found.agg(*[F.max(name).alias(name) for name in qs])


def percentile_ranks(df: DataFrame, keys: list[str], features: Iterable[str]) -> DataFrame:
    """keys, feature and rank in (0, 1]: average rank over the non-null values of the corpus.

    Null ranks 0.5, and so does a feature with at most one value. The ranks of hot values are broadcast,
    so that rows with such a value do not meet in a task; the others are joined.
    """
    features = list(dict.fromkeys(features))
    long = _long(df, keys, features)
    ranks = value_counts(long).withColumn("rank", F.when(F.col("n") > 1, (F.col("start") + (F.col("c") + 1) / 2) / F.col("n")).otherwise(0.5))
    hot = F.col("c") * HOT > F.col("n")
    few = ranks.where(hot).select("feature", "x", F.col("rank").alias("hot_rank"))  # fewer than HOT rows a feature
    marked = long.join(F.broadcast(few), ["feature", "x"], "left")
    # rows that need no other rank are dealt out over as many tasks, where they meet nothing
    done = F.col("hot_rank").isNotNull() | F.col("x").isNull()
    marked = marked.withColumns({"_x": F.when(~done, F.col("x")), "_deal": F.when(done, F.pmod(F.xxhash64(*keys), F.lit(HOT))).otherwise(0)})
    rest = ranks.where(~hot).select("feature", F.col("x").alias("_x"), F.lit(0).cast("long").alias("_deal"), "rank")
    return marked.join(rest, ["feature", "_x", "_deal"], "left").select(*keys, "feature", F.coalesce("hot_rank", "rank", F.lit(0.5)).alias("rank"))


def dimensions(df: DataFrame, keys: list[str], specs: dict[str, dict[str, tuple[int, float]]]) -> DataFrame:
    """keys and the dimensions: weighted sums of directed ranks. The weight of a missing feature stays in the denominator."""
    there = [f for spec in specs.values() for f in spec if f in df.columns]
    if not there:
        return df.select(*keys, *[F.lit(0.0).alias(d) for d in specs])
    ranks = percentile_ranks(df, keys, there)

    def score(spec: dict[str, tuple[int, float]]) -> Column:
        own = [F.when(F.col("feature") == f, w * (F.col("rank") if d > 0 else 1 - F.col("rank"))) for f, (d, w) in spec.items() if f in df.columns]
        return F.coalesce(F.sum(F.coalesce(*own)), F.lit(0.0)) / sum(w for _, w in spec.values()) if own else F.lit(0.0)

    return ranks.groupBy(*keys).agg(*[score(spec).alias(d) for d, spec in specs.items()])


def combo(names: Iterable[str], there: Iterable[str], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the dimensions that are there; a plain mean if all weights are 0; 0.5 without any."""
    weights = model.WEIGHTS if weights is None else weights
    names = [n for n in names if n in set(there)]
    if not names:
        return F.lit(0.5)
    own = {n: float(weights.get(n, 0.0)) for n in names}
    if sum(own.values()) <= 0:
        own = dict.fromkeys(names, 1.0)
    total = sum(own.values())
    return reduce(lambda a, b: a + b, (F.col(n) * (w / total) for n, w in own.items()))


def audible(df: DataFrame) -> DataFrame:
    """Windows with a signal."""
    if "is_silent" in df.columns:
        return df.where(F.coalesce("is_silent", F.lit(0)) == 0)
    return df.where(F.coalesce(number(F.col("rms_db")), F.lit(0.0)) > -60) if "rms_db" in df.columns else df


def score_windows(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """df (path, widx, start, features) with the window dimensions, ejec_ventana, ejec_limpia and score."""
    s = settings or Settings()
    df = audible(df)
    dims = dimensions(df, ["path", "widx"], model.WINDOW_DIMENSIONS)
    out = df.join(dims, ["path", "widx"])
    if s.mode == "veto":
        out = saved(out)
        least = quantile_row(out, "sonido", {"least": s.least_sound})
        out = out.crossJoin(F.broadcast(least)).where("sonido >= least").drop("least")
    there = out.columns
    out = out.withColumns({"ejec_ventana": combo(model.EXECUTION, there, s.weights), "ejec_limpia": combo(model.EXECUTION_CLEAN, there, s.weights)})
    base = F.col("ejec_limpia" if s.idea else "ejec_ventana")
    return out.withColumn("score", base if s.mode == "veto" else s.weight_sound * F.col("sonido") + s.weight_execution * base)


def _file_features(there: list[str]) -> list[Column]:
    tempo = F.when(F.col("tempo") > 0, F.col("tempo"))
    out = [F.when(F.count(tempo) >= 3, 1 - F.stddev_samp(tempo) / F.avg(tempo)).alias("tempo_consistency")] if "tempo" in there else [F.lit(None).cast("double").alias("tempo_consistency")]
    out.append(F.when(F.count("rms_db") >= 3, F.percentile("rms_db", F.lit(0.9)) - F.percentile("rms_db", F.lit(0.1))).alias("arco_dinamico") if "rms_db" in there else F.lit(None).cast("double").alias("arco_dinamico"))
    if set(model.CHROMA) <= set(there):
        # the mean cosine over all pairs from the sum of the unit vectors, without the pairs
        length = F.greatest(F.sqrt(reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in model.CHROMA))), F.lit(1e-10))
        n = F.count("*")
        whole = reduce(lambda a, b: a + b, (F.pow(F.sum(F.col(c) / length), 2) for c in model.CHROMA))
        own = F.sum(reduce(lambda a, b: a + b, (F.pow(F.col(c) / length, 2) for c in model.CHROMA)))
        complete = F.count(reduce(lambda a, b: a + b, (F.col(c) for c in model.CHROMA))) == n
        out.append(F.when((n >= 3) & complete, 1 - (whole - own) / (n * (n - 1))).alias("novedad_armonica"))
    else:
        out.append(F.lit(None).cast("double").alias("novedad_armonica"))
    rate = F.when((F.count("onset_rate") >= 3) & (F.avg("onset_rate") > 0), F.stddev_samp("onset_rate") / F.greatest(F.avg("onset_rate"), F.lit(1e-9))) if "onset_rate" in there else F.lit(None).cast("double")
    out.append(rate.alias("variedad_textura"))
    out.append(F.median("harmonic_flux").alias("harmonic_flux") if "harmonic_flux" in there else F.lit(None).cast("double").alias("harmonic_flux"))
    return out


def aggregate_files(windows: DataFrame, files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row a file: dimensions, composites, scores by profile and the best start; windows: of score_windows()."""
    s = settings or Settings()
    there = windows.columns
    best = F.max_by("start", F.struct(F.round("score", 9), -F.col("start")))
    diagnostics = [F.median(c).alias(c) for c in model.DIAGNOSTIC if c in there and c != "harmonic_flux"]
    d = windows.groupBy("path").agg(
        F.count("*").alias("n_win"),
        best.alias("best_start_s"),
        *[F.median(x).alias(x) for x in model.WINDOW_DIMENSIONS],
        F.median("score").alias("_med"),
        F.percentile("score", F.lit(s.best_quantile)).alias("_best"),
        *_file_features(there),
        *diagnostics,
    )
    # ranks must not depend on the order of summation
    d = d.withColumns({f: F.round(f, 9) for spec in model.FILE_DIMENSIONS.values() for f in spec if f in d.columns})
    d = d.join(files.select("path", "duration"), "path", "left").withColumn("dur_min", F.round(F.coalesce("duration", F.lit(0.0)) / 60, 2)).drop("duration")
    d = d.join(dimensions(d, ["path"], model.FILE_DIMENSIONS), "path")
    there = d.columns
    d = d.withColumns({"ejecucion": combo(model.EXECUTION, there, s.weights), "interes": combo(model.INTEREST, there, s.weights), "balance": combo(model.BALANCE, there, s.weights)})
    d = d.withColumn("gems", F.col("interes") * (1 - F.col("ejecucion")))
    base = F.col(model.PROFILES[s.profile])
    if s.mode != "veto" and not s.idea:
        base = s.weight_sound * F.col("sonido") + s.weight_execution * base
    share = 0.2 if s.idea else 0.5
    d = d.withColumns({"score_med_raw": (1 - share) * base + share * F.col("_med"), "score_best_raw": F.col("_best")})
    w = F.col("n_win") / (F.col("n_win") + s.shrink)
    d = d.withColumns({c: w * F.col(f"{c}_raw") + (1 - w) * 0.5 for c in ("score_med", "score_best")})
    return d.withColumns({"toma": base_name(F.col("path")), "ensayo": folder(F.col("path")), "best_start": clock(F.col("best_start_s"))}).drop("_med", "_best")


def diagnose(df: DataFrame, features: Iterable[str] | None = None) -> DataFrame:
    """For each feature: exact quantiles, spread against the median, nulls and distinct values; features without a value are left out."""
    if features is None:
        specs = [*model.WINDOW_DIMENSIONS.values(), *model.FILE_DIMENSIONS.values()]
        features = dict.fromkeys([f for spec in specs for f in spec] + list(model.DIAGNOSTIC))
    features = [f for f in features if f in df.columns]
    counts = value_counts(_long(df, [], features))
    out = quantiles(counts, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    ends = counts.groupBy("feature").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.count("*").alias("n_distinct"))
    rows = df.agg(F.count("*").alias("rows"))
    out = out.join(F.broadcast(ends), "feature").crossJoin(F.broadcast(rows))  # a row a feature
    ratio = (F.col("p75") - F.col("p25")) / F.greatest(F.abs("p50"), F.lit(1e-9))
    return out.select("feature", "min", "p10", "p50", "p90", "max", (F.col("rows") - F.col("n")).alias("n_null"), "n_distinct", ratio.alias("spread"), (ratio < 0.05).alias("suspicious"))


def rank_files(files: DataFrame, by: str = "score_med", least_windows: int = 0, top: int | None = None) -> DataFrame:
    """Files by a column, best first, with their rank; ties go by path."""
    out = files.where(F.col("n_win") >= least_windows) if least_windows else files
    order = [F.col(by).desc_nulls_last(), F.col("path")]
    if top is not None:
        out = out.orderBy(*order).limit(top)  # the rank below is taken over these rows only
    return ranked(out, order)


def folder_scaled(df: DataFrame, folder: str, column: str, name: str = "scaled") -> DataFrame:
    """df with a column scaled to 0 to 1 between the least and greatest of its folder; 0.5 where they are equal."""
    ends = df.groupBy(folder).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return df.join(ends, folder).withColumn(name, scaled).drop("_lo", "_hi")


def onset_spread(onsets: DataFrame, file: str, beat: str, position: str, default: float = 0.05) -> DataFrame:
    """For each file the median, over beats with two onsets or more, of the standard deviation of their positions."""
    g = onsets.groupBy(file, beat).agg(F.stddev_pop(position).alias("_s"), F.count("*").alias("_n"))
    return g.groupBy(file).agg(F.coalesce(F.median(F.when(F.col("_n") >= 2, F.col("_s"))), F.lit(default)).alias("spread"))


def moving_average(df: DataFrame, keys: list[str], order: str, column: str, width: int, name: str = "context") -> DataFrame:
    """df with the mean over so many rows around each, missing ones counting as 0."""
    frame = W.Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(name, F.sum(column).over(frame) / width)


__all__ = ["aggregate_files", "audible", "combo", "diagnose", "dimensions", "folder_scaled", "moving_average", "onset_spread", "percentile_ranks", "quantile_row", "quantiles", "rank_files", "ranked", "score_windows", "value_counts"]
