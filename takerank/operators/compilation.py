"""Compilations: their documents and reports, and scores made anew for documents that are out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takerank.functions.columns import base_name, clock, fixed
from takerank.operators.scoring import quantile_row
from takerank.operators.segments import segment_medians

DISTRIBUTION = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
WINDOW_DIMS = ("timing", "groove", "afinacion", "tonal_outlier", "sonido")
FILE_DIMS = ("interes", "creatividad", "desarrollo", "ejecucion")


def score_distribution(windows: DataFrame, digits: int = 4) -> DataFrame:
    """One row: least, quantiles and greatest of all window scores."""
    q = quantile_row(windows, "score", {"min": 0.0, **DISTRIBUTION, "max": 1.0})
    return q.select(*[F.bround(c, digits).alias(c) for c in q.columns])


def unique_names(files: DataFrame) -> DataFrame:
    """toma and path of the files whose name no other file has."""
    return files.select(base_name(F.col("path")).alias("toma"), "path").groupBy("toma").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")


def rescored(stretches: DataFrame, windows: DataFrame, files: DataFrame) -> DataFrame:
    """stretches (compilado, tramo, toma, origen_ini_s, origen_fin_s, score, ...) with score, dimensions, change and has_data computed anew.

    A stretch whose take is not known, is the name of several files, or has no windows keeps what it had, and its change is null; all
    other columns, positions among them, stay as they are. Window dimensions are medians over the stretch,
    file dimensions those of the file.
    """
    known = stretches.select("compilado", "tramo", "toma", F.col("origen_ini_s").alias("ini"), F.col("origen_fin_s").alias("fin")).join(unique_names(files), "toma")
    there = [c for c in ("score", *WINDOW_DIMS) if c in windows.columns]
    med = segment_medians(known.select("compilado", "tramo", "path", "ini", "fin"), windows, there).where("med_score IS NOT NULL")
    dims = [c for c in FILE_DIMS if c in files.columns]
    new = med.join(files.select("path", *[F.col(c).alias(f"med_{c}") for c in dims]), "path", "left").select("compilado", "tramo", *[F.bround(f"med_{c}", 3).alias(f"med_{c}") for c in [*there, *dims]])
    out = stretches.join(new, ["compilado", "tramo"], "left")
    fresh = {c: F.coalesce(F.col(f"med_{c}"), F.col(c)) if c in stretches.columns else F.col(f"med_{c}") for c in [*there, *dims]}
    return out.withColumns({"change": F.col("med_score") - F.col("score"), "has_data": F.col("med_score").isNotNull()}).withColumns(fresh).drop(*[f"med_{c}" for c in [*there, *dims]])


def rescoring_report(stretches: DataFrame) -> DataFrame:
    """For each compilation of rescored(): stretches, those without data, and the upper median and greatest of the absolute changes (0 without any)."""
    size = F.abs("change")
    changes = F.sort_array(F.collect_list(size))  # of one compilation
    g = stretches.groupBy("compilado").agg(F.count("*").alias("stretches"), F.count_if(~F.col("has_data")).alias("without_data"), changes.alias("c"))
    return g.select("compilado", "stretches", "without_data", F.coalesce(F.get("c", F.floor(F.size("c") / 2).cast("int")), F.lit(0.0)).alias("median_change"), F.coalesce(F.array_max("c"), F.lit(0.0)).alias("max_change"))


def documents(stretches: DataFrame, distribution: DataFrame) -> DataFrame:
    """One nested document for each compilation: its stretches in order and the distribution of the scores."""
    rest = [c for c in stretches.columns if c not in {"compilado", "perfil", "change", "has_data"}]
    listed = stretches.groupBy("compilado", "perfil").agg(F.sort_array(F.collect_list(F.struct("tramo", *[c for c in rest if c != "tramo"]))).alias("tramos"))
    return listed.crossJoin(F.broadcast(distribution.select(F.struct("*").alias("score_dist"))))


def report_lines(playlist: DataFrame, title: str, parameters: str) -> DataFrame:
    """i and line of the text report of a playlist (place, pos_s, path, ini, fin, tempo, score, dimensions)."""
    two = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "nan").otherwise(fixed(F.col(c), 2)) if c in playlist.columns else F.lit("nan")
    lines = F.array(
        F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 6 - F.length(clock(F.col("pos_s"))))), clock(F.col("pos_s")), F.lit("  "), base_name(F.col("path"))),
        F.concat(F.lit("        "), clock(F.col("ini")), F.lit("-"), clock(F.col("fin")), F.concat(F.lit("  "), fixed(F.col("fin") - F.col("ini"), 0), F.lit("s  ")), F.when(F.col("tempo").isNull(), "nan").otherwise(fixed(F.col("tempo"), 1)), F.lit("bpm")),
        F.concat(F.lit("        tramo: score "), two("score"), F.lit(" | tim "), two("timing"), F.lit(" gro "), two("groove"), F.lit(" afi "), two("afinacion"), F.lit(" ton "), two("tonal_outlier"), F.lit(" son "), two("sonido")),
        F.concat(F.lit("        toma:  ejec "), two("ejecucion"), F.lit(" | int "), two("interes"), F.lit(" cre "), two("creatividad"), F.lit(" des "), two("desarrollo")),
    )
    body = playlist.select("place", F.posexplode(lines).alias("k", "line")).select((F.col("place") * 4 + F.col("k")).cast("long").alias("i"), "line")
    head = playlist.sparkSession.createDataFrame([(-3, f"COMPILADO {title}"), (-2, parameters), (-1, "")], "i long, line string")
    return head.unionByName(body).orderBy("i")
