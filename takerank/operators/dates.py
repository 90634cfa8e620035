"""Dates of files: which one counts, ranges of them, and names of ranges."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takerank.functions.columns import local_day, month_folder, utc
from takerank.operators.ledger import last_session


def file_dates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, mtime, ...) with date: of the remote manifest (local_path, modtime, btime if there), its creation before its change, else mtime.

    Texts in ISO 8601 are read as UTC. Of several manifest rows of a path the one of the latest change counts.
    """
    made = F.nullif(F.col("btime"), F.lit("")) if "btime" in manifest.columns else F.lit(None).cast("string")
    m = manifest.where("local_path IS NOT NULL").select(F.col("local_path").alias("path"), utc(F.coalesce(made, "modtime")).alias("_date"), F.col("modtime").alias("_mod"))
    m = m.groupBy("path").agg(F.max_by("_date", F.struct("_mod", "_date")).alias("_date"))
    return files.join(m, "path", "left").withColumn("date", F.coalesce("_date", "mtime")).drop("_date")


def since(months: int | None = None, day: str | None = None, now: datetime | None = None) -> datetime | None:
    """The instant from which files count: a day, or so many months of 30 days ago."""
    if day:
        at = datetime.fromisoformat(day)
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (now or datetime.now(timezone.utc)) - timedelta(days=30 * months) if months else None


def by_date(df: DataFrame, date: str, since: Column | None = None, until: Column | None = None, last: bool = False, hours: float = 12.0) -> DataFrame:
    """Rows with a date, from since on, before until, and if asked for only the last chain of uploads."""
    out = df.where(F.col(date).isNotNull())
    out = out if since is None else out.where(F.col(date) >= since)
    out = out if until is None else out.where(F.col(date) < until)
    return last_session(out, date, hours) if last else out


def range_label(df: DataFrame, date: str, year: int | None = None, last: bool = False, months: int | None = None, since: datetime | None = None, tz: str = "UTC") -> DataFrame:
    """One row with the short name of the range that df was filtered by."""
    newest = df.agg(F.max(date).alias("newest"))
    day = local_day(F.col("newest"), tz)
    if year:
        label = F.lit(str(year))
    elif last:
        label = F.when(F.col("newest").isNotNull(), F.concat(F.lit("sesion-"), day.cast("string"))).otherwise("todo")
    elif months:
        label = F.when(F.col("newest").isNotNull(), F.concat(F.lit(f"{months}meses-hasta-"), month_folder(day))).otherwise("todo")
    elif since:
        label = F.when(F.col("newest").isNotNull(), F.lit(f"desde-{since.date().isoformat()}")).otherwise("todo")
    else:
        label = F.lit("todo")
    return newest.select(label.alias("label"))
