"""The test tables in the roles of the engine's own: windows, files, votes and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take_path(user: str = "user_id"):
    return F.concat(F.lit("e"), (F.col(user) % 10).cast("string"), F.lit("/u"), F.col(user).cast("string"), F.lit(".mp3"))


def _day_moments(events: DataFrame) -> DataFrame:
    """user_id, widx and the features whose last bits depend on the order of summation, taken in the order of time.

    Ranks tell values apart that differ in their last bit, so equal days must give equal features. Each day is
    read once, in order, by the recurrences of the SQL engine (a plain sum, Welford's deviations, a covariance
    with one rounding a step) and the logarithm of the C library; a day is never held as a whole.
    """

    def run(batches):
        import math

        import pyarrow as pa

        def decibels(x):
            return 20 * math.log10(1e-10 if x is None or x < 1e-10 else x)

        def features():
            mean = total / n if n else None
            rms = decibels(mean)
            out = [*day, rms, decibels(top) - rms]
            if k < 2:
                return (*out, None, None, None, None)
            gap = max(gaps / k, 1e-10)
            slope = (co / k) / (places / k)
            return (*out, math.sqrt(spread / k) / gap, rows * 60 / gap, abs(slope) * k / gap, math.sqrt(deviation / n) if n else None)

        def packed(done, batch):
            types = [f.type for f in batch.schema][:2] + [pa.float64()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        names = ["user_id", "widx", "rms_db", "crest_db", "ibi_cv", "tempo", "tempo_drift", "harmonic_flux"]
        day, done = None, []
        for batch in batches:
            for user, widx, us, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (user, widx) != day:
                    if day is not None:
                        done.append(features())
                    day, last, top = (user, widx), None, None
                    rows = n = k = 0
                    total = mean_value = deviation = 0.0
                    gaps = mean_gap = spread = mean_place = places = co = 0.0
                rows += 1
                if value is not None:
                    n += 1
                    total += value
                    before = value - mean_value
                    mean_value += before / n
                    deviation += (value - mean_value) * before
                    if top is None or value > top or value != value:
                        top = value
                if us is not None and last is not None:
                    k += 1
                    gap = (us - last) / 1e6
                    gaps += gap
                    before, off = gap - mean_gap, rows - mean_place
                    mean_gap += before / k
                    mean_place += off / k
                    spread += (gap - mean_gap) * before
                    places += (rows - mean_place) * off
                    co = math.fma(off, gap - mean_gap, co)
                last = us
            if done:
                yield packed(done, batch)
                done = []
        if day is not None:
            yield packed([features()], batch)

    kinds = dict(events.dtypes)
    rows = events.repartition("user_id", "widx").sortWithinPartitions("user_id", "widx", "us", "event_id").select("user_id", "widx", "us", "value")
    return rows.mapInArrow(run, f"user_id {kinds['user_id']}, widx {kinds['widx']}, rms_db double, crest_db double, ibi_cv double, tempo double, tempo_drift double, harmonic_flux double")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each user, a window for each day with events; features from the day's events."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select("event_id", "user_id", "event_type", "value", day.alias("widx"), micros.alias("us"), F.hour("ts").alias("hour"))
    share = lambda c: F.avg(c.cast("double"))
    chroma = [share(F.floor(F.col("hour") / 2) == i).alias(f"chroma_{i}") for i in range(12)]
    out = e.groupBy("user_id", "widx").agg(
        share(F.col("value") > 100).alias("clip_ratio"),
        share(F.col("event_type") == "error").alias("silence_ratio"),
        share(F.col("event_type") == "view").alias("flatness"),
        share(F.col("event_type") == "click").alias("pulse_clarity"),
        share(F.col("event_type") == "purchase").alias("beat_strength"),
        share(F.col("event_type") == "signup").alias("fuera_tono_med"),
        (F.count("*") / 24.0).alias("onset_rate"),
        (F.max("value") < 1).cast("int").alias("is_silent"),
        share(F.col("value") < 20).alias("onset_dev_mad"),
        share(F.col("value").between(20, 60)).alias("band_sync"),
        share(F.col("us") % 7 < 2).alias("tuning_dev"),
        share(F.col("value") > 80).alias("fuera_tono_p95"),
        *chroma,
    )
    key = F.greatest(*[F.col(f"chroma_{i}") for i in range(12)])
    moments = _day_moments(e).withColumnsRenamed({"user_id": "_user", "widx": "_day"})
    both = out.join(moments, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("widx").eqNullSafe(F.col("_day")))
    return both.select(take_path().alias("path"), "widx", (F.col("widx") * 30.0).alias("start"), *moments.columns[2:], *out.columns[2:], key.alias("key_clarity"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration of each take: 30 s for each day up to its last."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg((F.max(F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date"))) * 30.0 + 30).alias("duration")).select(take_path().alias("path"), "duration")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote events of users on numbered stretches of two compilations: likes, dislikes, stars, notes, and undos of either."""
    e = table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "dislike").when(F.col("event_type").isin("view", "click"), "like").when(F.col("event_type") == "purchase", "star").when(F.col("event_type") == "error", "undo").otherwise("nota")
    undone = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "nota").otherwise("voto"))
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("user_id").alias("usuario"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("compilado"), (n % 10).alias("tramo"), (n % 25).alias("toma"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("evento"), undone.alias("deshace"))


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of three compilations: toma, compilado, tramo, ini, fin."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    g = l.groupBy((F.col("l_orderkey") % 25).alias("toma"), F.col("l_linenumber").cast("long").alias("tramo"), F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("compilado"))
    return g.agg((F.min(F.col("l_partkey") % 600) * 3).cast("double").alias("ini")).where("(toma + tramo) % 4 != 0").withColumn("fin", F.col("ini") + 90)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments (parts) in batches of 50, some of them gems against performances."""
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("lote"), (F.col("p_partkey") % 50).alias("num"), F.col("p_partkey").alias("seg_a"), (F.col("p_partkey") % 97 + 1).alias("seg_b"), F.when(F.col("p_partkey") % 3 == 0, "gem_vs_perf").otherwise("azar").alias("tipo"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment of a file for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"), (F.col("p_size") * 30.0).alias("start"), (F.col("p_size") * 30.0 + 60).alias("end"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to pairs, some twice, to pairs that do not exist, and of words that are no choice."""
    e = table(spark, sf_dir, "events")
    word = F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "ambos", "ninguno", "quizas")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("user_id") % 60).alias("lote"), (F.col("event_id") % 55).alias("num"), word.alias("eleccion"), F.lit(None).cast("string").alias("tags"), F.col("ts").cast("timestamp").alias("ts"))
