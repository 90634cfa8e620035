"""The registered queries: the engine's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank import model
from takerank.functions import columns as fx
from takerank.model import Settings
from takerank.operators import compilation, dates, duplicates, evaluation, feedback, ledger, scoring, segments
from takerank.sources import adapters
from takerank.sources import files as stores
from takerank.sources.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _scored(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scoring.score_windows(adapters.windows(spark, sf_dir), Settings(**options))


def _files(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    s = Settings(**options)
    windows = duplicates.saved(adapters.windows(spark, sf_dir))  # read several times
    return scoring.aggregate_files(scoring.score_windows(windows, s), adapters.files(spark, sf_dir), s)


@query
def window_scan_semi(spark, sf_dir):
    live = table(spark, sf_dir, "events").groupBy("user_id").count().where("count >= 60").select(adapters.take_path().alias("path"))
    return rounded(adapters.windows(spark, sf_dir).join(live, "path", "left_semi").select("path", "widx", "start", "rms_db", "ibi_cv"))


@query
def hop_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars >= 250")
    i = F.sequence(F.lit(0).cast("long"), fx.window_count(F.col("n_chars"), 400, 250) - 1)
    return d.select("doc_id", F.explode(F.transform(i, lambda x: x * 400)).alias("start"))


@query
def rank_norm_features(spark, sf_dir):
    keys, names = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_extendedprice"]
    # lines of an order may share a number, so a row is known by its place among equal ones too
    rows = table(spark, sf_dir, "lineitem").select(*keys, *names)
    rows = rows.withColumn("copy", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*names)))
    ranks = scoring.percentile_ranks(rows, [*keys, "copy"], names)
    return rounded(ranks.groupBy(*keys, "copy").pivot("feature", names).agg(F.first("rank")).drop("copy"))


@query
def window_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("path", "widx", *model.WINDOW_DIMENSIONS, "ejec_ventana", "ejec_limpia", "score"))


@query
def window_scores_veto(spark, sf_dir):
    return rounded(_scored(spark, sf_dir, mode="veto").select("path", "widx", "sonido", "score"))


FILE_COLUMNS = ["path", "n_win", "best_start_s", *model.WINDOW_DIMENSIONS, *model.FILE_DIMENSIONS, "ejecucion", "interes", "balance", "gems", "score_med", "score_best"]


def _register_profiles() -> None:
    for p in model.PROFILES:
        QUERIES[f"file_score_{p}"] = lambda spark, sf_dir, p=p: rounded(_files(spark, sf_dir, profile=p).select(*FILE_COLUMNS))


_register_profiles()


@query
def file_score_veto(spark, sf_dir):
    return rounded(_files(spark, sf_dir, mode="veto").select(*FILE_COLUMNS))


@query
def take_ranking(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("by", F.round("score_med", 9))
    return rounded(scoring.rank_files(files, "by").select("path", "n_win", "best_start_s", "score_med", "rank"))


@query
def feature_diagnose(spark, sf_dir):
    return rounded(scoring.diagnose(rounded(adapters.windows(spark, sf_dir), 9)))


def _letters(spark, sf_dir) -> DataFrame:
    low = F.lower("text")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    d = table(spark, sf_dir, "documents")
    counted = duplicates.saved(d.select(F.col("doc_id").alias("path"), F.col("n_chars").cast("double").alias("duration"), counts.alias("v"), "n_chars"))  # read several times
    return counted.withColumn("sig", fx.unit(F.col("v"))).drop("v")


@query
def dedupe_edges(spark, sf_dir):
    return rounded(duplicates.duplicate_edges(_letters(spark, sf_dir)))


@query
def dup_groups(spark, sf_dir):
    return duplicates.duplicate_groups(_letters(spark, sf_dir)).select(F.col("path").alias("doc_id"), "group")


@query
def dedupe_first(spark, sf_dir):
    d = _letters(spark, sf_dir)
    grouped = d.join(duplicates.duplicate_groups(d), "path")
    return duplicates.first_of_group(grouped, "group", [F.col("n_chars").desc(), F.col("path")]).select(F.col("path").alias("doc_id"), "group")


def _topics(spark, sf_dir) -> DataFrame:
    return duplicates.topics(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_name", share=0.3)


@query
def topic_of_name(spark, sf_dir):
    return _topics(spark, sf_dir).select("p_partkey", "topic")


@query
def topic_cap(spark, sf_dir):
    return segments.capped(_topics(spark, sf_dir), "topic", [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_partkey", "topic")


@query
def diverse_selection(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("sig"))
    return duplicates.diverse(e, [F.col("vec_id")], 50, 0.3).select("vec_id", "pick")


@query
def best_run(spark, sf_dir):
    return segments.best_run(_scored(spark, sf_dir), 3)


def _streaks(spark, sf_dir, **options) -> DataFrame:
    w = duplicates.saved(_scored(spark, sf_dir).select("path", "start", "score", "timing", "silence_ratio", "tempo"))
    threshold = scoring.quantile_row(w, "score", {"q": 0.6})
    return segments.streaks(w.crossJoin(F.broadcast(threshold)), F.col("q"), silence=0.2, **options)


def _ordered(df: DataFrame) -> tuple[DataFrame, list]:
    return df, [F.round("mean", 9).desc(), F.col("path"), F.col("ini")]


@query
def streaks(spark, sf_dir):
    return rounded(_streaks(spark, sf_dir))


@query
def streak_trim(spark, sf_dir):
    return rounded(_streaks(spark, sf_dir, most=2).drop("tempo"))


@query
def streak_topk(spark, sf_dir):
    return rounded(segments.top_per(_streaks(spark, sf_dir), ["path"], [F.round("mean", 9).desc(), F.col("ini")], 2).select("path", "ini", "fin", "mean"))


@query
def budget_cut(spark, sf_dir):
    s, order = _ordered(_streaks(spark, sf_dir))
    return segments.budget(s, order, 3600, F.col("fin") - F.col("ini")).select("path", "ini", "fin", "before_s")


@query
def playlist_positions(spark, sf_dir):
    s, order = _ordered(_streaks(spark, sf_dir))
    return segments.positions(s, order, 2.0, F.col("fin") - F.col("ini")).select("path", "ini", "fin", "pos_s")


@query
def overlap_avoid(spark, sf_dir):
    return segments.avoid_used(_streaks(spark, sf_dir).select("path", "ini", "fin"), segments.best_run(_scored(spark, sf_dir), 3))


@query
def segment_medians(spark, sf_dir):
    return rounded(segments.segment_medians(_streaks(spark, sf_dir).select("path", "ini", "fin"), _scored(spark, sf_dir), ["score", "timing"]))


@query
def score_dist(spark, sf_dir):
    return compilation.score_distribution(_scored(spark, sf_dir), 6)


@query
def date_range(spark, sf_dir):
    return ledger.in_range(table(spark, sf_dir, "orders"), "o_orderdate", "1996-03-01", "1996-06-01").select("o_orderkey", "o_orderdate")


@query
def calendar_year(spark, sf_dir):
    o = ledger.in_year(table(spark, sf_dir, "orders"), "o_orderdate", 1997)
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def session_chains(spark, sf_dir):
    s = ledger.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts")
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query
def last_session(spark, sf_dir):
    return ledger.last_session(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 0.5)


@query
def backward_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return ledger.nearest_before(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "event_id").select("event_id", "matched")


VOTE_KEYS = ["usuario", "compilado", "tramo"]


@query
def vote_state(spark, sf_dir):
    return ledger.vote_state(adapters.votes(spark, sf_dir), VOTE_KEYS).select(*VOTE_KEYS, "toma", "evento", "event_id")


@query
def note_state(spark, sf_dir):
    return ledger.note_state(adapters.votes(spark, sf_dir), VOTE_KEYS).select(*VOTE_KEYS, "event_id")


@query
def vote_counts(spark, sf_dir):
    return ledger.vote_counts(ledger.vote_state(adapters.votes(spark, sf_dir), VOTE_KEYS))


@query
def vote_coverage(spark, sf_dir):
    live = ledger.vote_state(adapters.votes(spark, sf_dir), VOTE_KEYS)
    return ledger.vote_coverage(live, adapters.stretches(spark, sf_dir).where("toma % 3 != 0"), "toma", "usuario")


@query
def votes_not_rescued(spark, sf_dir):
    live = ledger.vote_state(adapters.votes(spark, sf_dir), VOTE_KEYS)
    return ledger.not_rescued(live, adapters.stretches(spark, sf_dir).where("toma % 3 != 0"))


def _moving(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = adapters.votes(spark, sf_dir)
    live = ledger.vote_state(e, VOTE_KEYS, kinds=ledger.VOTES).unionByName(ledger.note_state(e, VOTE_KEYS))
    v = live.withColumnRenamed("event_id", "vote_id").withColumns({"ini": (F.col("vote_id") % 1800).cast("double"), "fin": (F.col("vote_id") % 1800 + 90).cast("double")})
    return v, adapters.stretches(spark, sf_dir).where("toma != 7")


@query
def vote_rehome(spark, sf_dir):
    return ledger.rehome(*_moving(spark, sf_dir))


@query
def vote_corrections(spark, sf_dir):
    v, c = _moving(spark, sf_dir)
    events = ledger.corrections(v.drop("ini", "fin"), ledger.rehome(v, c), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return events.select("vote_id", "usuario", "toma", "compilado", "tramo", "evento", "deshace", F.unix_micros("nota_ts").alias("nota_us"), F.unix_micros("ts").alias("us"), "migracion")


def _labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", "n_chars", (F.col("quality") == 1).alias("positive"))


@query
def auc(spark, sf_dir):
    return rounded(evaluation.auc(_labelled(spark, sf_dir), "n_chars"))


def _label_ranks(spark, sf_dir) -> DataFrame:
    return scoring.ranked(_labelled(spark, sf_dir), [F.col("n_chars").desc(), F.col("doc_id")])


@query
def precision_at_k(spark, sf_dir):
    return evaluation.precision_at(_label_ranks(spark, sf_dir))


@query
def percentile_positions(spark, sf_dir):
    return rounded(evaluation.positive_percentiles(_label_ranks(spark, sf_dir), "doc_id"))


@query
def spearman_dims(spark, sf_dir):
    return rounded(evaluation.spearman(rounded(_files(spark, sf_dir), 9), "path", "score_best", ["timing", "groove", "afinacion", "sonido", "desarrollo", "interes"], p=False))


def _answers(spark, sf_dir) -> DataFrame:
    order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = table(spark, sf_dir, "events").select(F.lag("event_type").over(order).alias("a"), F.col("event_type").alias("b"), F.lag("value").over(order).alias("va"), F.col("value").alias("vb"))
    even = F.abs(F.col("va") - F.col("vb")) < 3
    choice = F.when(even & (F.col("va") > 20), "ambos").when(even, "ninguno").when(F.col("va") > F.col("vb"), "A").when(F.col("vb") > F.col("va"), "B")
    return a.where("a IS NOT NULL AND a != b").select("a", "b", choice.alias("choice"))


@query
def win_matrix(spark, sf_dir):
    return evaluation.win_matrix(_answers(spark, sf_dir))


@query
def bradley_terry(spark, sf_dir):
    return rounded(evaluation.bradley_terry(evaluation.win_matrix(_answers(spark, sf_dir))))


@query
def pair_candidates(spark, sf_dir):
    items = scoring.ranked(_topics(spark, sf_dir), [F.col("p_retailprice").desc(), F.col("p_partkey")])
    return evaluation.close_pairs(items.select(F.col("p_partkey").alias("item"), F.col("rank").cast("long").alias("rank"), "topic", F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 11).cast("string")).alias("group")))


def _chain(spark, sf_dir) -> DataFrame:
    s, order = _ordered(rounded(_streaks(spark, sf_dir), 9))
    return segments.tempo_chain(segments.budget(s, order, 7200, F.col("fin") - F.col("ini")), order)


@query
def tempo_chain(spark, sf_dir):
    """The best streaks of a budget of two hours, chained by tempo."""
    return rounded(_chain(spark, sf_dir))


@query
def tempo_stretch(spark, sf_dir):
    return rounded(segments.tempo_adjusted(_chain(spark, sf_dir), "position"))


@query
def freshness(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    listing = d.select(path, F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"))
    cache = d.where("doc_id % 2 = 0").select(path, F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 10 == 4, "partial").otherwise("ok").alias("status"), F.lit(4).alias("fver"))
    return ledger.stale(listing, cache, {"fver": 4}).select("path")


@query
def classify_remote(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("name")
    remote = d.select(F.col("doc_id").alias("id"), name, F.col("n_chars").alias("size"), F.lit("2024-01-01").alias("modtime"))
    manifest = remote.where("id % 2 = 0").withColumn("modtime", F.when(F.col("id") % 10 == 4, "2023-01-01").otherwise(F.col("modtime")))
    return ledger.classify(remote, manifest, remote.where("id % 3 = 0")).select("id", "state")


@query
def folder_minmax(spark, sf_dir):
    return rounded(scoring.folder_scaled(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").select("c_custkey", "scaled"))


@query
def top_per_folder(spark, sf_dir):
    return segments.top_per(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey")


@query
def onset_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), (F.hour("ts") + F.minute("ts") / 60.0).alias("h"))
    return rounded(scoring.onset_spread(e, "user_id", "d", "h"))


@query
def moving_context(spark, sf_dir):
    w = adapters.windows(spark, sf_dir).select("path", "widx", "chroma_0", "chroma_5")
    return rounded(scoring.moving_average(scoring.moving_average(w, ["path"], "widx", "chroma_0", 5, "context_0"), ["path"], "widx", "chroma_5", 4, "context_5"))


@query
def answer_parser(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = ("A", "b", "AMBOS", "ninguno", "ambas", "Ninguna", "los dos", "LAS DOS", "c", "A B")
    word = F.element_at(F.array(*[F.lit(x) for x in words]), (F.col("conv_id") % 10 + 1).cast("int"))
    between = F.element_at(F.array(*[F.lit(x) for x in (" ", ": ", "=", "-", " - ", "")]), (F.col("turn") % 6 + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in ("Lote 3 (x): ", "LOTE1:", " lote 12 : ", "")]), (F.col("conv_id") % 4 + 1).cast("int"))
    text = F.concat(head, (F.col("turn") + 1).cast("string"), between, word, F.lit(" ; 007 a,, zz\n"))
    return ledger.parse_answers(c.select("conv_id", "turn", text.alias("answer")), "answer").select("conv_id", "turn", "token", "num", "choice", "bad")


@query
def answers_in_force(spark, sf_dir):
    return feedback.answered(adapters.pairs(spark, sf_dir), adapters.answers(spark, sf_dir)).select("lote", "num", "seg_a", "eleccion")


@query
def answers_unknown(spark, sf_dir):
    u = feedback.unknown_answers(adapters.pairs(spark, sf_dir), adapters.answers(spark, sf_dir))
    return u.groupBy("lote", "num", "reason").agg(F.count("*").alias("n"))


def _asked(spark, sf_dir) -> DataFrame:
    return feedback.answered(adapters.pairs(spark, sf_dir), adapters.answers(spark, sf_dir))


@query
def pairs_pending(spark, sf_dir):
    return feedback.pending(_asked(spark, sf_dir), adapters.segments(spark, sf_dir))


@query
def pairs_seen(spark, sf_dir):
    return feedback.seen_pairs(adapters.pairs(spark, sf_dir), adapters.segments(spark, sf_dir))


@query
def batch_numbers(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return feedback.next_batch(asked).select(F.col("lote").alias("next")).crossJoin(feedback.pending_batch(asked).select(F.col("lote").alias("pending")))


def _part_files(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    score = lambda n: (F.col("p_partkey") * n % 101) / 100.0
    return p.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"), score(37).alias("interes"), score(53).alias("ejecucion"), score(71).alias("score_med"), F.col("p_brand").alias("topic"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).alias("group"))


@query
def gem_wins(spark, sf_dir):
    return rounded(feedback.gem_wins(_asked(spark, sf_dir), adapters.segments(spark, sf_dir), _part_files(spark, sf_dir)))


@query
def opposite_tails(spark, sf_dir):
    return feedback.opposite_tails(_part_files(spark, sf_dir)).select("path", "gem", "perf")


@query
def pair_draw(spark, sf_dir):
    seen = feedback.seen_pairs(adapters.pairs(spark, sf_dir), adapters.segments(spark, sf_dir))
    return feedback.draw_pairs(_part_files(spark, sf_dir), 40, 7, seen)


@query
def pair_sides(spark, sf_dir):
    """Candidates for pairs: the best run of each file with enough windows."""
    w = _scored(spark, sf_dir)
    files = w.groupBy("path").agg(F.count("*").alias("n_win"))
    return feedback.candidates(w, files, 3)


@query
def latent_join(spark, sf_dir):
    s = adapters.segments(spark, sf_dir).where("id % 3 = 0").select(F.col("id").alias("item"), (F.col("id") % 17 / 10.0).alias("bt"))
    return feedback.latent_dimensions(s, adapters.segments(spark, sf_dir), _part_files(spark, sf_dir).where("topic != 'Brand#11'"), ["interes", "ejecucion"])


@query
def segment_ids(spark, sf_dir):
    """Segments asked for twice or known already are stored once; ids are hashes, so only what they stand for is compared."""
    s = adapters.segments(spark, sf_dir).drop("id")
    known = feedback.with_segments(s.where("start < 600"))
    new = feedback.with_segments(s.unionByName(s), known)
    return new.unionByName(known).groupBy("path", "start", "end").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query
def dup_listing(spark, sf_dir):
    d = _letters(spark, sf_dir)
    g = duplicates.duplicate_groups(d).withColumn("path", F.concat(F.lit("f/"), F.col("path").cast("string")))
    return duplicates.listed_groups(g).select("group", F.array_join("names", ",").alias("names"))


@query
def median_percentile(spark, sf_dir):
    return rounded(evaluation.median_percentile(_label_ranks(spark, sf_dir), "doc_id"))


@query
def name_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Folder/"), F.initcap("p_name"), F.lit(".mp3")).alias("path"))
    return evaluation.named_like(p, "path", ["RED", "dg"]).select("p_partkey")


@query
def sample_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    return evaluation.sampled(p, "p_partkey", 30, 5, p.where("p_partkey <= 10"))


@query
def file_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_timestamp("o_orderdate")
    files = o.select(F.col("o_orderkey").cast("string").alias("path"), day.alias("mtime"))
    iso = F.date_format(day - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(iso, F.lit(".500Z"))).when(F.col("o_orderkey") % 3 == 1, "")
    manifest = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("local_path"), F.concat(iso, F.lit("+02:00")).alias("modtime"), made.alias("btime"))
    return dates.file_dates(files, manifest).select("path", F.unix_micros("date").alias("us"))


@query
def date_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.unix_micros(fx.months_back(F.col("ts"), 7)).alias("back_us"), fx.local_day(F.col("ts"), "America/Argentina/Buenos_Aires").cast("string").alias("day"), stores.landing_path("in/", F.col("ts"), F.concat(F.col("event_id").cast("string"), F.lit(".mp3"))).alias("target"), F.unix_micros(fx.from_epoch(F.unix_micros("ts") / 1e6)).alias("us"))


@query
def range_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    at = dates.since(day="2024-01-03")
    kinds = ({"year": 2024}, {"last": True, "tz": "Asia/Tokyo"}, {"months": 3, "since": at}, {"since": at}, {})
    rows = [dates.range_label(e, "ts", **k).withColumn("n", F.lit(i)) for i, k in enumerate(kinds)]
    return reduce(DataFrame.unionByName, rows)


@query
def quota_rounding(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", fx.quota(F.col("p_partkey"), 0.5).alias("half"))
    return p.withColumn("key", fx.compilation_key(F.lit("todo"), F.when(F.col("half") % 2 == 0, "gems").otherwise("ideas"), F.col("p_partkey") % 3 == 0))


def _pieces(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") * 7.0).alias("ini"), (F.col("p_size") * 7.0 + F.col("p_partkey") % 9).alias("fin"), F.when(F.col("p_partkey") % 50 == 0, F.lit(float("-inf"))).otherwise(-10.0 - F.col("p_size")).alias("dbfs"))


@query
def level_gains(spark, sf_dir):
    return segments.level_gains(_pieces(spark, sf_dir)).select("p_partkey", "gain_db")


@query
def pieces_long_enough(spark, sf_dir):
    return segments.long_enough(_pieces(spark, sf_dir), 2.0).select("p_partkey")


@query
def beat_snap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    beats = e.select((F.col("user_id") % 20).cast("string").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000 / 1e6).alias("beat"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 23).cast("string").alias("path"), (F.col("p_partkey") * 13.5 % 3600).alias("t"))
    return rounded(segments.snap_to_beat(points, beats))


@query
def fresh_streaks(spark, sf_dir):
    w = duplicates.saved(_scored(spark, sf_dir).select("path", "start", "score", "silence_ratio", "tempo"))
    q = scoring.quantile_row(w, "score", {"q": 0.6})
    used = segments.best_run(_scored(spark, sf_dir), 3)
    return rounded(segments.fresh_streaks(w.crossJoin(F.broadcast(q)), F.col("q"), used, 1, silence=0.2).select("path", "ini", "fin", "mean"))


@query
def selection_order(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("sig"))
    chosen = duplicates.diverse(e, [F.col("vec_id")], 20, 0.3).select("vec_id", "pick")
    return segments.in_selection_order(e, chosen, "vec_id").select("vec_id", "pick")


def _published(spark, sf_dir) -> DataFrame:
    take = adapters.take_path("o_custkey").alias("path")
    o = table(spark, sf_dir, "orders").select("o_orderkey", take, (F.col("o_orderkey") % 40 * 30.0).alias("ini"))
    return o.select((F.col("o_orderkey") % 12).cast("string").alias("compilado"), F.col("o_orderkey").alias("tramo"), F.element_at(F.split("path", "/"), -1).alias("toma"), F.col("ini").alias("origen_ini_s"), (F.col("ini") + 120).alias("origen_fin_s"), F.when(F.col("o_orderkey") % 5 != 0, 0.5).alias("score"))


def _rescored(spark, sf_dir) -> DataFrame:
    w = duplicates.saved(_scored(spark, sf_dir).select("path", "start", "score", "timing", "sonido"))
    files = w.groupBy("path").agg(F.count("*").alias("n")).withColumn("interes", F.col("n") / 100.0)
    again = files.where("path LIKE 'e3/%'").withColumn("path", F.regexp_replace("path", "^e3", "e33"))  # names that two files have
    return compilation.rescored(_published(spark, sf_dir), w, files.unionByName(again))


@query
def manifest_rescore(spark, sf_dir):
    return _rescored(spark, sf_dir).select("compilado", "tramo", "toma", "score", "timing", "interes", F.bround("change", 3).alias("change"))


@query
def rescore_deltas(spark, sf_dir):
    r = compilation.rescoring_report(_rescored(spark, sf_dir))
    return r.withColumns({c: F.bround(c, 3) for c in ("median_change", "max_change")})


@query
def playlist_report(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), (F.col("p_partkey") * 45.0).alias("pos_s"), F.concat(F.lit("x/"), F.col("p_name"), F.lit(".mp3")).alias("path"), (F.col("p_size") * 30.0).alias("ini"), (F.col("p_size") * 30.0 + 90).alias("fin"), F.when(F.col("p_size") > 5, F.col("p_size") * 3.0).alias("tempo"), (F.col("p_size") / 100.0).alias("score"), (F.col("p_size") / 200.0).alias("timing"))
    return compilation.report_lines(p, "todo_gems_fijo", "filtro=todo")


@query
def class_penalties(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("n"), (F.col("event_id") % 9).cast("int").alias("idx"), F.col("value").alias("score"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("index"), F.col("n_name").alias("display_name"))
    return rounded(stores.class_penalty(e, names, ("NATION_1", "NATION_4", "NATION_7", "NATION_24")), 4)


@query
def local_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("r/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ".MP3").when(F.col("p_partkey") % 7 == 0, ".wav").otherwise(".mp3"))
    return stores.local_index(p.select(path.alias("path"), F.col("p_size").cast("long").alias("size")))


@query
def name_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(".mp3")).alias("toma"))
    words = table(spark, sf_dir, "part").select(F.upper(F.element_at(F.split("p_name", " "), 1)).alias("name")).distinct()
    whole = table(spark, sf_dir, "part").select("p_name").distinct().select(F.concat("p_name", F.lit(".MP3")).alias("name"))
    return stores.match_names(words.unionByName(whole).distinct(), p).select("name", "p_partkey")
