"""The commands: extract, rank, diag, dupes, compile, eval, compare, feedback and sync, over a store of features.

Each is a function of a session, a store (a folder, see sources.files) and options, and gives DataFrames;
``main`` reads the options from a command line and prints the first rows. What is rendered as audio,
pictures or video, and what is copied from remotes, lies outside.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takerank import model
from takerank.functions import audio
from takerank.functions.columns import clock, compilation_key
from takerank.model import Settings
from takerank.operators import compilation, dates, duplicates, evaluation, feedback, ledger, scoring, segments
from takerank.operators.shared import saved
from takerank.sources import files as stores

FEATURE_VERSION = 4
PAIRS = "lote long, num long, seg_a long, seg_b long, tipo string"
SEGMENTS = "id long, path string, start double, end double"
ANSWERS = "lote long, num long, eleccion string, tags string, ts timestamp"
REMOTE = "id string, local_path string, size long, modtime string, btime string"
REPORT = ["rank", "toma", "dur_min", "n_win", "ejecucion", "interes", "timing", "groove", "afinacion", "tonal_outlier", "creatividad", "desarrollo", "sonido", "best_start"]


@dataclass(frozen=True)
class Options:
    """What the commands share: where the takes lie, how they were cut, scored, filtered and sorted."""

    root: str | None = None
    sr: int = 22050
    win: float = 30.0
    hop: float = 30.0
    settings: Settings = Settings()
    sort_by: str = "score_med"
    least_windows: int = 0
    since: datetime | None = None
    until: datetime | None = None
    months: int | None = None
    year: int | None = None
    last_session: bool = False
    similarity: float = 0.997
    tolerance: float = 2.0

    @property
    def params(self) -> dict:
        return {"fver": FEATURE_VERSION, "sr": self.sr, "win": self.win, "hop": self.hop}


def extract(spark: SparkSession, store: str, root: str, o: Options, include: list[str] | None = None, sample: int | None = None, seed: int = 0, names: str | None = None, force: bool = False, retry_errors: bool = False) -> int:
    """Measure the files under a folder that the store does not hold fresh; the number of files measured."""
    listing = stores.media(spark, root)
    listing = stores.listed_files(spark, names, listing) if names else listing
    if include and not sample:
        listing = evaluation.named_like(listing, "path", include)
    elif sample:
        listing = evaluation.sampled(listing, "path", sample, seed, evaluation.named_like(listing, "path", include) if include else None)
    if not force:
        cache = stores.stored_files(spark, store) if _there(spark, f"{store}/files") else spark.createDataFrame([], stores.FILE_COLUMNS)
        listing = ledger.stale(_seconds(listing), _seconds(cache), o.params, retry_errors).withColumn("mtime", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")))
    listing = saved(listing)
    n = listing.count()
    if n:
        content = stores.media(spark, root, content=True).join(listing.select("path"), "path", "left_semi")
        stores.store_features(audio.extract(content, o.sr, o.win, o.hop), store, o.params, listing)
    return n


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("mtime", F.unix_micros("mtime") / 1e6)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: By store and kind, what the last command of this driver computed: (what it was computed from, the table).
_KEPT: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def _kept(spark: SparkSession, store: str, kind: str, options: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the store, made anew when the session, the options or the rows of stored files are others than the last time."""
    registered = repr((model.PROFILES, model.WEIGHTS, model.WINDOW_DIMENSIONS, model.FILE_DIMENSIONS))
    state = (spark, options, registered, stores.version(spark, store))
    if _KEPT.get((store, kind), (None,))[0] != state:
        _KEPT[store, kind] = (state, saved(make()))
    return _KEPT[store, kind][1]


def _windows(spark: SparkSession, store: str, o: Options) -> DataFrame:
    """Windows of the store with their scores."""
    return _kept(spark, store, "windows", (o.params, o.root, o.settings), lambda: scoring.score_windows(stores.load_windows(spark, store, o.params, o.root), o.settings))


def scored(spark: SparkSession, store: str, o: Options) -> tuple[DataFrame, DataFrame]:
    """(windows with their scores, files with theirs) of the store, the files filtered by windows and dates."""
    w, stored = _windows(spark, store, o), stores.stored_files(spark, store)
    f = _kept(spark, store, "files", (o.params, o.root, o.settings), lambda: scoring.aggregate_files(w, stored, o.settings))
    f = f.where(F.col("n_win") >= o.least_windows)
    f = dates.file_dates(f.join(stored.select("path", "mtime"), "path", "left"), stores.table_or_empty(spark, f"{store}/remote", REMOTE))
    if o.since or o.until or o.months or o.year or o.last_session:
        since, until = o.since or dates.since(o.months), o.until
        if o.year:
            since, until = dates.since(day=f"{o.year}-01-01"), dates.since(day=f"{o.year + 1}-01-01")
        f = dates.by_date(f, "date", None if since is None else F.lit(since), None if until is None else F.lit(until), o.last_session)
    return w, f


def _grouped(spark: SparkSession, store: str, o: Options) -> DataFrame:
    """path and duplicate group of the files with a fingerprint."""
    signatures = stores.load_signatures(spark, store, o.root, o.params)
    return _kept(spark, store, "groups", (o.params, o.root, o.similarity, o.tolerance), lambda: duplicates.duplicate_groups(signatures, o.similarity, o.tolerance))


def rank(spark: SparkSession, store: str, o: Options, dedupe: bool = False) -> DataFrame:
    """The files, best first, with rank and duplicate group (null without a fingerprint); dedupe: the best of each group."""
    _, f = scored(spark, store, o)
    f = f.join(_grouped(spark, store, o), "path", "left")
    if dedupe:
        f = duplicates.first_of_group(f, "group", [F.col(o.sort_by).desc(), F.col("path")])
    out = scoring.rank_files(f, o.sort_by)
    names = list(dict.fromkeys(c for c in [*REPORT[:4], o.sort_by, *REPORT[4:], "group", "path"] if c in out.columns))
    return out.select(*names)


def diag(spark: SparkSession, store: str, o: Options) -> DataFrame:
    """The profile of every feature over all windows."""
    return scoring.diagnose(_windows(spark, store, o))


def dupes(spark: SparkSession, store: str, o: Options) -> DataFrame:
    """Groups of more than one file that sound alike."""
    return duplicates.listed_groups(_grouped(spark, store, o))


def compile(  # noqa: A001
    spark: SparkSession, store: str, o: Options, top: int = 20, by: str = "score", dynamic: bool = True, run: int = 2, longest: int = 0, per_take: int = 2, quantile: float = 0.6, silence: float = 0.08,
    per_topic: int = 0, diversity: float = 0.15, minutes: float | None = None, chain: bool = True, crossfade: float = 1.0, used: DataFrame | None = None, label: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(playlist with places, positions, scores and file dimensions; its document).

    The best files, one of each duplicate group, no more of a topic than allowed and unlike each other, give their
    best streaks (or with dynamic=False their best run); what a used stretch (path, ini, fin) covers is
    left out; the best up to the budget are put in order of tempo or score. by: the window column by which stretches are chosen.
    """
    w, f = scored(spark, store, o)
    order = [F.col(o.sort_by).desc_nulls_last(), F.col("path")]
    signatures = stores.load_signatures(spark, store, o.root, o.params)
    f = duplicates.first_of_group(f.join(_grouped(spark, store, o), "path", "left"), "group", order).where(F.col("n_win") >= run)
    if per_topic:
        every = stores.stored_files(spark, store).select(F.element_at(F.split("path", "/"), -1).alias("toma")).distinct()
        f = segments.capped(f.join(duplicates.topics(every, "toma"), "toma", "left"), "topic", order, per_topic)
    if diversity > 0:
        f = duplicates.diverse(f.join(signatures.select("path", "sig"), "path", "left"), order, top, diversity).drop("sig", "pick")
    else:
        f = f.orderBy(*order).limit(top)
    f = saved(f)
    own = w.join(F.broadcast(f.select("path")), "path", "left_semi")  # top rows
    column = segments.criterion(by)
    best = [F.round("mean", 9).desc(), F.col("path"), F.col("ini")]
    if dynamic:
        threshold = scoring.quantile_row(w, column, {"q": quantile}).first().q  # over all windows, not those of the chosen files
        options = {"column": column, "least": run, "most": longest, "silence": silence, "win": o.win, "hop": o.hop}
        if used is None:
            s = segments.top_per(segments.streaks(own, F.lit(threshold), **options), ["path"], [best[0], best[2]], per_take)
        else:
            s = segments.fresh_streaks(own, F.lit(threshold), used, per_take, **options)
        s = s.select("path", "ini", "fin", "tempo", "mean")
    else:
        s = segments.best_run(own, run, column, o.win, o.hop).drop("n").join(f.select("path", "tempo", F.col(o.sort_by).alias("mean")), "path")
        s = s if used is None else segments.avoid_used(s, used)
    if minutes:
        s = segments.budget(s, best, minutes * 60, F.col("fin") - F.col("ini")).drop("before_s")
    s = saved(segments.long_enough(s, crossfade))
    if chain:
        s = segments.tempo_chain(s, best).select("path", "ini", "fin", "tempo", F.col("position").alias("place"))
    else:
        s = scoring.ranked(s, best, "place").drop("mean")
    there = [c for c in ("score", *compilation.WINDOW_DIMS) if c in w.columns]
    s = segments.positions(s, [F.col("place")], crossfade, F.col("fin") - F.col("ini"))
    med = segments.segment_medians(s.select("path", "ini", "fin"), own, there)
    dims = [c for c in compilation.FILE_DIMS if c in f.columns]
    play = s.join(med.select("path", "ini", "fin", *[F.col(f"med_{c}").alias(c) for c in there]), ["path", "ini", "fin"]).join(f.select("path", "date", *dims), "path")
    play = saved(play.withColumns({"mean": F.col("score"), "anio": F.year("date")}).orderBy("place"))
    named = label or dates.range_label(f, "date", o.year, o.last_session, o.months, o.since).first().label
    key = spark.range(1).select(compilation_key(F.lit(named), F.lit(o.settings.profile), F.lit(dynamic)).alias("k")).first().k
    return play, stores.manifest_document(play, w, key, o.settings.profile)


def evaluate(spark: SparkSession, store: str, o: Options, truth: str) -> dict[str, DataFrame]:
    """ranked: the known files with their ranks; median: of the positives' percentiles; precision: at 10, 25 and 50; auc."""
    _, f = scored(spark, store, o)
    r = saved(scoring.rank_files(f, o.sort_by))
    known = stores.match_names(stores.ground_truth(spark, truth), r).select("path", "positive").distinct()
    marked = saved(r.join(known, "path", "left"))
    positive = marked.withColumn("positive", F.coalesce("positive", F.lit(False)))
    sides = marked.where("positive IS NOT NULL").select((-F.col("rank")).alias("score"), "positive")
    return {"ranked": marked.where("positive IS NOT NULL").select("rank", "toma", "positive", o.sort_by).orderBy("rank"), "median": evaluation.median_percentile(positive, "path"), "precision": evaluation.precision_at(positive), "auc": evaluation.auc(sides)}


def compare(spark: SparkSession, store: str, o: Options, n: int = 10, run: int = 2, seed: int = 0) -> DataFrame:
    """Draw a batch of n pairs that were never asked, store its segments and pairs, and give what is to be asked."""
    w, f = scored(spark, store, o)
    c = feedback.candidates(w, f, run, win=o.win, hop=o.hop).join(_grouped(spark, store, o), "path", "left")
    c = saved(c.join(duplicates.topics(c.select("toma"), "toma").distinct(), "toma", "left"))
    pairs, known = stores.table_or_empty(spark, f"{store}/pairs", PAIRS), stores.table_or_empty(spark, f"{store}/segments", SEGMENTS)
    drawn = saved(feedback.draw_pairs(c, n, seed, feedback.seen_pairs(pairs, known)))
    new = saved(feedback.new_pairs(drawn, c, pairs))
    shown = c.join(drawn.select(F.explode(F.array("a", "b")).alias("path")).distinct(), "path", "left_semi")
    stores.append_table(saved(feedback.with_segments(shown.select("path", "start", "end"), known)), f"{store}/segments")
    stores.append_table(new, f"{store}/pairs")
    return drawn.join(c.select(F.col("path").alias("a"), clock(F.col("start")).alias("a_from")), "a").join(c.select(F.col("path").alias("b"), clock(F.col("start")).alias("b_from")), "b").orderBy("num")


def answer(spark: SparkSession, store: str, text: str, batch: int | None = None) -> DataFrame:
    """Store the answers of a text for a batch, by default the last with open pairs; the answers that could not be stored, with the reason."""
    pairs, old = stores.table_or_empty(spark, f"{store}/pairs", PAIRS), stores.table_or_empty(spark, f"{store}/answers", ANSWERS)
    if batch is None:
        batch = feedback.pending_batch(feedback.answered(pairs, old)).first().lote
        if batch is None:
            raise ValueError("no batch has open pairs; name one")
    rows = ledger.parse_answers(spark.createDataFrame([(text,)], "text string"), "text")
    rows = saved(rows.select(F.lit(batch).cast("long").alias("lote"), "num", F.col("choice").alias("eleccion"), F.lit(None).cast("string").alias("tags"), F.current_timestamp().alias("ts"), "token", "bad"))
    good = rows.where("NOT bad").drop("token", "bad")
    stores.append_table(good.join(pairs.select("lote", "num"), ["lote", "num"], "left_semi"), f"{store}/answers")
    unknown = feedback.unknown_answers(pairs, rows.where("NOT bad")).select("token", "reason")
    return rows.where("bad").select("token", F.lit("not understood").alias("reason")).unionByName(unknown)


def open_pairs(spark: SparkSession, store: str) -> DataFrame:
    """The pairs without an answer."""
    pairs, old = stores.table_or_empty(spark, f"{store}/pairs", PAIRS), stores.table_or_empty(spark, f"{store}/answers", ANSWERS)
    return feedback.pending(feedback.answered(pairs, old), stores.table_or_empty(spark, f"{store}/segments", SEGMENTS))


def summary(spark: SparkSession, store: str, o: Options) -> dict[str, DataFrame]:
    """latent: strengths and dimensions of the compared segments; dimensions: their rank correlation with the strengths; gems: how often a gem won."""
    pairs, old = stores.table_or_empty(spark, f"{store}/pairs", PAIRS), stores.table_or_empty(spark, f"{store}/answers", ANSWERS)
    known = stores.table_or_empty(spark, f"{store}/segments", SEGMENTS)
    done = saved(feedback.answered(pairs, old).where("eleccion IS NOT NULL"))
    _, f = scored(spark, store, o)
    f = saved(f)
    dims = [c for c in ("ejecucion", "interes", "balance", *model.WINDOW_DIMENSIONS, *model.FILE_DIMENSIONS) if c in f.columns]
    strengths = evaluation.bradley_terry(evaluation.win_matrix(done.select(F.col("seg_a").alias("a"), F.col("seg_b").alias("b"), F.col("eleccion").alias("choice"))))
    latent = saved(feedback.latent_dimensions(strengths, known, f, dims))
    return {"latent": latent.orderBy(F.col("bt").desc(), "item"), "dimensions": evaluation.spearman(latent, "item", "bt", dims), "gems": feedback.gem_wins(done, known, f)}


def sync(spark: SparkSession, store: str, listing: str, root: str, months: int | None = None, since: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Remote files of a listing with their state: known, here already, or to be downloaded to target."""
    remote = stores.remote_listing(spark, listing)
    at = dates.since(months, since)
    wanted = ledger.remote_wanted(remote, at.isoformat() if at else None, excluded).where(F.lower("name").endswith(".mp3"))
    local = stores.local_index(stores.media(spark, root, stems=True))
    known = stores.table_or_empty(spark, f"{store}/remote", REMOTE)
    return ledger.classify(wanted, known, local).withColumn("target", F.when(F.col("state") == "download", stores.landing_path(root, F.col("ts"), F.col("name"))))


def remember(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Add rows (id, local_path, size, modtime, btime) to the table of remote files; the last of an id counts."""
    old = stores.table_or_empty(spark, f"{store}/remote", REMOTE).withColumn("_new", F.lit(0))
    both = saved(ledger.latest(old.unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True), ["id"], F.col("_new")).drop("_new"))
    both.write.mode("overwrite").parquet(f"{store}/remote")


def _options(a: argparse.Namespace) -> Options:
    weights = dict(w.split("=") for w in a.weight)
    s = Settings(profile=a.profile, mode=a.mode, weight_sound=a.weight_sound, weight_execution=a.weight_execution, least_sound=a.least_sound, shrink=a.shrink, weights=model.WEIGHTS | {k: float(v) for k, v in weights.items()} if weights else None)
    since = dates.since(day=a.since) if a.since else None
    until = dates.since(day=a.until) if a.until else None
    return Options(root=a.root, sr=a.sr, win=a.win, hop=a.hop, settings=s, sort_by=a.sort_by, least_windows=a.least_windows, since=since, until=until, months=a.months, year=a.year, last_session=a.last_session)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="takerank", description=__doc__)
    p.add_argument("store")
    p.add_argument("--root")
    p.add_argument("--sr", type=int, default=22050)
    p.add_argument("--win", type=float, default=30.0)
    p.add_argument("--hop", type=float, default=30.0)
    p.add_argument("--profile", default="balance", choices=list(model.PROFILES))
    p.add_argument("--mode", default="mixto", choices=["mixto", "veto"])
    p.add_argument("--weight", action="append", default=[], metavar="DIMENSION=W")
    p.add_argument("--weight-sound", type=float, default=0.35)
    p.add_argument("--weight-execution", type=float, default=0.65)
    p.add_argument("--least-sound", type=float, default=0.15)
    p.add_argument("--shrink", type=float, default=4.0)
    p.add_argument("--sort-by", default="score_med")
    p.add_argument("--least-windows", type=int, default=0)
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--months", type=int)
    p.add_argument("--year", type=int)
    p.add_argument("--last-session", action="store_true")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--out")
    c = p.add_subparsers(dest="command", required=True)
    e = c.add_parser("extract")
    e.add_argument("folder")
    e.add_argument("--include", nargs="*")
    e.add_argument("--sample", type=int)
    e.add_argument("--seed", type=int, default=0)
    e.add_argument("--files-from")
    e.add_argument("--force", action="store_true")
    e.add_argument("--retry-errors", action="store_true")
    c.add_parser("rank").add_argument("--dedupe", action="store_true")
    c.add_parser("diag")
    d = c.add_parser("dupes")
    d.add_argument("--similarity", type=float, default=0.997)
    d.add_argument("--tolerance", type=float, default=2.0)
    m = c.add_parser("compile")
    m.add_argument("--by", default="score")
    m.add_argument("--fixed", action="store_true")
    m.add_argument("--minutes", type=float)
    m.add_argument("--per-topic", type=int, default=0)
    m.add_argument("--diversity", type=float, default=0.15)
    m.add_argument("--label")
    m.add_argument("--avoid", nargs="*", default=[], metavar="FOLDER")
    c.add_parser("eval").add_argument("truth")
    q = c.add_parser("compare")
    q.add_argument("-n", type=int, default=10)
    q.add_argument("--seed", type=int, default=0)
    f = c.add_parser("feedback")
    f.add_argument("action", choices=["import", "summary", "pending"])
    f.add_argument("--text")
    f.add_argument("--batch", type=int)
    y = c.add_parser("sync")
    y.add_argument("listing")
    y.add_argument("folder")
    y.add_argument("--exclude", nargs="*", default=[])
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """Run a command line; the DataFrames it shows, by name."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    o = _options(a)
    if a.command == "extract":
        n = extract(spark, a.store, a.folder, o, a.include, a.sample, a.seed, a.files_from, a.force, a.retry_errors)
        shown = {"extracted": spark.range(1).select(F.lit(n).alias("files"))}
    elif a.command == "rank":
        shown = {"rank": rank(spark, a.store, o, a.dedupe)}
    elif a.command == "diag":
        shown = {"diag": diag(spark, a.store, o)}
    elif a.command == "dupes":
        shown = {"dupes": dupes(spark, a.store, replace(o, similarity=a.similarity, tolerance=a.tolerance))}
    elif a.command == "compile":
        used = stores.manifests(spark, *a.avoid) if a.avoid else None
        if used is not None:
            names = compilation.unique_names(stores.stored_files(spark, a.store))
            used = used.join(names, "toma").select("path", F.col("origen_ini_s").alias("ini"), F.col("origen_fin_s").alias("fin"))
        play, document = compile(spark, a.store, o, a.top, a.by, not a.fixed, per_topic=a.per_topic, diversity=a.diversity, minutes=a.minutes, used=used, label=a.label)
        shown = {"report": compilation.report_lines(play, document.first().compilado, f"perfil={o.settings.profile} modo={o.settings.mode} sort={o.sort_by}"), "document": document}
    elif a.command == "eval":
        shown = evaluate(spark, a.store, o, a.truth)
    elif a.command == "compare":
        shown = {"pairs": compare(spark, a.store, o, a.n, seed=a.seed)}
    elif a.command == "feedback":
        shown = {"rejected": answer(spark, a.store, a.text or "", a.batch)} if a.action == "import" else {"pending": open_pairs(spark, a.store)} if a.action == "pending" else summary(spark, a.store, o)
    else:
        shown = {"sync": sync(spark, a.store, a.listing, a.folder, a.months, a.since, tuple(a.exclude))}
    for name, df in shown.items():
        print(name)
        df.show(a.top, truncate=False)
        if a.out:
            df.write.mode("overwrite").json(f"{a.out}/{name}") if name == "document" else stores.write_csv(df, f"{a.out}/{name}")
    return shown


if __name__ == "__main__":
    main()
