"""Sources and sinks of the engine: media, lists, manifests, logs and reports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank.functions.columns import base_name, fixed, is_stem, month_folder, utc
from takerank.operators.compilation import score_distribution
from takerank.operators.ledger import latest
from takerank.operators.shared import saved


def media(spark: SparkSession, root: str, stems: bool = False, content: bool = False, pattern: str = "*.[wWmM][aApP][vV3]") -> DataFrame:
    """Audio files under a folder: path, mtime, size and, if asked for, content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    f = f.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    return f if stems else f.where(~is_stem(F.element_at(F.split("path", "/"), -1)))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Lines of names: # comments, a leading - for negatives."""
    line = F.trim("value")
    t = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return t.select(F.trim(F.when(line.startswith("-"), F.substr(line, F.lit(2))).otherwise(line)).alias("name"), (~line.startswith("-")).alias("positive"))


def match_names(names: DataFrame, files: DataFrame) -> DataFrame:
    """Names with the files they mean: equal without regard to case, else holding the name.

    Names are looked for in the files by every part of a file's name as long as one of the names that no file equals.
    """
    n = names.withColumn("_n", F.regexp_replace(F.lower("name"), r"\.mp3$", ""))
    f = files.withColumn("_f", F.regexp_replace(F.lower("toma"), r"\.mp3$", ""))
    exact = n.join(f, n._n == f._f)
    rest = n.join(exact.select("name").distinct(), "name", "left_anti")
    lengths = rest.select(F.length("_n").alias("n")).distinct().where("n > 0").agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # no more than a name has letters
    parts = f.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode(F.array_distinct(F.flatten(F.transform("lengths", lambda k: F.when(k <= F.length("_f"), F.transform(F.sequence(F.lit(1), F.length("_f") - k + 1), lambda i: F.substr("_f", i, k))).otherwise(F.array().cast("array<string>"))))))).drop("lengths")
    return exact.drop("_n", "_f").unionByName(rest.join(parts, "_n").drop("_n", "_f"), allowMissingColumns=False)


def manifests(spark: SparkSession, *folders: str) -> DataFrame:
    """Stretches of the compilation manifests of several folders, the last folder winning for each compilation."""
    schema = "banda string, compilado string, perfil string, fver int, tramos array<struct<toma:string,origen_ini_s:double,origen_fin_s:double,score:double,pos_s:double>>"
    parts = [spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{d}/*.json").withColumn("_order", F.lit(i)) for i, d in enumerate(folders)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.where("compilado IS NOT NULL AND tramos IS NOT NULL")
    last = both.withColumn("_n", F.row_number().over(W.Window.partitionBy("compilado").orderBy(F.col("_order").desc()))).where("_n = 1")
    return last.select("compilado", "perfil", F.posexplode("tramos").alias("tramo", "t")).select("compilado", "perfil", F.col("tramo").cast("long").alias("tramo"), "t.*")


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def score_log(lines: DataFrame) -> DataFrame:
    """file and score from a run's log (n, value): "Procesando: x" opens a file, "score: s" or an error closes it."""
    name = F.regexp_extract("value", r"Procesando: (.+\.mp3)", 1)
    score = F.regexp_extract("value", r"score: ?(-?[0-9.]+)", 1)
    part = F.sum(F.when(name != "", 1).otherwise(0)).over(W.Window.orderBy("n"))
    t = lines.select("n", F.when(name != "", name).alias("file"), F.when(score != "", score).try_cast("double").alias("score"), part.alias("part")).where("part > 0")
    return t.groupBy("part").agg(F.max("file").alias("file"), F.max("score").alias("score")).drop("part")


def manifest_document(segments: DataFrame, scores: DataFrame, name: str, profile: str) -> DataFrame:
    """One nested document of a compilation: its stretches in order and the distribution of all window scores."""
    dist = score_distribution(scores).select(F.struct("*").alias("score_dist"))
    item = F.struct(F.bround("pos_s", 2).alias("pos_s"), F.bround(F.col("fin") - F.col("ini"), 2).alias("dur_s"), F.bround("ini", 2).alias("origen_ini_s"), F.bround("fin", 2).alias("origen_fin_s"), F.bround("tempo", 1).alias("tempo"), F.bround("mean", 3).alias("score"), F.col("path").alias("toma"))
    listed = segments.agg(F.sort_array(F.collect_list(item)).alias("tramos"))  # one playlist
    return listed.crossJoin(dist).select(F.lit(name).alias("compilado"), F.lit(profile).alias("perfil"), "score_dist", "tramos")


def write_csv(df: DataFrame, path: str, digits: int = 5, decimal_comma: bool = False) -> None:
    """A report with doubles at so many digits, optionally with decimal commas and semicolons."""
    cols = [fixed(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    out = df.select(*cols)
    if decimal_comma:
        out = out.select(*[F.regexp_replace(c, r"\.", ",").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).option("sep", ";" if decimal_comma else ",").csv(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """The window report, sorted by file and start."""
    write_csv(windows.orderBy("path", "start"), path)


def write_feedback(latent: DataFrame, path: str) -> None:
    """The report of compared segments, strongest first."""
    write_csv(latent.orderBy(F.col("bt").desc(), "item"), path, digits=4)


FILE_COLUMNS = "path string, mtime timestamp, size long, duration double, fver int, sr int, win double, hop double, status string, error string, sig array<float>, ts timestamp, run string"


def store_features(rows: DataFrame, path: str, params: dict, listing: DataFrame | None = None) -> None:
    """Store what audio.extract() gave under the parameters fver, sr, win and hop.

    Windows and files are appended, the windows first: what is stored for a file counts from the moment its row is
    there, and the last row of a file replaces all that was stored for it before, under whatever parameters. A run that was
    cut short leaves windows that no file row names, which are never read. listing: path, mtime and size of the files.
    """
    run = uuid.uuid4().hex
    known = F.struct(*[F.lit(params[k]).cast(t).alias(k) for k, t in (("fver", "int"), ("sr", "int"), ("win", "double"), ("hop", "double"))])
    rows = saved(rows)
    windows = rows.where("widx IS NOT NULL").drop("status", "error", "duration", "sig")
    windows.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/windows")
    files = rows.where("widx IS NULL").select("path", "duration", "status", "error", "sig")
    files = files.join(listing.select("path", "mtime", "size"), "path", "left") if listing is not None else files.withColumns({"mtime": F.lit(None), "size": F.lit(None)})
    files = files.withColumn("p", known).select("*", "p.*").withColumns({"ts": F.current_timestamp(), "run": F.lit(run)})
    names = [c.split()[0] for c in FILE_COLUMNS.split(", ")]
    files.select(*[F.col(n).cast(c.split(" ", 1)[1]).alias(n) for n, c in zip(names, FILE_COLUMNS.split(", "), strict=True)]).write.mode("append").parquet(f"{path}/files")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The row in force of each stored file: the last one."""
    return latest(spark.read.schema(FILE_COLUMNS).parquet(f"{path}/files"), ["path"], F.struct("ts", "run"))


def version(spark: SparkSession, path: str) -> str:
    """A digest that changes with every run that stores files: the table of files is append-only."""
    return hashlib.sha256("\n".join(sorted(spark.read.schema(FILE_COLUMNS).parquet(f"{path}/files").inputFiles())).encode()).hexdigest()


def _under(root: str | None) -> Column:
    return F.col("path").startswith(root.rstrip("/") + "/") if root else F.lit(True)


def load_windows(spark: SparkSession, path: str, params: dict, root: str | None = None) -> DataFrame:
    """Windows with features of the files stored well under these parameters, below a folder if one is given."""
    files = stored_files(spark, path).where((F.col("status") == "ok") & _under(root))
    for k in ("fver", "sr", "win", "hop"):
        files = files.where(F.col(k) == params[k])
    return spark.read.option("mergeSchema", True).parquet(f"{path}/windows").join(files.select("path", "run"), ["path", "run"], "left_semi").drop("run")


def load_signatures(spark: SparkSession, path: str, root: str | None = None, params: dict | None = None) -> DataFrame:
    """path, duration and sig of the files stored well with a fingerprint; params: only those under these parameters."""
    files = stored_files(spark, path).where((F.col("status") == "ok") & F.col("sig").isNotNull() & _under(root))
    for k, v in (params or {}).items():
        files = files.where(F.col(k) == v)
    return files.select("path", "duration", "sig")


def listed_files(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """The rows of a listing (path, ...) that a text file names, a path a line."""
    names = spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''").distinct()
    return listing.join(names, "path", "left_semi")


def remote_listing(spark: SparkSession, path: str) -> DataFrame:
    """id, path, name, size and ts of a recursive listing of a remote in JSON; folders are left out."""
    rows = spark.read.schema("Path string, Name string, Size long, ModTime string, ID string, IsDir boolean").option("multiLine", True).json(path)
    rows = rows.where("ID IS NOT NULL AND NOT coalesce(IsDir, false)")
    return rows.select(F.col("ID").alias("id"), F.col("Path").alias("path"), F.col("Name").alias("name"), F.col("Size").alias("size"), F.col("ModTime").alias("modtime"), utc(F.col("ModTime")).alias("ts"))


def local_index(media: DataFrame, extension: str = ".mp3") -> DataFrame:
    """name, size and path of local files with the extension in any case; of equal names and sizes the last path."""
    own = media.where(F.lower("path").endswith(extension.lower()))
    return own.groupBy(base_name(F.col("path")).alias("name"), "size").agg(F.max("path").alias("path"))


def class_penalty(scores: DataFrame, classes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """n (a window) and the sum of its scores (n, idx, score) for the classes (index, display_name) with one of the labels."""
    bad = classes.where(F.col("display_name").isin(*labels)).select(F.col("index").cast("int").alias("idx"))
    marked = scores.join(F.broadcast(bad.withColumn("_bad", F.lit(1.0))), "idx", "left")  # as many as there are labels
    return marked.groupBy("n").agg(F.sum(F.col("score") * F.coalesce("_bad", F.lit(0.0))).alias("penalty"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """index, mid and display_name of a table of classes in CSV."""
    return spark.read.option("header", True).schema("index int, mid string, display_name string").csv(path)


def write_landing(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows in folders by the month of an instant, named month=yyyy-MM."""
    df.withColumn("month", month_folder(F.col(ts))).write.mode("append").partitionBy("month").parquet(path)


def landing_path(root: str, ts: Column, name: Column) -> Column:
    """Where a remote file lands: root, the month of its instant in UTC, its name."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), month_folder(ts), name)


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a table of segments, pairs or answers; what is in force is a view of the last."""
    df.write.mode("append").parquet(path)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or one without rows where nothing was stored yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def settings(path: str | None = None) -> dict:
    """Local settings from a JSON file named by an argument or TAKERANK_SETTINGS; empty without one."""
    path = path or os.environ.get("TAKERANK_SETTINGS")
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def band(config: dict, key: str | None = None) -> dict:
    """The settings of a band, by default the one that the settings or TAKERANK_BAND name, with key, name and root filled in."""
    key = key or os.environ.get("TAKERANK_BAND") or config.get("banda_default")
    bands = config.get("bandas", {})
    if key not in bands:
        raise KeyError(f"no band {key!r} among: {', '.join(bands) or 'none'}")
    return {"clave": key, "nombre": key.capitalize(), "root": key} | bands[key]


def remote(config: dict, folder: str, key: str | None = None) -> dict:
    """folder_id and resource_key of a remote folder of a band."""
    own = band(config, key)
    found = own.get("drive", {}).get(folder) or {}
    if not found.get("folder_id"):
        raise KeyError(f"no folder_id for {folder!r} of {own['clave']!r}")
    return {"resource_key": None} | found
