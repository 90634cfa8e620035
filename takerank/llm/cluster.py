"""What every operator here needs from the cluster: shared scratch space and code on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts are long, so batches are kept small.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else a local one (tests, local mode only)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "takerank-shared")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/takerank/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read them again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the input of an operator for each part of its scratch tables.
PART_ROWS = 1 << 15


class Scratch:
    """Tables of one run of an operator, deleted but for those that its result still reads.

    Once fit() knows the rows of the input, a table is written in at most so many parts as these rows need
    and two a core at least; all rows are written. Each part costs the executor some files and, on a local
    disk without Hadoop's native library, a child process (chmod) for each of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names, self.parts = spark, scratch(spark, name), [], None

    def fit(self, rows: int) -> None:
        self.parts = max(2 * self.spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage, as stored() does."""
        self.names.append(f"{len(self.names):03d}-{name}")
        path = f"{self.root}/{self.names[-1]}"
        (df.coalesce(self.parts) if self.parts else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: str) -> None:
        """Delete the tables but the last of each name to keep."""
        last = {n[4:]: n for n in self.names if n[4:] in keep}
        for n in [n for n in self.names if last.get(n[4:]) != n]:
            drop(self.spark, f"{self.root}/{n}")
            self.names.remove(n)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key that holds more than one row in so many, and more rows than FEW, is hot; there are fewer such keys than HOT.
HOT = 1000
FEW = 256


def join_spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """left with the columns of right, which holds each key at most once; the rows of a hot key are dealt out over many tasks.

    A hot key's rows of left get a number from their content, so that about one row in HOT shares it, and
    its row of right is repeated for each number: at most 2 * HOT more rows in all. The hot keys alone,
    fewer than HOT, are counted beforehand and broadcast. left should be a table, as it is read once more
    for that; or else counted is one with the same keys. by: columns of left whose content gives the
    numbers, all by default.
    """
    spark = left.sparkSession
    counts = (left if counted is None else counted).select(key)
    total = counts.count()
    counts = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where((F.col("_n") > FEW) & (F.col("_n") * HOT > total)).select(key, F.ceil(F.col("_n") * HOT / total).alias("_copies"))
    found = hot.limit(HOT).collect()
    if not found:
        return left.join(right, key, how)
    hot = spark.createDataFrame(found, hot.schema)
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    one = left.join(F.broadcast(hot), key, "left").withColumn("_copy", F.pmod(F.xxhash64(*(by or left.columns)), copies)).drop("_copies")
    two = right.join(F.broadcast(hot), key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    return one.join(two, [key, "_copy"], how).drop("_copy")


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers (once a context) and bound the Arrow batches."""
    sc = spark.sparkContext
    if not getattr(sc, "_takerank_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="takerank-code-"), "takerank_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("takerank", os.path.relpath(full, package)))
        sc.addPyFile(target)
        sc._takerank_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark
