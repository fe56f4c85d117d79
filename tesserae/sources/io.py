
from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from io import BytesIO
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.operators import sampling

#: [IO3] Source registry: name -> projection of a source's own columns to common ones.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def source(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


def loaded(name: str, raw: DataFrame) -> DataFrame:
    """[IO3] A registered source's rows in common columns."""
    return READERS[name](raw)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers are one machine, as in tests."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package: by its path where they share the driver's disk, and on a cluster from an
    archive in the shared folder, which Spark sends to them once a session."""
    context, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
    if root not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, context.environment.get("PYTHONPATH")) if x)
    if is_local(spark) or getattr(context, "_tesserae_sent", False):
        return
    package, blob = Path(__file__).resolve().parents[1], BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tesserae-{uuid.uuid4().hex}.zip")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(where)
    out.write(bytearray(blob.getvalue()))
    out.close()
    context.addPyFile(files.makeQualified(where).toString())
    context._tesserae_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@source("corpus")
def corpus(raw: DataFrame) -> DataFrame:
    """[IO1] Corpus records: dataset, record, text."""
    return raw.select(F.col("source").alias("ds"), F.col("doc_id").alias("rec"), "text")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one that spark.checkpoint.dir names; in local tests one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that no later step computes it again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, bad: str = "_bad") -> DataFrame:
    """[IO4] JSON lines; a line that doesn't parse is kept whole in `bad`, for counting."""
    return spark.read.schema(StructType(schema.fields).add(bad, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """[IO5] The commit protocol makes files appear whole."""
    df.write.mode("overwrite").json(path)


def write_shards(df: DataFrame, path: str, key: str, seed: str, passes: int = 1, shards: int = 8) -> None:
    """[IO6, IO2] Zstandard Parquet by pass and shard, rows dealt round robin in each pass's order."""
    out = sampling.passes(df, key, seed, passes, shards)
    out.repartition(passes * shards, "pass", "shard").write.mode("overwrite").option("compression", "zstd").partitionBy("pass", "shard").parquet(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """[IO7] Preference pairs as Parquet, schema as it is."""
    df.select("source", "prompt", "chosen", "rejected").write.mode("overwrite").parquet(path)


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """[IO8] (name, bytes) of the files below a path with a suffix, in order; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(relative(F.col("path"), path).alias("name"), F.col("length").alias("bytes")).orderBy("name")


def relative(c: Column, root: str) -> Column:
    """A file's path below a folder."""
    below = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", root).rstrip("/")
    return F.substr(c, F.instr(c, F.lit(below)) + len(below) + 1)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """[IO10] (name, md5) of the files below a path, named by their paths below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(relative(F.col("path"), path).alias("name"), F.md5("content").alias("md5"))


def mismatches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """[IO10] Names whose md5 differs or that one side lacks."""
    both = local.toDF("name", "a").join(remote.toDF("name", "b"), "name", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("name")


def newest(spark: SparkSession, globs: list[str] | str, schema: StructType, task: str) -> DataFrame:
    """[IO9] Result files: of each task the rows of the file whose path is last. Of several globs, such as a clean rerun's
    and the first run's, the first that has any file is read alone."""
    for glob in [globs] if isinstance(globs, str) else globs:
        where = spark._jvm.org.apache.hadoop.fs.Path(glob)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
            break
    rows = spark.read.schema(schema).json(glob).withColumn("_file", F.input_file_name())
    last = rows.groupBy(task).agg(F.max("_file").alias("_file"))
    return rows.join(last, [task, "_file"], "left_semi").drop("_file")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """[IO12, J4] What has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def manifest(df: DataFrame, path: str) -> None:
    """[IO11] A small aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
