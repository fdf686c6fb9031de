"""Writers: resumable appends, review queues, staged publication, per-split output."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import guard_cell

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,95}")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a name for an experiment: {name!r}")
    return name


def write_records(df: DataFrame, path: str) -> int:
    """Overwrites JSON lines; returns the number of rows."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def append_new(df: DataFrame, path: str, key: str = "uid") -> int:
    """Appends rows whose key was not written before, each key once; running it again adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    before = 0
    if exists(spark, path):
        have = spark.read.parquet(path)
        before = have.count()
        fresh = fresh.join(have.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: writes beside the target and renames; refuses a target that is there."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging"
    df.write.mode("overwrite").parquet(staging)
    (src, fs), (dst, _) = _path(spark, staging), _path(spark, path)
    if not fs.rename(src, dst):
        raise OSError(f"could not publish {path}")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(split).json(path)


def review_queue(df: DataFrame) -> DataFrame:
    """Cells as text: arrays joined by ' | ', and none that a spreadsheet would read as a formula."""
    cells = []
    for name, kind in df.dtypes:
        value = F.array_join(F.transform(name, lambda x: x.cast("string")), " | ") if kind.startswith("array<") and "struct" not in kind else F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(name).cast("string")
        cells.append(guard_cell(F.coalesce(value, F.lit(""))).alias(name))
    return df.select(*cells)


def write_review_queue(df: DataFrame, path: str) -> None:
    """Writes the queue unless one is there that holds any reviewer's entry, or that can't be read."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.option("header", True).option("multiLine", True).csv(path)
        entries = [c for c in old.columns if c.startswith("reviewer_") or c == "image_only_claim_review"]
        if not entries:
            raise ValueError(f"{path} is not a review queue; it stays as it is")
        filled = F.greatest(*[(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0).cast("int") for c in (*entries, entries[0])]) == 1
        if not old.where(filled).isEmpty():
            raise ValueError(f"{path} holds reviews; it stays as it is")
    review_queue(df).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_fetch(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Keys without a cached result, or with a failed one."""
    return wanted.join(cache.where("error = ''").select(key), key, "left_anti")


def bundle_manifest(files: DataFrame) -> DataFrame:
    """name, digest of files (path, digest)."""
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "digest")


def bundle_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, problem: missing, extra or changed files."""
    own = bundle_manifest(files).withColumnRenamed("digest", "own")
    both = manifest.join(own, "name", "full")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("own") != F.col("digest"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")
