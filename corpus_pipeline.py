"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
documents; the last returns the packed pieces. run() writes each stage's result and reads it again.

Documents that the quality classifier rejects go. Lines that stand on many sites are removed from the texts
(a document stays, even if no line does). One row of each group of near copies stays, the one with the
least id; null ids come last, and rows with one id and different texts are told apart. Documents that hold a
passage of the benchmark go. The rest is packed. Null texts are rejected by the classifier. Further columns of
the table pass through to the last stage but one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from sieveline.llm.common import Scratch, lean_workers, read

#: Near duplicates: words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80


def through(docs: DataFrame, needed: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after a stage that works on the needed ones; the others pass it under names that it doesn't use."""
    hidden = {c: f"passed_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = stage(docs.select(*needed, *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]))
    return out.select(*[F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    model = quality.fit(docs, quality.grades_of_labels(read(spark, sf_dir, "labels")))
    return through(docs, ["doc_id", "text"], lambda d: quality.score(d, model).where("keep"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = through(docs, ["doc_id", "text", "source"], line_dedup.drop_spread_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_workers(spark)

    def survivors(d: DataFrame) -> DataFrame:
        # by a key of the row, as ids may be null or stand on several texts
        keyed = d.withColumn("__row", F.xxhash64("doc_id", "text"))
        groups = jaccard_join.cluster(keyed, doc_id="__row", n=WORDS, percent=PERCENT).select("__row", "component_id").distinct()
        ids = keyed.select("__row", "doc_id").distinct()
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
        first = groups.join(ids, "__row").groupBy("component_id").agg(best.alias("best")).select("best.__row")
        return keyed.join(first, "__row", "left_semi").dropDuplicates(["__row"])

    return through(docs, ["doc_id", "text"], survivors)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    items = read(spark, sf_dir, "benchmark")
    return through(docs, ["doc_id", "text"], lambda d: decontaminate.find_contamination(d, items).where("hit_words is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifier, the similarity components and the packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            scratch.drop(before)
        before = f"stage-{k}"
    return docs
