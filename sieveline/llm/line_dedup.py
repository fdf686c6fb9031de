"""Cross-site line deduplication by distinct-site spread.

Lines that stand on many sites are boilerplate, however often a single site repeats its own. The number of
sites of each line is estimated by HyperLogLog sketches, which Spark merges by aggregation (partly before the
shuffle, so that a line with a third of all rows stays cheap). Lines whose estimate is near the threshold, from
half of it to twice, get exact distinct counts; so the result is exact, but for an error of the sketch by a
factor of two, which at its precision (2**12 registers, about 1.6 %) doesn't occur.

Only DataFrame functions are used. Lines are told apart by 128 bits of hash of their trimmed form; blank lines
are never removed. Null sites count for nothing; null texts have no lines and stay null; an empty text has one
empty line. Repeated documents each get their row. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch

MIN_SITES, LG_K = 10, 12


def _keys(line: Column) -> Column:
    core = F.trim(line)
    return F.struct(F.xxhash64(core).alias("h1"), F.xxhash64(F.lit(1), core).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\\n", -1)


def hashed_lines(documents: DataFrame, text: str = "text", site: str = "source", doc_key: str = "__doc") -> DataFrame:
    """A row for each nonblank line that a document holds: doc, site, h1, h2."""
    kept = F.filter(_lines(F.col(text)), lambda x: F.trim(x) != "")
    held = F.array_distinct(F.transform(kept, _keys))
    return documents.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(site).cast("string").alias("site"), F.explode(held).alias("x")).select("doc", "site", "x.h1", "x.h2")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 of the lines on at least min_sites sites."""
    sketched = lines.where("site is not null").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    estimated = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites / 2)
    far = estimated.where(F.col("sites") > 2 * min_sites).select("h1", "h2")
    near = estimated.where(F.col("sites") <= 2 * min_sites).select("h1", "h2")
    exact = lines.where("site is not null").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return far.unionByName(exact.select("h1", "h2"))


def drop_spread_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Replaces text by its kept lines and adds n_lines and n_removed."""
    spark = documents.sparkSession
    keyed = documents.withColumn("__doc", F.xxhash64(F.col(doc_id), F.col(text)))
    scratch = Scratch(spark, "lines")
    lines = scratch.save(hashed_lines(keyed, text, site), "lines")
    spread = scratch.save(spread_lines(lines, min_sites, lg_k), "spread")
    gone = lines.join(spread, ["h1", "h2"]).groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone")).withColumnRenamed("doc", "__doc")
    own = _lines(F.col(text))
    joined = keyed.join(gone, "__doc", "left").withColumn("__own", own)
    kept = F.filter("__own", lambda x: ~((F.trim(x) != "") & F.array_contains(F.col("__gone"), _keys(x))))
    kept = F.when(F.col("__gone").isNull(), F.col("__own")).otherwise(kept)
    plain = [F.col(c) for c in documents.columns if c not in (text, "n_lines", "n_removed")]
    made = joined.withColumn("__kept", kept)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("__own")).cast("long")
    return made.select(*plain, F.array_join("__kept", "\n").alias(text), n_lines.alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(F.size("__own") - F.size("__kept")).cast("long").alias("n_removed"))


def report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, null for a null text)."""
    made = drop_spread_lines(documents.select("doc_id", "source", "text"), **options)
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH cut AS (SELECT row_number() OVER () AS k, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
one AS (SELECT k, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM cut),
spread AS (SELECT trim(line, ' ') AS core FROM one WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites}),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS n FROM one
         WHERE trim(line, ' ') NOT IN (SELECT core FROM spread) GROUP BY k)
SELECT cut.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN lines IS NULL THEN NULL ELSE sha256(coalesce(kept.body, '')) END AS kept_sha256
FROM cut LEFT JOIN kept ON cut.k = kept.k
"""
