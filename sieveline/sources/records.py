"""Readers: records in JSON lines, reviews in CSV, captured web responses, sitemaps, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sieveline.functions.text import strip, uid
from sieveline.operators.extract import clean_html, page_images, strip_tags, unescape_entities

IMAGE = T.StructType([T.StructField(n, t) for n, t in [("url", T.StringType()), ("local_path", T.StringType()), ("role", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("sha256", T.StringType()), ("alt_text", T.StringType()), ("caption", T.StringType()), ("ocr_text", T.StringType())]])
_TEXTS = ("source", "source_id", "url", "title", "published_at", "author", "body_text", "claim_text", "verdict_raw", "label")
RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in _TEXTS],
    T.StructField("is_finance", T.BooleanType()), T.StructField("finance_score", T.DoubleType()), T.StructField("finance_hits", T.ArrayType(T.StringType())),
    T.StructField("images", T.ArrayType(IMAGE)), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()), T.StructField("collected_at", T.StringType()), T.StructField("raw", T.VariantType()), T.StructField("uid", T.StringType()),
])
LABELS = ("fake", "real", "unknown")
ORIGIN = ("__path", "__line")


def _lines(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool) -> DataFrame:
    """body, __path, __line (from 1 within a file): blank lines and byte-order marks are gone.

    Lines are numbered within the block of a file that a task reads, and blocks by the lines before them.
    """
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path)
    read = rows.select(F.regexp_replace("value", "^﻿", "").alias("body"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = read.groupBy("__path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("__path", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    return read.where(F.length(strip("body")) > 0).join(placed, ["__path", "__block"]).select("body", "__path", (F.col("__id") + F.col("__add")).alias("__line"))


def _parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    known = F.array(*[F.lit(f.name) for f in schema])
    keys = F.json_object_keys("body")
    return rows.withColumn("__record", F.from_json("body", schema, {"mode": "PERMISSIVE"})).withColumn("__error", F.when(keys.isNull(), "not a JSON object").when(F.size(F.array_except(keys, known)) > 0, "unknown field"))


def read_records(spark: SparkSession, path: str | list[str], strict: bool = False, pattern: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """Records with __path and __line, the order of which settles ties. Lines that don't parse, or that have
    unknown fields, are left out; strict fails on the first of them when the result is used."""
    rows = _parsed(_lines(spark, path, pattern, recursive), RECORD)
    if strict:
        # in the column that the filter below reads, so that no filter runs before it
        message = F.concat(F.col("__path"), F.lit(":"), F.col("__line"), F.lit(": "), F.col("__error"))
        rows = rows.withColumn("__error", F.when(F.col("__error").isNotNull(), F.raise_error(message).cast("string")))
    good = rows.where("__error is null").select("__record.*", *ORIGIN)
    return good.withColumn("uid", F.coalesce("uid", uid("source", "source_id")))


def read_inputs(spark: SparkSession, path: str | list[str], tier: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Valid records of a tier, and errors (__path, __line, error): identity fields must be there, the label known, the uid the derived one."""
    rows = _parsed(_lines(spark, path, pattern, False), RECORD)
    r = F.col("__record")
    missing = F.greatest(*[(F.length(strip(F.coalesce(r[c], F.lit("")))) == 0).cast("int") for c in ("source", "source_id", "url")]) == 1
    error = F.coalesce(F.col("__error"), F.when(missing, "source, source_id and url are required").when(~F.coalesce(r["label"], F.lit("unknown")).isin(*LABELS), "unknown label").when(F.coalesce(r["uid"], uid(r["source"], r["source_id"])) != uid(r["source"], r["source_id"]), "uid differs from the derived one"))
    judged = rows.withColumn("error", error)
    good = judged.where("error is null").select("__record.*", *ORIGIN, F.lit(tier).alias("tier"))
    return good.withColumn("uid", uid("source", "source_id")), judged.where("error is not null").select(*ORIGIN, "error")


def fail_on_errors(good: DataFrame, errors: DataFrame, key: str = "uid") -> DataFrame:
    """good, if there are no errors and no key twice; a driver error else."""
    first = errors.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['__path']}:{first[0]['__line']}: {first[0]['error']}")
    if twice := good.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key} {twice[0][0]} occurs more than once")
    return good


def known_keys(spark: SparkSession, path: str, key: str = "uid") -> DataFrame:
    """Distinct keys of what was written before; the basis of resuming."""
    return read_records(spark, path).select(key).where(F.col(key).isNotNull()).distinct()


REVIEW_REQUIRED = ("uid", "reviewer_task_relevant", "reviewer_label", "reviewer_image_usable", "reviewer_image_path", "reviewer_name")


def read_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Rows of a review CSV with csv_line (its header is line 1), and the sha256 of the file's bytes."""
    header = spark.read.text(path).first()
    names = [n.strip().strip('"') for n in (header[0] if header else "").removeprefix("﻿").split(",")]
    if missing := sorted(set(REVIEW_REQUIRED) - set(names)):
        raise ValueError(f"review columns are missing: {', '.join(missing)}")
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "__bad").csv(path)
    rows = rows.where(F.when(F.col("__bad").isNotNull(), F.raise_error(F.lit("a review row has more values than the header"))).otherwise(True)).drop("__bad")
    order = Window.orderBy("__at")  # one file, read as one partition: a review queue is made by hand
    numbered = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("csv_line", F.row_number().over(order) + 1).drop("__at")
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return numbered, digest


def posts(responses: DataFrame, source: str, categories: dict[int, str] | None = None) -> DataFrame:
    """Records of captured post listings (query, page, body); the first response that shows a post counts.

    Title and excerpt without tags and entities, the readable body, images of the content after the featured one.
    """
    post = "array<struct<id: long, date: string, date_gmt: string, slug: string, modified: string, link: string, title: struct<rendered: string>, excerpt: struct<rendered: string>, content: struct<rendered: string>, categories: array<long>, tags: array<long>, featured_media: long, jetpack_featured_media_url: string>>"
    rows = responses.select("query", "page", F.posexplode(F.from_json("body", post)).alias("pos", "p"))
    first = rows.groupBy("p.id").agg(F.min_by("p", F.struct("query", "page", "pos")).alias("p"))
    names = F.create_map(*[F.lit(x) for k, v in (categories or {}).items() for x in (k, v)]) if categories else F.expr("cast(map() as map<bigint, string>)")
    p, none = F.col("p"), F.expr("cast(array() as array<bigint>)")
    plain = lambda c: unescape_entities(strip_tags(F.coalesce(c, F.lit(""))))
    made = first.select(
        F.lit(source).alias("source"), p["id"].cast("string").alias("source_id"), p["link"].alias("url"), plain(p["title"]["rendered"]).alias("title"), F.coalesce(F.nullif(p["date_gmt"], F.lit("")), p["date"]).alias("published_at"),
        plain(p["excerpt"]["rendered"]).alias("claim_text"), p["content"]["rendered"].alias("html"), clean_html(p["content"]["rendered"]).alias("body_text"), page_images(p["content"]["rendered"], p["link"]).alias("images"),
        F.transform(F.coalesce(p["categories"], none), lambda c: F.coalesce(F.element_at(names, c), c.cast("string"))).alias("categories"), F.transform(F.coalesce(p["tags"], none), lambda t: t.cast("string")).alias("tags"),
        F.struct(p["slug"].alias("slug"), p["modified"].alias("modified"), p["featured_media"].alias("featured_media")).alias("raw"), F.coalesce(p["jetpack_featured_media_url"], F.lit("")).alias("__hero"),
    )
    hero = F.array(F.struct(F.col("__hero").alias("url"), F.lit("creative").alias("role"), F.col("title").alias("alt_text"), F.lit("").alias("caption"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")))
    shown = F.exists("images", lambda i: i["url"] == F.col("__hero"))
    images = F.when((F.col("__hero") == "") | shown, F.col("images")).otherwise(F.concat(hero, F.col("images")))
    return made.withColumn("images", images).drop("__hero").withColumn("uid", uid("source", "source_id"))


def claims(responses: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Records of captured claim listings (query, page, body): one a claim and review, of allowed hosts, the first by url."""
    claim = "struct<claims: array<struct<text: string, claimant: string, claimDate: string, claimReview: array<struct<publisher: struct<name: string, site: string>, url: string, title: string, reviewDate: string, textualRating: string, languageCode: string>>>>>"
    rows = responses.select("query", "page", F.posexplode(F.from_json("body", claim)["claims"]).alias("at", "c")).select("query", "page", "at", "c", F.posexplode("c.claimReview").alias("nth", "r"))
    made = rows.select("query", "page", "at", "nth", F.concat(F.lit("gfc:"), F.coalesce("r.publisher.site", "r.publisher.name")).alias("source"), F.col("r.url").alias("source_id"), F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.col("c.text").alias("claim_text"), F.col("r.textualRating").alias("verdict_raw"), F.col("r.reviewDate").alias("published_at"), F.col("r.languageCode").alias("language"))
    if hosts is not None:
        made = made.where(F.regexp_replace(F.lower(F.expr("try_parse_url(url, 'HOST')")), r"^www\.", "").isin(*hosts))
    rest = [c for c in made.columns if c not in ("query", "page", "at", "nth", "url")]
    first = made.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("query", "page", "at", "nth")).alias("x"))
    return first.select("url", "x.*").withColumn("uid", uid("source", "source_id"))


def sitemap(pages: DataFrame, filters: list[str] | None = None, depth: int = 2) -> DataFrame:
    """url, lastmod of captured sitemaps (url, body): index files are followed to a depth; any of the filters must occur."""
    entries = "array<struct<loc: string, lastmod: string>>"
    opened = pages.select("url", F.from_xml("body", T.StructType.fromDDL(f"url {entries}, sitemap {entries}")).alias("x"))
    listed = opened.select(F.explode("x.sitemap").alias("s"), "url").select("url", F.trim("s.loc").alias("child"))
    roots = opened.select("url").join(listed.select(F.col("child").alias("url")), "url", "left_anti")
    level, reached = roots, roots
    for _ in range(depth):
        level = level.join(listed, "url").select(F.col("child").alias("url"))
        reached = reached.unionByName(level)
    urls = opened.join(reached.distinct(), "url", "left_semi").select(F.explode("x.url").alias("u")).select(F.trim("u.loc").alias("url"), "u.lastmod")
    if filters:
        urls = urls.where(F.exists(F.array(*[F.lit(f) for f in filters]), lambda f: F.contains("url", f)))
    return urls.groupBy("url").agg(F.min("lastmod").alias("lastmod"))


def image_sitemap(pages: DataFrame, host: str, languages: tuple[str, ...] = ("en", "hi")) -> DataFrame:
    """image_url, page_url, language of captured image sitemaps, by trust rules: https, the exact host, no credentials, default port."""
    shape = T.StructType.fromDDL("url array<struct<loc: string, `image:image`: array<struct<`image:loc`: string>>>>")
    rows = pages.select(F.explode(F.from_xml("body", shape)["url"]).alias("u")).select(F.trim("u.loc").alias("page_url"), F.explode("u.`image:image`").alias("i")).select("page_url", F.trim("i.`image:loc`").alias("image_url"))
    inner = F.regexp_extract("image_url", r"/_next/image\?(?:.*&)?url=([^&]*)", 1)
    rows = rows.withColumn("image_url", F.when(inner != "", F.try_url_decode(inner)).otherwise(F.col("image_url")))
    trusted = f"^https://{re.escape(host)}(:443)?/"
    language = F.regexp_extract("page_url", r"^https://[^/]+/([a-z]{2})(?:/|$)", 1)
    name = F.regexp_extract("image_url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    good = F.col("page_url").rlike(trusted) & F.col("image_url").rlike(trusted) & language.isin(*languages) & ~name.rlike("(?i)(icon|logo|favicon)")
    return rows.withColumn("language", language).where(good)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, digest, bytes of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def cache_key(url: Column | str) -> Column:
    return F.substring(F.sha2((F.col(url) if isinstance(url, str) else url).cast("binary"), 256), 1, 24)
