"""From records to training examples: the image to use, its text, cohorts that all models share, and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import assemble, strip
from sieveline.operators.relevance import score

LABEL_IDS = {"real": 0, "fake": 1}
EXCLUDED_ROLES = ("annotated", "site_chrome")
LEAST_BYTES, MOST_IMAGES = 4096, 8


def _area(i: Column) -> Column:
    return F.coalesce(i["width"], F.lit(0)) * F.coalesce(i["height"], F.lit(0))


def _eligible(images: Column) -> Column:
    return F.filter(images, lambda i: ~F.coalesce(i["role"].isin(*EXCLUDED_ROLES), F.lit(False)))


def _largest(images: Column) -> Column:
    """The image with the largest area, the first of equals; null for none."""
    placed = F.transform(images, lambda i, k: F.struct(_area(i).alias("area"), (-k).alias("place"), i.alias("image")))
    best = F.array_max(F.transform(placed, lambda x: F.struct(x["area"], x["place"])))
    return F.get(F.filter(placed, lambda x: (x["area"] == best["area"]) & (x["place"] == best["place"])), F.lit(0))["image"]


def picked_image(images: Column | str = "images") -> Column:
    """The largest downloaded image of an eligible role."""
    images = F.col(images) if isinstance(images, str) else images
    return _largest(F.filter(_eligible(images), lambda i: F.length(i["local_path"]) > 0))


def picked_text(images: Column | str = "images") -> Column:
    """Recognised text of the picked image; if none is downloaded, of the largest eligible one."""
    images = F.col(images) if isinstance(images, str) else images
    return F.coalesce(picked_image(images)["ocr_text"], F.when(picked_image(images).isNull(), _largest(_eligible(images))["ocr_text"]), F.lit(""))


def image_only_claim(df: DataFrame, threshold: int = 4000) -> DataFrame:
    """Adds image_only: the image's text is relevant, and the claim alone is not. Titles are left out on purpose."""
    by_image = score(df.withColumn("image_text", picked_text()), fields=[("image_text", 15)], threshold=threshold).withColumnRenamed("is_relevant", "__image")
    both = score(by_image.withColumn("claim", F.coalesce("claim_text", F.lit(""))), fields=[("claim", 20)], threshold=threshold)
    return both.withColumn("image_only", F.col("__image") & ~F.col("is_relevant")).drop("__image", "is_relevant", "claim", "image_text", "score_milli", "relevance", "hits", "off_topic_hits")


def to_examples(records: DataFrame, splits: DataFrame | None = None, require_image: bool = False, require_text: bool = True, max_chars: int = 4000) -> DataFrame:
    """uid, text, label, image_path, source, cluster_id, split of records with a known label and the required inputs."""
    text = assemble([picked_text(), F.col("claim_text"), F.col("title")], max_chars=max_chars)
    label = F.when(F.col("label") == "real", LABEL_IDS["real"]).when(F.col("label") == "fake", LABEL_IDS["fake"])
    cluster = F.coalesce(F.nullif("cluster_id", F.lit("")), "uid") if "cluster_id" in records.columns else F.col("uid")
    out = records.select("uid", text.alias("text"), label.alias("label"), picked_image()["local_path"].alias("image_path"), "source", cluster.alias("cluster_id")).where("label is not null")
    if require_image:
        out = out.where("image_path is not null")
    if require_text:
        out = out.where(F.length(strip("text")) > 0)
    if splits is None:
        return out.withColumn("split", F.lit(""))
    return out.join(splits.select("uid", "split"), "uid", "left").withColumn("split", F.coalesce("split", F.lit("")))


def common_cohort(examples: DataFrame, files: DataFrame, require_image: bool = True) -> tuple[DataFrame, DataFrame]:
    """Examples that every arm can use, and problems: (uid or split, problem). files: image_path, digest of readable images."""
    joined = examples.join(files.select("image_path", "digest"), "image_path", "left")
    usable = (F.length(strip(F.coalesce("text", F.lit("")))) > 0) & (F.col("digest").isNotNull() if require_image else F.lit(True))
    cohort = joined.where(usable)
    twice = examples.groupBy("uid").count().where("count > 1").select(F.col("uid").alias("at"), F.lit("duplicate uid").alias("problem"))
    shared = cohort.where("digest is not null").groupBy("digest").agg(F.count_distinct("split").alias("k"), F.min("uid").alias("at")).where("k > 1").select("at", F.lit("image bytes are shared across splits").alias("problem"))
    single = cohort.groupBy("split").agg(F.count_distinct("label").alias("k")).where("k < 2").select(F.col("split").alias("at"), F.lit("a class is missing").alias("problem"))
    return cohort, twice.unionByName(shared).unionByName(single)


def reviewed_subset(cohort: DataFrame, uids: list[str], reviewed: bool) -> DataFrame:
    """Rows of a reviewed list of uids, all of which must be in the cohort, once each, with both classes."""
    if reviewed is not True or not uids or len(set(uids)) != len(uids):
        raise ValueError("a subset needs reviewed: true and unique uids")
    wanted = cohort.sparkSession.createDataFrame([(u,) for u in uids], "uid string")
    if unknown := [r[0] for r in wanted.join(cohort, "uid", "left_anti").limit(5).collect()]:
        raise ValueError(f"not in the cohort: {', '.join(unknown)}")
    out = cohort.join(F.broadcast(wanted), "uid", "left_semi")
    if out.select("label").distinct().count() < 2:
        raise ValueError("a subset needs both classes")
    return out


def geometry(records: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with decoded widths and heights, and the status of each image. sizes: local_path, width, height (null if unreadable) of what exists."""
    rows = records.select("uid", F.posexplode_outer("images").alias("pos", "image"))
    path = F.col("image.local_path")
    seen = sizes.select(F.col("local_path").alias("__path"), F.col("width").alias("__w"), F.col("height").alias("__h"), F.lit(True).alias("__there"))
    joined = rows.join(seen, path == F.col("__path"), "left")
    outside = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    same = F.col("image.width").eqNullSafe(F.col("__w")) & F.col("image.height").eqNullSafe(F.col("__h"))
    status = F.when(F.coalesce(F.length(path), F.lit(0)) == 0, "not_downloaded").when(outside, "outside_data_dir").when(F.col("__there").isNull(), "missing").when(F.col("__w").isNull(), "unreadable").when(same, "unchanged").otherwise("repaired")
    judged = joined.withColumn("status", status)
    fixed = F.when(F.col("status") == "repaired", F.col("image").withField("width", F.col("__w")).withField("height", F.col("__h"))).otherwise(F.col("image"))
    images = judged.where("image is not null").groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", fixed.alias("image")))), lambda x: x["image"]).alias("images"))
    return records.drop("images").join(images, "uid", "left"), judged.where("image is not null").select("uid", path.alias("path"), "status")


def accepted_downloads(files: DataFrame, least_bytes: int = LEAST_BYTES, most: int = MOST_IMAGES) -> DataFrame:
    """The first ``most`` images a record that are large enough and decode. files: uid, pos, bytes, decodable."""
    from pyspark.sql.window import Window

    good = files.where((F.col("bytes") >= least_bytes) & F.col("decodable") & (F.col("pos") >= 0))
    return good.withColumn("__nth", F.row_number().over(Window.partitionBy("uid").orderBy("pos"))).where(F.col("__nth") <= most).drop("__nth")


def with_discovered(found: DataFrame, discovered: DataFrame) -> DataFrame:
    """Verdict, claim and language of a discovery (uid, verdict_raw, claim_text, language) win over scraped ones where they are not blank."""
    other = discovered.select("uid", *[F.col(c).alias(f"__{c}") for c in ("verdict_raw", "claim_text", "language")])
    joined = found.join(other, "uid", "left")
    return joined.withColumns({c: F.coalesce(F.nullif(f"__{c}", F.lit("")), F.col(c)) for c in ("verdict_raw", "claim_text", "language")}).drop(*[c for c in other.columns if c != "uid"])


def with_recovered_verdicts(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fills blank verdicts from claim reviews (url, claim, verdict) of the records' pages; their claim then counts too."""
    joined = records.join(reviews.select("url", F.col("claim").alias("__claim"), F.col("verdict").alias("__verdict")).dropDuplicates(["url"]), "url", "left")
    blank = (F.coalesce(F.length(strip("verdict_raw")), F.lit(0)) == 0) & (F.length("__verdict") > 0)
    return joined.withColumns({"claim_text": F.when(blank & (F.length("__claim") > 0), F.col("__claim")).otherwise(F.col("claim_text")), "verdict_raw": F.when(blank, F.col("__verdict")).otherwise(F.col("verdict_raw"))}).drop("__claim", "__verdict")


def fresh_candidates(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates (uid, image_url) whose uid and image no record has."""
    images = records.select(F.explode("images").alias("i")).select(F.col("i.url").alias("image_url")).distinct()
    return candidates.join(records.select("uid"), "uid", "left_anti").join(images, "image_url", "left_anti")


def recognition_report(records: DataFrame) -> DataFrame:
    """records, with_text, mean and upper median of characters of the recognised text of all images."""
    from sieveline.operators.metrics import upper_median

    texts = records.select(F.explode("images").alias("i")).select(strip(F.coalesce("i.ocr_text", F.lit(""))).alias("t"))
    sizes = texts.select(F.length("t").alias("n")).where("n > 0")
    return texts.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.length("t") > 0).alias("with_text")).crossJoin(sizes.agg(F.avg("n").alias("mean_chars"), upper_median("n").alias("median_chars")))
