"""Checks over many rows, each giving reason codes: input selection, dataset audit, review import, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions.text import strip
from sieveline.operators.relevance import verdict_label

KNOWN = ("fake", "real")
# ---- Fixed values: words that screen for leaked labels and for topics ----
LABEL_MARKERS = r"(?i)(?:\b(?:fake|false|misleading|debunked|doctored|fact[ -]?check|genuine|official|legitimate|authentic|verified|not true)\b|(?:फर्जी|फ़र्ज़ी|भ्रामक|झूठ|असत्य))"
INVESTMENT = r"(?i)(?:\b(?:invest\w*|trad(?:e|ing|er)|stocks?|shares?|mutual funds?|returns?|profits?|ponzi|crypto\w*|forex|demat|broker\w*|money doubl\w*|paisa double)\b|(?:निवेश|मुनाफा|शेयर|पैसा डबल|रिटर्न))"
OTHER_FINANCE = r"(?i)\b(?:tax slabs?|crowdfund\w*|election\w*|congress|bjp|cash seiz\w*|seiz(?:e|ed|ure)|cheques?|temple|mosque)\b"
# ---- End of fixed values ----


def reasons(**checks: Column) -> Column:
    """Sorted array of the names whose checks hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])))


def markers(text: Column | str, pattern: str = LABEL_MARKERS) -> Column:
    """Sorted distinct lower-case matches."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.lower(m))))


def plain_url(url: Column | str) -> Column:
    """Without fragment and closing slashes."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"/+$", "")


def select_inputs(rows: DataFrame, payload: list[str], key: str = "uid", best_tier: str = "enriched") -> tuple[DataFrame, DataFrame]:
    """The row to use of each key, and the conflicts (key, reasons), which are left out.

    rows: key, tier, path, line, label, verdict, url and the payload columns. The best tier replaces others whole.
    """
    known = F.when(F.col("label").isin(*KNOWN), F.col("label"))
    mapped = verdict_label("verdict")
    by_verdict = F.when(mapped.isin(*KNOWN), mapped)
    wins = F.max((F.col("tier") == best_tier).cast("int")).over(Window.partitionBy(key))
    marked = rows.withColumn("__top", wins).withColumn("__wins", (F.col("__top") == 0) | (F.col("tier") == best_tier))
    body = F.sha2(F.to_json(F.struct(*payload)), 256)
    found = marked.withColumns({"__label": known, "__verdict": by_verdict, "__url": plain_url("url"), "__body": F.when(F.col("__wins"), body)})
    first = F.min(F.when(F.col("__wins"), F.struct("path", "line", "label"))).alias("first")
    groups = found.groupBy(key).agg(
        F.array_union(F.collect_set("__label"), F.collect_set("__verdict")).alias("labels"),
        F.count_distinct("__label").alias("n_labels"),
        F.count_distinct("__url").alias("urls"),
        F.count_distinct("__body").alias("bodies"),
        F.count(F.lit(1)).alias("variants"),
        first,
    )
    judged = groups.withColumn("reasons", reasons(
        conflicting_labels_or_verdicts=F.size("labels") > 1,
        conflicting_provenance_urls=F.col("urls") > 1,
        ambiguous_records_at_winning_tier=F.col("bodies") > 1,
        enrichment_would_discard_known_label=(F.col("n_labels") > 0) & (F.col("first.label") == "unknown"),
    ))
    good = judged.where(F.size("reasons") == 0).select(key, F.col("first.path").alias("path"), F.col("first.line").alias("line"))
    return rows.join(good, [key, "path", "line"]), judged.where(F.size("reasons") > 0).select(key, "reasons", "variants")


def audit_records(records: DataFrame, files: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """Reason codes by record. records: key, label, title, claim_text, images; files: local_path, digest, bytes of what exists.

    Paths that leave the data directory are reported and never joined. Exact duplicates go by the files' own bytes.
    """
    base = records.select(key, "label", "title", "claim_text", "images")
    counts = Window.partitionBy(key)
    assets = base.withColumn("__n", F.count(F.lit(1)).over(counts)).select("*", F.posexplode_outer("images").alias("pos", "image"))
    path = F.col("image.local_path")
    outside = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    seen = F.row_number().over(Window.partitionBy(key, path).orderBy("pos"))
    assets = assets.withColumns({"path": F.when(F.length(path) > 0, path), "outside": F.coalesce(outside, F.lit(False)), "nth": seen})
    if files is None:
        files = records.sparkSession.createDataFrame([], "local_path string, digest string, bytes long")
    owners = Window.partitionBy("digest")
    joined = assets.join(files.select(F.col("local_path").alias("path"), "digest", "bytes"), "path", "left").withColumn("digest", F.when(~F.col("outside"), F.col("digest")))
    sharing = F.when(F.col("digest").isNotNull(), (F.min(key).over(owners) != F.max(key).over(owners)))
    has_image = F.col("image").isNotNull()
    eligible = has_image & ~F.coalesce(F.col("image.role").isin("annotated", "site_chrome"), F.lit(False))
    ocr = F.length(strip(F.coalesce(F.col("image.ocr_text"), F.lit("")))) > 0
    exists = F.col("digest").isNotNull()
    whole = exists & (F.coalesce("bytes", F.lit(0)) > 0)
    joined = joined.withColumn("__codes", reasons(
        image_not_downloaded=has_image & F.col("path").isNull(),
        image_path_outside_data_dir=F.col("path").isNotNull() & F.col("outside"),
        missing_image_file=F.col("path").isNotNull() & ~F.col("outside") & ~exists,
        empty_or_unreadable_image_file=exists & ~whole,
        stored_image_hash_mismatch=whole & (F.length("image.sha256") > 0) & (F.col("image.sha256") != F.col("digest")),
        duplicate_image_reference=exists & (F.col("nth") > 1),
        annotation_or_site_chrome=has_image & ~eligible,
        excluded_image_contains_ocr=has_image & ~eligible & ocr,
        eligible_image_without_ocr=eligible & exists & ~ocr,
        possible_label_marker_in_ocr=has_image & ocr & F.col("image.ocr_text").rlike(LABEL_MARKERS),
        exact_image_shared_across_records=sharing,
    )).withColumns({"__usable": (eligible & whole).cast("int"), "__ocr": (eligible & ocr).cast("int"), "__text": F.when(eligible & ocr, F.col("image.ocr_text"))})
    by_record = joined.groupBy(key).agg(
        F.first("label").alias("label"), F.first("title").alias("title"), F.first("claim_text").alias("claim_text"), F.max("__n").alias("n"),
        F.flatten(F.collect_list("__codes")).alias("codes"), F.sum("__usable").alias("usable"), F.sum("__ocr").alias("with_ocr"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "__text"))), lambda x: x["__text"]).alias("texts"),
    )
    task = F.concat_ws(" ", "title", "claim_text", F.concat_ws(" ", "texts"))
    own = reasons(
        possible_label_marker_in_title=F.col("title").rlike(LABEL_MARKERS),
        possible_label_marker_in_claim_text=F.col("claim_text").rlike(LABEL_MARKERS),
        no_usable_local_image=F.coalesce("usable", F.lit(0)) == 0,
        no_eligible_image_ocr=F.coalesce("with_ocr", F.lit(0)) == 0,
        label_needs_review=~F.col("label").isin(*KNOWN),
        duplicate_uid=F.col("n") > 1,
        no_clear_investment_terms_in_claim_or_image=~task.rlike(INVESTMENT),
        possible_nonpromotion_finance_or_political_story=task.rlike(OTHER_FINANCE),
    )
    return by_record.select(key, "label", F.array_sort(F.array_distinct(F.concat("codes", own))).alias("reasons"))


def issue_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("reasons").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def split_checks(records: DataFrame, assigned: DataFrame, key: str = "uid") -> DataFrame:
    """check, n: what disagrees between records (key, label, cluster) and an assignment (key, split)."""
    joined = records.join(assigned, key, "full").withColumns({"in_records": F.col("cluster").isNotNull()})
    rows = [
        joined.where("in_records and split is null").agg(F.lit("missing").alias("check"), F.count(F.lit(1)).alias("n")),
        joined.where("not in_records").agg(F.lit("extra").alias("check"), F.count(F.lit(1)).alias("n")),
        assigned.where("split not in ('train', 'val', 'test')").agg(F.lit("invalid_split").alias("check"), F.count(F.lit(1)).alias("n")),
        joined.where("in_records").groupBy("cluster").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.lit("cluster_overlap").alias("check"), F.count(F.lit(1)).alias("n")),
        joined.where("in_records and split is not null").groupBy("split").agg(F.count_distinct("label").alias("k")).where("k < 2").agg(F.lit("single_class_split").alias("check"), F.count(F.lit(1)).alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key: keys on one side only."""
    return left.select(key).join(right.select(key), key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(right.select(key).join(left.select(key), key, "left_anti").select(F.lit("right").alias("side"), key))


def review_decisions(records: DataFrame, reviews: DataFrame, files: DataFrame, key: str = "uid") -> DataFrame:
    """Per review row: key, csv_line, status, reasons. files: local_path, digest, decodable."""
    value = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    owners = records.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.first("images").alias("images"))
    rows = reviews.withColumn(key, value(key)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rows = rows.join(owners, key, "left")
    yes = {c: F.lower(value(f"reviewer_{c}")) for c in ("task_relevant", "image_usable", "label", "caption_is_original")}
    path = value("reviewer_image_path")
    form = reasons(
        unknown_uid=F.col("candidates").isNull(),
        duplicate_review_uid=F.col("same") > 1,
        duplicate_candidate_uid=F.col("candidates") > 1,
        reviewer_marked_irrelevant=yes["task_relevant"] == "no",
        pending_or_invalid_task_relevance=~yes["task_relevant"].isin("yes", "no"),
        reviewer_marked_image_unusable=yes["image_usable"] == "no",
        pending_or_invalid_image_decision=~yes["image_usable"].isin("yes", "no"),
        pending_or_invalid_label=~yes["label"].isin(*KNOWN),
        reviewer_name_required=value("reviewer_name") == "",
        explicit_reviewed_image_path_required=path == "",
        caption_requires_original_confirmation_and_source=(value("reviewer_caption") != "") & ((yes["caption_is_original"] != "yes") | (value("reviewer_caption_source") == "")),
    )
    matching = F.filter("images", lambda i: i["local_path"] == path)
    rows = rows.withColumns({"form": form, "path": path, "matching": F.coalesce(matching, F.expr("cast(array() as array<struct<local_path: string>>)") if "images" not in records.columns else F.slice("images", 1, 0))})
    rows = rows.join(files.select(F.col("local_path").alias("path"), "digest", "decodable"), "path", "left")
    asset = F.get("matching", F.lit(0))
    checks = reasons(
        reviewed_image_outside_data_dir=F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"),
        reviewed_image_must_match_exactly_one_candidate_asset=F.size("matching") != 1,
        reviewed_image_file_missing=F.col("digest").isNull(),
        reviewed_image_is_annotation_or_site_chrome=asset["role"].isin("annotated", "site_chrome"),
    )
    content = reasons(reviewed_image_hash_mismatch=(F.length(asset["sha256"]) > 0) & (F.lower(asset["sha256"]) != F.col("digest")), reviewed_image_file_invalid=~F.col("decodable"))
    stage = F.when(F.size("form") > 0, F.col("form")).when(F.size(checks) > 0, checks).otherwise(content)
    return rows.select(key, "csv_line", F.when(F.size(stage) == 0, "accepted").otherwise("excluded").alias("status"), stage.alias("reasons"))


def accept_reviews(records: DataFrame, reviews: DataFrame, decisions: DataFrame, key: str = "uid") -> DataFrame:
    """Accepted records: label by the review, title blank, claim the confirmed caption, the approved image alone."""
    value = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    own = reviews.select(value(key).alias(key), value("reviewer_image_path").alias("__path"), F.lower(value("reviewer_label")).alias("__label"), value("reviewer_caption").alias("__caption"))
    kept = records.join(decisions.where("status = 'accepted'").select(key), key, "left_semi").join(own, key)
    image = F.transform(F.filter("images", lambda i: i["local_path"] == F.col("__path")), lambda i: i.withField("role", F.lit("creative")))
    return kept.withColumns({"title": F.lit(""), "claim_text": F.col("__caption"), "label": F.col("__label"), "images": image, "is_finance": F.lit(True)}).drop("__path", "__label", "__caption")


def annotation_problems(rows: DataFrame, labels: list[str]) -> DataFrame:
    """uid, reasons of framing annotations: row checks, and checks across rows and splits."""
    field = lambda e: F.when(e["field"] == "text", F.col("text")).when(e["field"] == "caption", F.col("caption"))
    spans = F.forall("evidence", lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(field(e))) & (F.substring(field(e), e["start"] + 1, e["end"] - e["start"]) == e["quote"]))
    covered = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["label"])))
    folded = F.lower(F.regexp_replace(strip("text"), r"\s+", " "))
    more = Window.partitionBy("uid")
    by_group, by_text = Window.partitionBy("group_id"), Window.partitionBy("__folded")
    late = F.exists("evidence", lambda e: (e["label"] == "selective_context") & (F.coalesce(e["published_at"], F.lit("")) > F.col("as_of")))
    checked = rows.withColumn("__folded", folded)
    return checked.select("uid", reasons(
        duplicate_uid=F.count(F.lit(1)).over(more) > 1,
        invalid_split=~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False)),
        review_not_approved=~F.coalesce((F.col("review.method") == "human") & (F.col("review.status") == "approved") & (F.length(strip("review.reviewer_name")) > 0), F.lit(False)),
        invalid_date=~F.coalesce(F.col("as_of").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_to_date(as_of) is not null"), F.lit(False)),
        reviewed_before_as_of=F.col("review.reviewed_at") < F.col("as_of"),
        unknown_or_repeated_label=(F.size(F.array_except("labels", F.array(*[F.lit(x) for x in labels]))) > 0) | (F.size(F.array_distinct("labels")) != F.size("labels")),
        quote_differs_from_span=~F.coalesce(spans, F.lit(False)),
        label_without_evidence=covered != F.array_sort("labels"),
        evidence_after_as_of=late,
        group_spans_splits=F.min("split").over(by_group) != F.max("split").over(by_group),
        text_spans_splits=(F.length("__folded") > 0) & (F.min("split").over(by_text) != F.max("split").over(by_text)),
    ).alias("reasons")).where(F.size("reasons") > 0)
