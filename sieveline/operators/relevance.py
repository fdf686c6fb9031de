"""Relevance scores from weighted lexicons, labels from verdicts, and the curated set.

Scores are exact: term weights are hundredths and field weights tenths, so a score is a whole number of
thousandths, and comparing it with the threshold doesn't depend on the order of a floating-point sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import lexicons
from sieveline.functions.text import nfkc, normalise, strip


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def _found(text: Column, term: Column, term_chars: Column, whole_chars: int) -> Column:
    """A whole phrase, or any place of it for terms longer than whole_chars."""
    return _padded(text).contains(F.concat(F.lit(" "), term, F.lit(" "))) | ((term_chars > whole_chars) & text.contains(term))


def _hits(table: Column, text: Column) -> Column:
    return F.filter(table, lambda t: _found(text, t["term"], t["chars"], lexicons.SUBSTRING_CHARS))


def score(
    df: DataFrame,
    terms: list[tuple[str, int]] = lexicons.RELEVANCE_TERMS,
    off_topic: list[str] = lexicons.OFF_TOPIC_TERMS,
    fields: list[tuple[str, int]] = lexicons.FIELD_WEIGHTS,
    threshold: int = lexicons.THRESHOLD,
    most_hits: int = lexicons.MOST_HITS,
) -> DataFrame:
    """Adds score_milli, relevance (rounded to 2), hits, off_topic_hits and is_relevant.

    fields name string columns of df with their weights in tenths; missing ones count as empty. The body is cut
    to its first characters after normalising. Each term counts once a field. The lexicon is one literal array,
    so this is a projection without joins; normalised texts are columns of their own and are computed once.
    """
    have = [(name, weight) for name, weight in fields if name in df.columns]
    out = df
    for name, _ in have:
        text = normalise(nfkc(name))
        out = out.withColumn(f"__{name}", F.substring(text, 1, lexicons.BODY_CHARS) if name == "body" else text)
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("chars"), F.lit(w).alias("weight")) for t, w in dict(terms).items()])
    per_field = []
    for name, _ in have:
        text = F.col(f"__{name}")
        hit = _hits(table, text)
        out = out.withColumn(f"__hit_{name}", F.when(F.length(text) > 0, hit).otherwise(F.slice(table, 1, 0)))
        per_field.append(f"__hit_{name}")
    total = F.lit(0)
    for (_, weight), hit in zip(have, per_field, strict=True):
        total = total + F.aggregate(F.transform(hit, lambda t: t["weight"]), F.lit(0), lambda a, x: a + x) * weight
    head = F.concat_ws(" ", *[F.coalesce(F.col(f"__{n}"), F.lit("")) for n, _ in have if n in ("title", "claim")])
    words = F.array(*[F.lit(t) for t in dict.fromkeys(off_topic)]) if off_topic else F.expr("cast(array() as array<string>)")
    out = out.withColumn("off_topic_hits", F.filter(words, lambda t: _padded(head).contains(F.concat(F.lit(" "), t, F.lit(" ")))))
    out = out.withColumn("score_milli", (total - F.size("off_topic_hits") * lexicons.OFF_TOPIC_WEIGHT).cast("long"))
    hits = F.array_distinct(F.flatten(F.array(*[F.transform(F.col(h), lambda t: t["term"]) for h in per_field])))
    out = out.withColumn("hits", F.slice(hits, 1, most_hits))
    out = out.withColumn("relevance", F.round(F.col("score_milli") / 1000, 2)).withColumn("is_relevant", F.col("score_milli") >= threshold)
    return out.drop(*[f"__{n}" for n, _ in have], *per_field)


def image_text(images: Column | str = "images") -> Column:
    """Alternative text, caption and recognised text of all images of a record."""
    images = F.col(images) if isinstance(images, str) else images
    return F.array_join(F.transform(images, lambda i: F.concat_ws(" ", F.coalesce(i["alt_text"], F.lit("")), F.coalesce(i["caption"], F.lit("")), F.coalesce(i["ocr_text"], F.lit("")))), " ")


def verdict_label(verdict: Column | str, rules: list[tuple[str, str]] = lexicons.VERDICT_RULES) -> Column:
    """Label of a publisher's verdict: the first rule that matches, else unknown."""
    text = strip(F.coalesce(F.col(verdict) if isinstance(verdict, str) else verdict, F.lit("")))
    out = F.lit("unknown")
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def title_label(title: Column | str, real: str = lexicons.TITLE_REAL, fake: str = lexicons.TITLE_FAKE) -> Column:
    text = strip(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    return F.when(text.rlike(f"(?i){real}"), "real").when(text.rlike(f"(?i){fake}"), "fake").otherwise("unknown")


def reviewed_label(review: Column | str = "review", uid: Column | str = "uid", images: Column | str = "images") -> Column:
    """Label of a complete accepted review, else null.

    review is a struct (method, uid, task_relevant, image_usable, label, reviewer_name, review_csv_sha256,
    source_records_sha256, image_path); the approved image must be one of the record's own.
    """
    review, uid, images = (F.col(c) if isinstance(c, str) else c for c in (review, uid, images))
    own = F.exists(images, lambda i: (i["local_path"] == review["image_path"]) & (i["role"] == "creative"))
    valid = (
        (review["method"] == "csv_review_import_v1") & (review["uid"] == uid) & review["task_relevant"] & review["image_usable"]
        & review["label"].isin("fake", "real") & (F.length(strip(review["reviewer_name"])) > 0)
        & review["review_csv_sha256"].rlike("^[0-9a-f]{64}$") & review["source_records_sha256"].rlike("^[0-9a-f]{64}$") & own
    )
    return F.when(F.coalesce(valid, F.lit(False)), review["label"])


def assigned_label(verdict: Column | str, title: Column | str, reviewed: Column | None = None) -> Column:
    """A review's label, else the verdict's, else the title's, else unknown."""
    by_verdict = F.nullif(verdict_label(verdict), F.lit("unknown"))
    return F.coalesce(*([reviewed] if reviewed is not None else []), by_verdict, title_label(title))


def curated(df: DataFrame, require_image: bool = False) -> DataFrame:
    """Relevant rows with a known label and, if asked for, a downloaded image."""
    out = df.where(F.col("is_relevant") & (F.col("label") != "unknown"))
    return out.where(F.exists("images", lambda i: F.length(i["local_path"]) > 0)) if require_image else out


def finance_flag(automatic: Column | str = "is_relevant", review: Column | str = "review") -> Column:
    """The decision of an accepted review (a struct with task_relevant, null without one), else the automatic one."""
    automatic, review = (F.col(c) if isinstance(c, str) else c for c in (automatic, review))
    return F.coalesce(review["task_relevant"], automatic)


def source_yield(df: DataFrame, by: str = "source") -> DataFrame:
    """Per source: total, relevant, labelled and kept rows; df has is_relevant and label.

    With columns images, reviewed or automatic also with_image (any downloaded), manual_reviewed and
    automatic_finance: how many rows have them.
    """
    known = F.col("label") != "unknown"
    more = {
        "images": ("with_image", lambda: F.exists("images", lambda i: F.length(i["local_path"]) > 0)),
        "reviewed": ("manual_reviewed", lambda: F.col("reviewed")),
        "automatic": ("automatic_finance", lambda: F.col("automatic")),
    }
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_relevant").alias("relevant"),
        F.count_if(known).alias("labelled"),
        F.count_if(known & F.col("is_relevant")).alias("kept"),
        *[F.count_if(F.coalesce(having(), F.lit(False))).alias(name) for column, (name, having) in more.items() if column in df.columns],
    )


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share of the rows, and the share of the largest class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return counts.join(F.broadcast(whole)).select(label, "n", (F.col("n") / F.col("total")).alias("share"), (F.col("most") / F.col("total")).alias("majority_share"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse-frequency weights n / (k * c) by class; no rows for a single class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(whole)).where("classes > 1").select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
