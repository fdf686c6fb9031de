import pytest
from pyspark.sql import functions as F

from sieveline.functions import lexicons, text as tx
from sieveline.operators import relevance


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values) if None not in values.values() else ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_sizes_of_fixed_values():
    assert len(lexicons.RELEVANCE_TERMS) == 117 and len(lexicons.OFF_TOPIC_TERMS) == 27
    assert len(lexicons.STOP_WORDS) == 37 and len(lexicons.ROMANISED) == 62


def test_uid_and_normalise(spark):
    import hashlib

    assert one(spark, tx.uid("s", "i"), s="boomlive", i="1") == hashlib.sha1(b"boomlive:1").hexdigest()[:16]
    assert one(spark, tx.normalise("t"), t="  Ünï-CODE, 100% पैसा\tडबल! ") == "ünï code 100 पैसा डबल"
    assert one(spark, tx.normalise("t"), t=None) == ""


def test_scripts_and_gate(spark):
    p = one(spark, tx.script_profile("t"), t="पैसा abc 12")
    assert (p.devanagari, p.latin, p.digit) == (pytest.approx(0.444), pytest.approx(0.333), pytest.approx(0.222))
    assert one(spark, tx.script_profile("t"), t="...").latin == 0.0
    assert one(spark, tx.looks_like_garbage("t"), t="short") and one(spark, tx.looks_like_garbage("t"), t="--- ... !!! ab") and not one(spark, tx.looks_like_garbage("t"), t="plain words here")


def test_cues(spark):
    found = {c.cue: list(c.matches) for c in one(spark, tx.cues("t"), t="Guaranteed 20% profit, guaranteed! Profit; join now on Telegram. Subject to market risks")}
    assert found["certainty"] == ["Guaranteed", "guaranteed"] and found["returns"] == ["profit", "Profit"] and found["amounts"] == ["20%"] and found["contact"] == ["join now", "Telegram"] and "risk_notice" in found


def test_transliteration(spark):
    assert one(spark, tx.transliterate("t"), t="Paisa double, guaranteed!") == "पैसा डबल, गारंटीड!"
    assert one(spark, tx.both_forms("t"), t="RETURNS - SEBI") == "RETURNS - SEBI | RETURNS- SEBI"
    assert one(spark, tx.both_forms("t"), t="plain words") == "plain words"


def test_assembly_and_guard(spark):
    assert one(spark, tx.assemble(["o", "c", "t"], max_chars=20), o=" ocr ", c="", t="title words here") == "ocr [SEP] title word"
    assert one(spark, tx.guard_cell("t"), t="=1+1") == "'=1+1" and one(spark, tx.guard_cell("t"), t="a=1") == "a=1"


def test_shingles(spark):
    w = F.split("t", " ")
    assert list(one(spark, tx.shingles(w), t="a b c d")) == ["a b c", "b c d"]
    assert list(one(spark, tx.shingles(w), t="a b")) == ["a", "b"]


def test_relevance(spark):
    rows = [
        ("SEBI registered advisor guarantees double your money", "", "", ""),
        ("Cricket and film news", "", "", ""),
        ("निवेश घोटाला", "", "", ""),
        ("", "", "", None),
        ("", "", "", "money " * 5000),
    ]
    got = relevance.score(spark.createDataFrame(rows, "title string, claim string, image_text string, body string")).collect()
    assert [r.is_relevant for r in got] == [True, False, True, False, False]
    assert got[1].score_milli == -4000 and list(got[1].off_topic_hits) == ["cricket", "film"]
    assert got[4].score_milli == 700 and list(got[4].hits) == ["money"]
    assert got[0].hits[0] == "sebi"


def test_threshold_is_exact(spark):
    # 0.7 * 2.0 + 1.5 * 1.5 + 0.7 * 1.5 + 0.7 * 1.5 + 1.5 * 1.5 - 4 is 4.0, which floats miss
    row = [("", "money riot film", "bitcoin profit income usdt", "")]
    assert relevance.score(spark.createDataFrame(row, "title string, claim string, image_text string, body string")).first().score_milli == 4000


VERDICTS = [("False", "fake"), ("Not true", "fake"), ("Half True", "fake"), ("TRUE", "real"), ("Mostly true", "real"), ("Unverified", "unknown"), ("Insufficient evidence: true?", "unknown"), ("असत्य", "fake"), ("सत्य", "real"), ("satire", "fake"), ("", "unknown"), ("  ", "unknown"), ("no rating", "unknown"), ("AI-generated", "fake"), (None, "unknown")]


def test_verdicts_and_titles(spark):
    got = spark.createDataFrame(VERDICTS, "v string, e string").select("e", relevance.verdict_label("v").alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]
    titles = [("Fact check: No, this is not it", "fake"), ("Viral ads are fake", "fake"), ("Yes, it happened", "real"), ("This video is genuine", "real"), ("Something else", "unknown")]
    got = spark.createDataFrame(titles, "t string, e string").select("e", relevance.title_label("t").alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]
    row = spark.createDataFrame([("", "Yes, it is so")], "v string, t string")
    assert row.select(relevance.assigned_label("v", "t").alias("x")).first().x == "real"


def test_reviewed_label(spark):
    sha = "a" * 64
    review = "named_struct('method', 'csv_review_import_v1', 'uid', 'u', 'task_relevant', true, 'image_usable', {usable}, 'label', 'real', 'reviewer_name', '{name}', 'review_csv_sha256', '%s', 'source_records_sha256', '%s', 'image_path', 'p')" % (sha, sha)
    base = "array(named_struct('local_path', 'p', 'role', 'creative'))"
    for usable, name, wanted in (("true", "R", "real"), ("false", "R", None), ("true", " ", None)):
        row = spark.sql(f"select 'u' uid, {review.format(usable=usable, name=name)} review, {base} images")
        assert row.select(relevance.reviewed_label().alias("x")).first().x == wanted


def test_class_weights(spark):
    got = {r.label: r.weight for r in relevance.class_weights(spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "label string")).collect()}
    assert got == {"a": pytest.approx(100 / 180), "b": 5.0}
    assert relevance.class_weights(spark.createDataFrame([("a",)], "label string")).count() == 0
