import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import audit, ml
from sieveline.sources import records as src, sinks
from sieveline.streaming import resume

SHA = "b" * 64
IMG = "array<struct<local_path: string, role: string, sha256: string, ocr_text: string>>"


def inputs(spark, *rows):
    return spark.createDataFrame([("u", *r) for r in rows], "uid string, tier string, path string, line int, label string, verdict string, url string, body string")


RAW = ("raw", "a", 1, "unknown", "", "https://e.org/x/#f", "b1")


@pytest.mark.parametrize(("other", "reason"), [
    (("enriched", "b", 1, "fake", "", "https://e.org/x", "b2"), None),
    (("enriched", "b", 1, "real", "False", "https://e.org/x", "b2"), "conflicting_labels_or_verdicts"),
    (("enriched", "b", 1, "fake", "", "https://e.org/y", "b2"), "conflicting_provenance_urls"),
    (("raw", "b", 1, "unknown", "", "https://e.org/x", "b2"), "ambiguous_records_at_winning_tier"),
])
def test_selection(spark, other, reason):
    good, bad = audit.select_inputs(inputs(spark, RAW, other), ["body"])
    if reason is None:
        assert good.first().path == "b" and bad.count() == 0
    else:
        assert good.count() == 0 and list(bad.first().reasons) == [reason]


def test_discarded_label(spark):
    known = ("raw", "a", 1, "fake", "", "https://e.org/x", "b1")
    _, bad = audit.select_inputs(inputs(spark, known, ("enriched", "b", 1, "unknown", "", "https://e.org/x", "b2")), ["body"])
    assert list(bad.first().reasons) == ["enrichment_would_discard_known_label"]


def test_audit_reasons(spark):
    rows = [
        ("u1", "fake", "Fact check: stocks", "", [("a.png", "creative", "", "profit now")]),
        ("u2", "unknown", "nothing", "", [("a.png", "creative", "x", ""), (None, "creative", "", ""), ("../up.png", "creative", "", ""), ("gone.png", "annotated", "", "false")]),
        ("u3", "real", "election money", "", None),
    ]
    records = spark.createDataFrame(rows, f"uid string, label string, title string, claim_text string, images {IMG}")
    files = spark.createDataFrame([("a.png", "d1", 10)], "local_path string, digest string, bytes long")
    got = {r.uid: set(r.reasons) for r in audit.audit_records(records, files).collect()}
    assert got["u1"] == {"exact_image_shared_across_records", "possible_label_marker_in_title"}
    assert {"stored_image_hash_mismatch", "image_not_downloaded", "image_path_outside_data_dir", "missing_image_file", "annotation_or_site_chrome", "excluded_image_contains_ocr", "possible_label_marker_in_ocr", "label_needs_review", "no_eligible_image_ocr", "eligible_image_without_ocr"} <= got["u2"]
    assert {"no_usable_local_image", "possible_nonpromotion_finance_or_political_story"} <= got["u3"]


def test_reviews(spark):
    records = spark.createDataFrame([("u1", "Title", "claim", [("a.png", "creative", "", "")])], f"uid string, title string, claim_text string, images {IMG}")
    base = {"uid": "u1", "csv_line": 2, "reviewer_task_relevant": "yes", "reviewer_label": "Fake", "reviewer_image_usable": "yes", "reviewer_image_path": "a.png", "reviewer_name": "R", "reviewer_caption": "cap", "reviewer_caption_is_original": "yes", "reviewer_caption_source": "s"}
    files = spark.createDataFrame([("a.png", "d1", True)], "local_path string, digest string, decodable boolean")
    shape = ", ".join(f"{k} {'int' if k == 'csv_line' else 'string'}" for k in base)

    def decide(**change):
        review = spark.createDataFrame([tuple({**base, **change}.values())], shape)
        return review, audit.review_decisions(records, review, files)

    review, good = decide()
    assert good.first().status == "accepted"
    kept = audit.accept_reviews(records, review, good).first()
    assert (kept.title, kept.claim_text, kept.label, len(kept.images)) == ("", "cap", "fake", 1)
    for change, reason in [({"uid": "zz"}, "unknown_uid"), ({"reviewer_label": ""}, "pending_or_invalid_label"), ({"reviewer_task_relevant": "no"}, "reviewer_marked_irrelevant"), ({"reviewer_caption_source": ""}, "caption_requires_original_confirmation_and_source"), ({"reviewer_image_path": "b.png"}, "reviewed_image_file_missing")]:
        assert reason in decide(**change)[1].first().reasons


def test_annotations(spark):
    def row(**change):
        base = {"uid": "u", "group_id": "g", "split": "train", "text": "act now", "caption": "", "as_of": "2026-01-01", "labels": ["urgency"], "evidence": [("urgency", "text", 0, 7, "act now", None)], "review": ("human", "approved", "R", "2026-02-01")}
        return tuple({**base, **change}.values())

    shape = "uid string, group_id string, split string, text string, caption string, as_of string, labels array<string>, evidence array<struct<label: string, field: string, start: int, end: int, quote: string, published_at: string>>, review struct<method: string, status: string, reviewer_name: string, reviewed_at: string>"
    rows = [row(), row(uid="v", split="test", group_id="h"), row(uid="w", group_id="g2", text="other", evidence=[("urgency", "text", 1, 3, "xx", None)]), row(uid="x", group_id="g3", text="third", labels=["urgency", "nope"], evidence=[])]
    got = {r.uid: set(r.reasons) for r in audit.annotation_problems(spark.createDataFrame(rows, shape), ["urgency"]).collect()}
    assert got["u"] == got["v"] == {"text_spans_splits"} and got["w"] == {"quote_differs_from_span"} and got["x"] == {"unknown_or_repeated_label", "label_without_evidence"}


def line(i, **more):
    return json.dumps({"source": "s", "source_id": str(i), "url": f"https://e.org/{i}", "label": "fake", "title": "t", **more})


def test_reading(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("﻿" + line(1) + "\n\n" + "{broken\n" + line(2, unknown_key=1) + "\n")
    (tmp_path / "a.jsonl").write_text(line(3) + "\n" + line(4, uid="wrong") + "\n" + line(5, label="odd") + "\n" + line(6, source="") + "\n")
    (tmp_path / "c.txt").write_text(line(9))
    assert {r.source_id for r in src.read_records(spark, str(tmp_path)).collect()} == {"1", "3", "4", "5", "6"}
    with pytest.raises(Exception, match="not a JSON object|unknown field"):
        src.read_records(spark, str(tmp_path), strict=True).collect()
    good, errors = src.read_inputs(spark, str(tmp_path), "raw")
    assert {r.source_id for r in good.collect()} == {"1", "3"} and errors.count() == 5
    with pytest.raises(ValueError):
        src.fail_on_errors(good, errors)
    assert src.known_keys(spark, str(tmp_path)).count() == 5


def test_review_files(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿" + ",".join(src.REVIEW_REQUIRED) + "\nu1,yes,fake,yes,a.png,R\nu2,,,,,\n")
    rows, digest = src.read_reviews(spark, str(p))
    assert [(r.uid, r.csv_line) for r in rows.collect()] == [("u1", 2), ("u2", 3)] and len(digest) == 64
    p2 = tmp_path / "bad.csv"
    p2.write_text("uid,x\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        src.read_reviews(spark, str(p2))


def test_captured_responses(spark):
    post = [{"id": 7, "date": "2026", "link": "l", "title": {"rendered": "<b>T</b>"}, "excerpt": {"rendered": "E"}, "content": {"rendered": "<p>c</p>"}, "categories": [3, 4], "jetpack_featured_media_url": "https://i"}]
    r = src.posts(spark.createDataFrame([(1, 1, json.dumps(post)), (2, 1, json.dumps(post))], "query int, page int, body string"), "site", {3: "money"}).collect()
    assert len(r) == 1 and r[0].title == "T" and list(r[0].categories) == ["money", "4"] and r[0].images[0].url == "https://i"
    claim = {"claims": [{"text": "c", "claimReview": [{"publisher": {"site": "p"}, "url": "https://www.a.org/1", "title": "t", "textualRating": "False"}, {"publisher": {"site": "q"}, "url": "https://b.org/1", "title": "t", "textualRating": "True"}]}]}
    got = src.claims(spark.createDataFrame([(1, 1, json.dumps(claim))], "query int, page int, body string"), ["a.org"]).collect()
    assert [(x.source, x.verdict_raw) for x in got] == [("gfc:p", "False")]
    maps = [("https://e.org/index.xml", "<sitemapindex><sitemap><loc>https://e.org/s.xml</loc></sitemap></sitemapindex>"), ("https://e.org/s.xml", "<urlset><url><loc>https://e.org/news/1</loc><lastmod>2026</lastmod></url><url><loc>https://e.org/about</loc></url></urlset>")]
    assert [(x.url, x.lastmod) for x in src.sitemap(spark.createDataFrame(maps, "url string, body string"), ["/news/"]).collect()] == [("https://e.org/news/1", "2026")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "uid string, v int")
    assert [sinks.append_new(rows, out), sinks.append_new(rows, out)] == [2, 0] and spark.read.parquet(out).count() == 2
    sinks.publish(rows, str(tmp_path / "final"))
    with pytest.raises(FileExistsError):
        sinks.publish(rows, str(tmp_path / "final"))
    queue = spark.createDataFrame([("=x", ["a", "b"], "")], "uid string, tags array<string>, reviewer_name string")
    path = str(tmp_path / "queue")
    sinks.write_review_queue(queue, path)
    r = spark.read.option("header", True).csv(path).first()
    assert (r.uid, r.tags) == ("'=x", "a | b")
    sinks.write_review_queue(queue.withColumn("reviewer_name", F.lit("R")), path)
    with pytest.raises(ValueError, match="holds reviews"):
        sinks.write_review_queue(queue, path)
    with pytest.raises(ValueError):
        sinks.check_name("../x")
    files = spark.createDataFrame([("/d/a", "1"), ("/d/b", "2")], "path string, digest string")
    wanted = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "name string, digest string")
    assert {(x.name, x.problem) for x in sinks.bundle_problems(files, wanted).collect()} == {("b", "changed"), ("c", "missing")}


def test_streaming_resume(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    schema = "source string, source_id string, uid string"
    (source / "1.json").write_text("\n".join(json.dumps({"source": "s", "source_id": i}) for i in "aba"))
    for _ in range(2):
        resume.ingest(resume.read_stream(spark, str(source), spark.createDataFrame([], schema).schema), out, mark).awaitTermination(120)
    (source / "2.json").write_text("\n".join(json.dumps({"source": "s", "source_id": i}) for i in "bc"))
    resume.ingest(resume.read_stream(spark, str(source), spark.createDataFrame([], schema).schema), out, mark).awaitTermination(120)
    assert sorted(r.source_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_models(spark):
    rows = [(i, f"{'gain profit now' if i % 2 else 'calm weather day'} number{i % 7} word{i % 5}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label double")
    train, val, test = df.where("id < 36"), df.where("id >= 36 and id < 48"), df.where("id >= 48")
    blocks, (a, b, c) = ml.text_features(train, [train, val, test], size=300)
    assert "number6" in blocks[0].words and len(blocks[0].words) <= 300
    got = {r["model"]: r for r in ml.experiment(a, b, c, grids={"svm": [1.0], "logistic": [1.0], "bayes": [0.5]})}
    assert all(r["macro_f1"] == 1.0 for r in got.values()) and got["svm"]["value"] == 1.0


def test_contract_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
