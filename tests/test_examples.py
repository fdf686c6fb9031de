import pytest

from sieveline.operators import examples as ex

IMG = "array<struct<url: string, local_path: string, role: string, width: int, height: int, ocr_text: string>>"
ROWS = [
    ("u1", "fake", "Title", "plain claim", "s", [("a", "a.png", "annotated", 900, 900, "stamp"), ("b", "b.png", "creative", 10, 10, "guaranteed return on crypto trading, sebi registered"), ("c", "c.png", "creative", 10, 10, "other")]),
    ("u2", "real", "", "", "s", [("d", None, "creative", 5, 5, "only text")]),
    ("u3", "unknown", "x", "y", "s", None),
    ("u4", "real", "", "double your money with this ponzi", "s", [("e", "../e.png", "creative", None, None, "sebi registered stock tips")]),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(ROWS, f"uid string, label string, title string, claim_text string, source string, images {IMG}")


def test_examples(spark, records):
    got = {r.uid: r for r in ex.to_examples(records, spark.createDataFrame([("u1", "test")], "uid string, split string")).collect()}
    assert set(got) == {"u1", "u2", "u4"} and got["u1"].image_path == "b.png" and got["u1"].split == "test" and got["u2"].split == ""
    assert got["u1"].text.startswith("guaranteed return") and got["u2"].text == "only text" and (got["u1"].label, got["u2"].label) == (1, 0)
    assert {r.uid for r in ex.to_examples(records, require_image=True).collect()} == {"u1", "u4"}
    assert {r.uid: r.image_only for r in ex.image_only_claim(records).collect()} == {"u1": True, "u2": False, "u3": False, "u4": False}


def test_cohort_and_subset(spark, records):
    rows = spark.createDataFrame([("u1", "t", 1, "a", "train"), ("u2", "t", 0, "a", "test"), ("u3", " ", 0, "b", "test")], "uid string, text string, label int, image_path string, split string")
    cohort, problems = ex.common_cohort(rows, spark.createDataFrame([("a", "d")], "image_path string, digest string"))
    assert {r.uid for r in cohort.collect()} == {"u1", "u2"}
    assert {r.problem for r in problems.collect()} == {"image bytes are shared across splits", "a class is missing"}
    assert ex.reviewed_subset(cohort, ["u1", "u2"], True).count() == 2
    for uids, reviewed in ((["u1"], True), (["u1", "zz"], True), (["u1", "u2"], False)):
        with pytest.raises(ValueError):
            ex.reviewed_subset(cohort, uids, reviewed)


def test_geometry_and_joins(spark, records):
    sizes = spark.createDataFrame([("b.png", 20, 30), ("c.png", 10, 10), ("a.png", None, None)], "local_path string, width int, height int")
    fixed, status = ex.geometry(records, sizes)
    assert {(r.path, r.status) for r in status.collect()} == {("a.png", "unreadable"), ("b.png", "repaired"), ("c.png", "unchanged"), (None, "not_downloaded"), ("../e.png", "outside_data_dir")}
    assert [i.width for i in {r.uid: r for r in fixed.collect()}["u1"].images] == [900, 20, 10]
    base = spark.createDataFrame([("u1", "l", "", "old", "en")], "uid string, url string, verdict_raw string, claim_text string, language string")
    r = ex.with_recovered_verdicts(base, spark.createDataFrame([("l", "new", "False")], "url string, claim string, verdict string")).first()
    assert (r.verdict_raw, r.claim_text) == ("False", "new")
    r = ex.with_discovered(base, spark.createDataFrame([("u1", "True", "", "hi")], "uid string, verdict_raw string, claim_text string, language string")).first()
    assert (r.verdict_raw, r.claim_text, r.language) == ("True", "old", "hi")
    fresh = spark.createDataFrame([("u1", "z"), ("u9", "a"), ("u8", "z")], "uid string, image_url string")
    assert [x.uid for x in ex.fresh_candidates(fresh, records).collect()] == ["u8"]
    assert ex.recognition_report(records).first().with_text == 5
    files = spark.createDataFrame([("u1", 0, 10, True), ("u1", 1, 5000, True), ("u1", 2, 5000, False), ("u1", 3, 9000, True)], "uid string, pos int, bytes int, decodable boolean")
    assert [x.pos for x in ex.accepted_downloads(files, most=1).collect()] == [1]
