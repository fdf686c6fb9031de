import pytest

from sieveline.operators import metrics as m


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, score double")


def test_confusion_and_f1(spark):
    rows = [(1, 1)] * 4 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 3
    r = m.summary(m.confusion(spark.createDataFrame(rows, "y_true int, y_pred int"))).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (4, 1, 2, 3)
    assert r.precision == 0.8 and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(8 / 11) and r.macro_f1 == pytest.approx((8 / 11 + 6 / 9) / 2)
    none = m.summary(m.confusion(spark.createDataFrame([(1, 0)], "y_true int, y_pred int"))).first()
    assert none.precision == none.recall == none.f1 == 0.0


def test_areas(spark):
    rows = scores(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert m.roc_auc(rows).first().roc_auc == 0.75
    assert m.pr_auc(rows).first().pr_auc == pytest.approx(0.8333, abs=1e-4)
    ties = scores(spark, [(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)])
    assert m.roc_auc(ties).first().roc_auc == 0.5 and m.pr_auc(ties).first().pr_auc == 0.5
    assert m.pr_curve(ties).count() == 1
    one = scores(spark, [(1, 0.2), (1, 0.4)])
    assert m.roc_auc(one).first().roc_auc == 0.0 and m.pr_auc(one).first().pr_auc == 0.0


def test_best_threshold(spark):
    rows = scores(spark, [(0, 0.1), (1, 0.3), (0, 0.3), (1, 0.9)])
    best = m.best_threshold(rows).first()
    assert (best.threshold, best.value) == (0.3, pytest.approx(0.8))
    assert m.best_threshold(scores(spark, [(1, 0.2), (1, 0.7)])).first().threshold == 0.2
    with pytest.raises(ValueError):
        m.best_threshold(rows, metric="accuracy")


def test_checked(spark):
    with pytest.raises(Exception, match="labels must be"):
        m.checked(scores(spark, [(2, 0.1)])).collect()


def test_seeds_and_verdict(spark):
    runs = spark.createDataFrame([("fused", 1, 0.9), ("fused", 2, 0.8), ("text", 1, 0.84), ("text", 2, 0.82), ("image", 1, 0.4)], "arm string, seed int, value double")
    got = {r.arm: r for r in m.ablation(runs, "text").collect()}
    assert got["image"].std == 0.0 and got["text"].delta is None and got["fused"].delta == pytest.approx(0.02)
    assert m.spread_verdict(runs, "fused", ["text", "image"]).first().verdict == "within observed seed spread"
    assert m.spread_verdict(runs, "fused", ["image"]).first().verdict.startswith("single seed")


def test_latency_and_budget(spark):
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10)], "value double")
    r = m.latency_summary(rows).first()
    assert (r.p50, r.p95) == (2.5, pytest.approx(8.95)) and r.std == pytest.approx(3.5355, abs=1e-4)
    budget = spark.createDataFrame([("a", "max", 5.0), ("b", "min", 5.0), ("c", "max", 1.0)], "name string, direction string, bound double")
    got = {x.name: x.status for x in m.budget_checks(spark.createDataFrame([("a", 4.0), ("b", 4.0)], "name string, value double"), budget).collect()}
    assert got == {"a": "ok", "b": "over", "c": "not measured"}


def test_multilabel(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), (["a", "b"], ["b"]), ([], ["a"])], "labels array<string>, predicted array<string>")
    got = {r.label: r for r in m.multilabel(rows, labels=["a", "b"]).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn, got["a"].support) == (1, 1, 1, 2) and got["b"].f1 == 1.0
