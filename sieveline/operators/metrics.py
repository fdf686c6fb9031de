"""Classification metrics over (y_true 0/1, score) rows, by any grouping.

Everything is grouped by score first, so that running sums go over distinct scores; ties count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def checked(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Fails on labels other than 0 and 1 and on null scores."""
    bad = F.col(y).isNull() | ~F.col(y).isin(0, 1) | F.col(score).isNull()
    return df.where(F.when(bad, F.raise_error(F.lit("labels must be 0 or 1 and scores not null"))).otherwise(True))


def confusion(df: DataFrame, y: str = "y_true", predicted: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    cell = lambda t, p: F.count_if((F.col(y) == t) & (F.col(predicted) == p))
    return df.groupBy(*(by or [])).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def summary(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1, macro_f1, accuracy and the majority baseline of confusion rows; zero denominators give 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return matrix.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _f1(tp, fp, fn),
        "macro_f1": (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2, "accuracy": _ratio(tp + tn, n), "majority_baseline": _ratio(F.greatest(tp + fn, fp + tn), n),
    })


def by_score(df: DataFrame, y: str = "y_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))


def pr_curve(df: DataFrame, y: str = "y_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """threshold, tp, fp, precision and recall at each distinct score."""
    keys = by or []
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = by_score(df, y, score, by).select(*keys, F.col("score").alias("threshold"), F.sum("pos").over(down).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"), F.sum("pos").over(whole).alias("positives"))
    return rows.select(*keys, "threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("positives")).alias("recall"))


def pr_auc(df: DataFrame, y: str = "y_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Average precision, by steps; 0 if a class is absent."""
    keys = by or []
    curve = pr_curve(df, y, score, by)
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    area = curve.withColumn("__part", step * F.col("precision")).groupBy(*keys).agg(F.sum("__part").alias("area"), F.max("tp").alias("pos"), F.max("fp").alias("neg"))
    return area.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area")).otherwise(0.0).alias("pr_auc"))


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Area by average ranks; 0 if a class is absent."""
    keys = by or []
    up = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = by_score(df, y, score, by).withColumn("__rank", F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = rows.groupBy(*keys).agg(F.sum(F.col("__rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    return sums.select(*keys, F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / (pos * neg)).otherwise(0.0).alias("roc_auc"))


def best_threshold(df: DataFrame, y: str = "y_true", score: str = "score", metric: str = "f1", by: list[str] | None = None) -> DataFrame:
    """The lowest of the scores at which the metric (f1 or macro_f1) is largest, and its value."""
    if metric not in ("f1", "macro_f1"):
        raise ValueError("metric must be f1 or macro_f1")
    keys = by or []
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by_score(df, y, score, by).withColumns({"tp": F.sum("pos").over(down), "fp": F.sum(F.col("n") - F.col("pos")).over(down), "p": F.sum("pos").over(whole), "all": F.sum("n").over(whole)})
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("p") - tp, F.col("all") - F.col("p") - fp
    value = _f1(tp, fp, fn) if metric == "f1" else (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2
    best = rows.withColumn("value", value).groupBy(*keys).agg(F.max(F.struct("value", (-F.col("score")).alias("low"))).alias("best"))
    return best.select(*keys, (-F.col("best.low")).alias("threshold"), F.col("best.value").alias("value"))


def seed_aggregate(runs: DataFrame, arm: str = "arm", value: str = "value") -> DataFrame:
    """Mean and sample deviation (0 for a single run) of a metric by arm."""
    return runs.groupBy(arm).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("runs"))


def ablation(runs: DataFrame, reference: str, arm: str = "arm", value: str = "value") -> DataFrame:
    """seed_aggregate with the difference to a reference arm (null for that arm itself)."""
    table = seed_aggregate(runs, arm, value)
    base = table.where(F.col(arm) == reference).select(F.col("mean").alias("__base"))
    return table.join(F.broadcast(base), how="left").withColumn("delta", F.when(F.col(arm) != reference, F.col("mean") - F.col("__base"))).drop("__base")


def spread_verdict(runs: DataFrame, fused: str, singles: list[str], arm: str = "arm", value: str = "value") -> DataFrame:
    """How the fused arm stands to the best single one, against the spread over seeds."""
    table = seed_aggregate(runs, arm, value)
    best = table.where(F.col(arm).isin(singles)).orderBy(F.desc("mean"), arm).limit(1).select(F.col("mean").alias("m"), F.col("std").alias("s"), F.col("runs").alias("r"))
    both = table.where(F.col(arm) == fused).crossJoin(F.broadcast(best))
    gap, spread = F.col("mean") - F.col("m"), F.greatest("std", "s")
    words = F.when(F.least("runs", "r") < 2, "single seed; uncertainty unmeasured").when(F.abs(gap) <= spread, "within observed seed spread").when(gap > 0, "above best single modality beyond observed seed spread").otherwise("below best single modality beyond observed seed spread")
    return both.select(gap.alias("gap"), words.alias("verdict"))


def latency_summary(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """p50 and p95 (linear between ranks), mean, population deviation, least and most."""
    return df.groupBy(*(by or [])).agg(F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def budget_checks(measured: DataFrame, budget: DataFrame) -> DataFrame:
    """Status and headroom of each budget row (name, direction max or min, bound) against measured (name, value)."""
    joined = F.broadcast(budget).join(measured, "name", "left")
    ok = F.when(F.col("direction") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    room = F.when(F.col("direction") == "max", F.col("bound") - F.col("value")).otherwise(F.col("value") - F.col("bound"))
    return joined.select("name", "direction", "bound", "value", room.alias("headroom"), F.when(F.col("value").isNull(), "not measured").when(ok, "ok").otherwise("over").alias("status"))


def multilabel(df: DataFrame, truth: str = "labels", predicted: str = "predicted", labels: list[str] | None = None) -> DataFrame:
    """Per label: tp, fp, fn, tn, support, precision, recall, f1 of rows with arrays of labels."""
    names = F.array(*[F.lit(x) for x in labels]) if labels else F.array_union(truth, predicted)
    rows = df.select(truth, predicted, F.explode(names).alias("label"))
    flags = rows.select("label", F.array_contains(truth, F.col("label")).cast("int").alias("y_true"), F.array_contains(predicted, F.col("label")).cast("int").alias("y_pred"))
    return summary(confusion(flags, by=["label"])).withColumn("support", F.col("tp") + F.col("fn")).drop("macro_f1", "accuracy", "majority_baseline")


def multilabel_totals(df: DataFrame, truth: str = "labels", predicted: str = "predicted", labels: list[str] | None = None) -> DataFrame:
    """One row: macro_f1 over the labels, and exact_match, the share of rows with equal sets of labels."""
    macro = multilabel(df, truth, predicted, labels).agg(F.avg("f1").alias("macro_f1"))
    same = F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))
    return macro.crossJoin(df.agg(F.avg(same.cast("double")).alias("exact_match")))


def early_stop(history: DataFrame, patience: int, by: list[str] | None = None, step: str = "step", value: str = "value") -> DataFrame:
    """Adds best (the highest value so far), waited (steps since it was first reached) and stopped to the history of a run."""
    past = Window.partitionBy(*(by or [])).orderBy(step)
    rows = history.withColumn("best", F.max(value).over(past)).withColumn("__nth", F.row_number().over(past))
    reached = Window.partitionBy(*(by or []), "best").orderBy(step)
    return rows.withColumn("waited", F.col("__nth") - F.first("__nth").over(reached)).withColumn("stopped", F.col("waited") >= patience).drop("__nth")


def upper_median(values: str) -> Column:
    """The element in the middle of the sorted values, the upper one of two: the lower one in falling order. Counts distinct values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {values} desc)").cast("long")
