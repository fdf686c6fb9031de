"""Segments of text and time: chunks, greedy spacing, overlaps of findings with transcripts."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OVERLAP, LEAST_CHARS = 120, 160
#: Characters of a cell by which findings meet segments.
CELL = 1024
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def chunk_spans(text: str, max_chars: int = 1800) -> list[tuple[int, int]]:
    """Spans of at most max_chars that cover a text; each ends at the last blank of its second half, and the next overlaps it."""
    if max_chars < LEAST_CHARS:
        raise ValueError(f"chunks need {LEAST_CHARS} characters at least")
    blanks = [m.start() for m in re.finditer(" ", text)]

    def end_of(start: int) -> int:
        limit = start + max_chars
        if limit >= len(text):
            return len(text)
        last = bisect.bisect_left(blanks, limit) - 1
        return max(blanks[last], start + 1) if last >= 0 and blanks[last] >= start + max_chars // 2 else limit

    back, spans = min(OVERLAP, max_chars // 4), []
    while text and (not spans or spans[-1][1] < len(text)):
        start = max(spans[-1][0] + 1, spans[-1][1] - back) if spans else 0
        spans.append((start, end_of(start)))
    return spans


def _spans(max_chars: int):
    @F.pandas_udf(SPANS)
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b} for a, b in chunk_spans(t or "", max_chars)])

    return of


def chunks(df: DataFrame, text: str = "text", max_chars: int = 1800) -> DataFrame:
    """A row a chunk: the columns of df but the text, and start, end, chunk. Only spans come from Python; Spark cuts the text."""
    if max_chars < LEAST_CHARS:
        raise ValueError(f"chunks need {LEAST_CHARS} characters at least")
    dealt = df.withColumn("__span", F.explode(_spans(max_chars)(F.col(text))))
    start, end = F.col("__span.start"), F.col("__span.end")
    return dealt.select(*[c for c in df.columns if c != text], start.alias("start"), end.alias("end"), F.substring(F.col(text), start + 1, end - start).alias("chunk"))


def spaced(times: Column | str, interval: float) -> Column:
    """Greedy spacing over a sorted array: a time is kept if the interval has passed since the last one kept."""
    times = F.col(times) if isinstance(times, str) else times
    none = F.struct(F.expr("cast(array() as array<double>)").alias("kept"), F.lit(float("-inf")).alias("next"))
    step = lambda a, t: F.when(t + 1e-6 >= a["next"], F.struct(F.concat(a["kept"], F.array(t)).alias("kept"), (t + interval).alias("next"))).otherwise(a)
    return F.aggregate(F.transform(F.array_sort(times), lambda t: t.cast("double")), none, step, lambda a: a["kept"])


def positioned(segments: DataFrame, key: str, ordinal: str, text: str) -> DataFrame:
    """Adds left and right: the place of each segment in its texts joined by blanks."""
    before = Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return segments.withColumn("left", left).withColumn("right", F.col("left") + F.length(text))


def overlapping(findings: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Least start and most end time of the segments (left, right, start, end) that each finding (from_char, to_char) meets."""
    # both are dealt over the cells they touch, so a key's findings meet near segments alone
    def cells(first: str, end: str) -> Column:
        low = F.floor(F.col(first) / CELL)
        return F.explode(F.sequence(low, F.greatest(low, F.floor((F.col(end) - 1) / CELL)))).alias("__cell")

    other = segments.select(F.col(key).alias("__key"), "left", "right", F.col("start").alias("__start"), F.col("end").alias("__end"), cells("left", "right"))
    dealt = findings.select("*", cells("from_char", "to_char")).withColumnRenamed("__cell", "__own")
    met = dealt.join(other, (dealt[key] == F.col("__key")) & (F.col("__own") == F.col("__cell")) & (F.col("left") < F.col("to_char")) & (F.col("right") > F.col("from_char")))
    return met.groupBy(*findings.columns).agg(F.min("__start").alias("time_start"), F.max("__end").alias("time_end"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; as an aggregate, so a key's rows never meet in one task before they are reduced."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(least.alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def interleave(df: DataFrame, queue: str, order: str, queues: list[str]) -> DataFrame:
    """Round robin of queues: the first of each in the order of ``queues``, then the second of each, and so on."""
    nth = F.row_number().over(Window.partitionBy(queue).orderBy(order))
    place = F.array_position(F.array(*[F.lit(q) for q in queues]), F.col(queue))
    return df.withColumn("nth", nth).withColumn("place", place).where("place > 0").orderBy("nth", "place")


def round_robin(candidates: list[tuple[str, str]], queues: list[str]) -> list[str]:
    """Urls by turns of languages, sorted in each; a turn skips urls that were taken before. For small lists."""
    waiting = {q: sorted({u for lang, u in candidates if lang == q}, reverse=True) for q in queues}
    taken: dict[str, None] = {}
    while any(waiting.values()):
        for q in queues:
            while waiting[q]:
                url = waiting[q].pop()
                if url not in taken:
                    taken[url] = None
                    break
    return list(taken)
