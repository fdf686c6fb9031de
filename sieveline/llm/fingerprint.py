"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases in one pass: each phrase is the shortest run, from where the last
one ended, that is not in the dictionary yet. The hashes of the phrase set are kept as a minimum-hash
signature, the ``size`` smallest of them; the likeness of two signatures estimates the Jaccard similarity of
the phrase sets, a compression-like similarity (the published Lempel-Ziv Jaccard distance). Sets of at most
``size`` phrases are compared exactly.

Null texts count as empty; an empty text has an empty fingerprint, and two empty ones are alike (1.0), an
empty and another not (0.0). Equal texts have equal fingerprints. In the order of neighbours null ids come
last, and repeated ids stand in order of their texts. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Powers

SIZE = 128
MOST_RANGES = 10_000
_EMPTY = np.zeros(0, np.uint32)
_powers = Powers()


def parse(text: str, at: int = 0, seen: set[str] | None = None, stop: int | None = None) -> tuple[list[int], set[str]]:
    """Ends of the phrases of text[at:]; seen: phrases so far. Ends before the phrase that would pass stop.

    The dictionary holds every beginning of its phrases, so the length of the longest known run is found by
    stepping from the last phrase's length.
    """
    seen = set() if seen is None else seen
    ends: list[int] = []
    n = len(text) if stop is None else stop
    add, put = seen.add, ends.append
    size = 1
    while at < n:
        if at + size > n:
            size = n - at
        piece = text[at : at + size]
        if piece in seen:
            size += 1
            piece = text[at : at + size]
            while piece in seen and at + size <= n:
                size += 1
                piece = text[at : at + size]
        else:
            while size > 1:
                shorter = piece[:-1]
                if shorter in seen:
                    break
                piece = shorter
                size -= 1
        if at + size > n:
            if stop is None:
                put(n)  # the rest is a known phrase
            break
        add(piece)
        at += size
        put(at)
    return ends, seen


def _hashes(text: str, ends: list[int]) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    points ^= points >> np.uint64(32)
    to = np.array(ends, np.int64)
    start = np.concatenate([[0], to[:-1]])
    return (_powers.spans(_powers.prefix(points), start, to) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    if len(hashes) > 4 * size:
        hashes = hashes[hashes <= np.partition(hashes, 2 * size)[2 * size]]
    return np.unique(hashes)[:size]


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    return signature(_hashes(text, parse(text)[0]), size) if text else _EMPTY


def fingerprint_pair(text: str, edited: str, same: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that agree on the first ``same`` code points, which are parsed once."""
    head, seen = parse(text, 0, None, same)
    at = head[-1] if head else 0
    own, _ = parse(text, at, set(seen))
    other, _ = parse(edited, at, seen)
    return tuple(signature(_hashes(t, head + rest), size) if t else _EMPTY for t, rest in ((text, own), (edited, other)))


def written(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    first = np.concatenate([[True], both[1:] != both[:-1]])
    # the size smallest of the union; a value counts at its first place, and as shared if it comes again
    return float(twice[first][:size].mean())


def fingerprints(documents: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """Adds fingerprint (string) to documents."""
    plain = documents.select(*[c for c in documents.columns if c != "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [written(fingerprint(x, size)) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"fingerprint": pa.array(made, pa.string())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, fingerprint string")


def with_next(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = 2_000) -> DataFrame:
    """Deals rows to ranges of ids: columns range, sentinel, id, body; sorted, ids descending.

    Each range holds, last, a copy of the row that follows it (sentinel), so that neighbours can be read off
    in one task a range. One row a range is copied; the texts are shuffled once.
    """
    ids = documents.select(F.col(doc_id).cast("long").alias("id"))
    n = ids.count()
    number = min(max(1, -(-n // rows)), MOST_RANGES)  # a range is dealt to one task; more rows make larger ranges
    if number > 1:
        cuts = ids.where("id is not null").agg(F.percentile_approx("id", [i / number for i in range(1, number)], 10 * number)).first()[0] or []
    else:
        cuts = []
    cuts = sorted(set(cuts))
    # ranges count from the largest ids; null ids are in the last one
    slot = F.when(F.col("id").isNull(), F.lit(len(cuts))) if cuts else F.lit(0)
    if cuts:
        slot = slot.otherwise(F.lit(len(cuts)) - _rank(cuts, F.col("id")))
    dealt = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("body")).withColumn("range", slot.cast("int"))
    heads = {r[0]: r[1] for r in ids.withColumn("range", slot.cast("int")).groupBy("range").agg(F.max("id")).collect()}
    order = sorted(heads)
    before = {b: a for a, b in zip(order, order[1:], strict=False)} | ({order[0]: order[-1]} if order else {})
    copied = F.lit(None).cast("int")
    if order:
        pairs = F.create_map(*[x for b, a in before.items() for x in (F.lit(b), F.struct(F.lit(a).alias("to"), F.lit(heads[b]).cast("long").alias("head")))])
        mine = pairs[F.col("range")]
        copied = F.when(F.col("id").eqNullSafe(mine["head"]), mine["to"])
    return dealt.select(
        F.explode(F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("sentinel")), F.when(copied.isNotNull(), F.struct(copied.alias("range"), F.lit(True).alias("sentinel")))), lambda x: x.isNotNull())).alias("x"),
        "id", "body",
    ).select("x.*", "id", "body")


def _rank(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value: first among every m-th cut, then among the m that follow it."""
    m = max(1, math.isqrt(len(cuts)))
    every = F.array(*[F.lit(c) for c in cuts[::m]])
    top = F.size(F.filter(every, lambda c: c <= value))
    inner = F.slice(F.array(*[F.lit(c) for c in cuts]), F.greatest(top - 1, F.lit(0)) * m + 1, F.lit(m))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * m + F.size(F.filter(inner, lambda c: c <= value)))


def compare_with_edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per document, with the next in descending order of ids (after the last the first): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    dealt = with_next(documents, doc_id, text)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(number, "range").sortWithinPartitions("range", "sentinel", F.col("id").desc_nulls_last(), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last: tuple | None = None  # range, id, text of the row that waits for its next
        done: tuple | None = None  # a row made, but for near_next, with its fingerprint
        last_range = None

        def made(i: int | None, own: str, following: str) -> tuple:
            half = min(len(own) // 2, len(following))
            keep = len(own) - len(own) // 2
            edited = own[:keep] + following[:half]
            fp, edited_fp = fingerprint_pair(own, edited, keep, size)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return [i, len(own), digest, written(fp), written(edited_fp), likeness(fp, edited_fp, size)], fp

        for batch in batches:
            out = []
            for rng, sentinel, i, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rng != last_range:
                    last = done = None
                    last_range = rng
                if last is None:
                    if not sentinel:
                        last = (i, body)
                    continue
                row, fp = made(*last, body)
                if done:
                    out.append([*done[0], likeness(done[1], fp, size)])
                done = (row, fp)
                if sentinel:
                    out.append([*row, likeness(fp, fingerprint(body, size), size)])
                    last = done = None  # further sentinels are copies with the same id
                else:
                    last = (i, body)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
