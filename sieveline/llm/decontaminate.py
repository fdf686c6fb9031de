"""Benchmark decontamination by winnowing.

Every run of ``window`` words has a fingerprint: the least hash of its ``gram``-word runs. As equal windows have
equal fingerprints, no shared window is missed. Items of fewer words are one window each, with that whole run as
their fingerprint.

1. The windows of the benchmark are a table: words, their hash, fingerprint, item.
2. One scan of the documents takes their fingerprints, keeps those in a bit set of the benchmark's, and extends
   them to the whole windows around them, which must be in a second bit set. The sets only spare work; they grow
   with the benchmark up to ``MOST_BITS``, and where they are full, more windows leave the scan and none is lost.
3. What is left is joined to the benchmark's windows by fingerprint and hash, and compared word by word. Documents
   in which the same windows stand at the same places are joined once.
4. The hits of a document are united and joined back to it.

Null texts have no words. Items with a null id mark words as hit, but are neither named nor counted. Repeated
documents each get their row; repeated items count once by id. Empty tables give empty or hitless results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Powers, Scratch, WordHashes, alnum_words, signed, winnow, word_chunks
from sieveline.llm.substring_dedup import fixed_set, inside

WINDOW, GRAM = 10, 4
#: Bits of a set, as a power of two: from so many to so many (32 MB), by the number of windows.
LEAST_BITS, MOST_BITS = 16, 28
#: Results of so many kinds of hits, and bytes of them, are broadcast; more are joined by shuffle, salted.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 100_000, 32_000_000, 32
#: Rows of an Arrow batch of windows.
BATCH = 20_000
WINDOWS = "n int, print long, window long, words binary, item string"
FOUND = pa.list_(pa.struct([("n", pa.int32()), ("print", pa.int64()), ("window", pa.int64()), ("words", pa.binary()), ("places", pa.list_(pa.int32()))]))


class Windows:
    """Windows of texts with their fingerprints."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.hashes, self.powers = WordHashes(), Powers()

    def prefix(self, words: list[bytes]) -> np.ndarray:
        return self.powers.prefix(self.hashes.array(words))

    def prints(self, prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams, and for each window of n words the place of the one that is its fingerprint."""
        k, w = (self.gram, n - self.gram + 1) if n == self.window else (n, 1)
        grams = self.powers.grams(prefix, k)
        return grams, winnow(grams, w)


def benchmark_windows(benchmark: DataFrame, item_id: str, item_text: str, window: int, gram: int) -> DataFrame:
    """n, print, window, words, item: the windows of each item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Windows(window, gram)
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                if not words:
                    continue
                n = min(window, len(words))
                prefix = make.prefix(words)
                grams, kept = make.prints(prefix, n)
                prints, hashes = signed(grams[kept]), signed(make.powers.grams(prefix, n))
                for a in range(0, len(hashes), BATCH):
                    part = hashes[a : a + BATCH]
                    texts = [b" ".join(words[p : p + n]) for p in range(a, a + len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n, np.int32)), pa.array(prints[a : a + BATCH]), pa.array(part), pa.array(texts, pa.binary()), pa.array([item] * len(part), pa.string())], names=["n", "print", "window", "words", "item"])

    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).mapInArrow(run, WINDOWS).distinct()


def _candidates(make: Windows, lengths: list[int], sets: tuple[np.ndarray, np.ndarray], bits: int, docs: list[list[bytes]]) -> list[list[dict]]:
    """For each document its windows whose fingerprints and hashes are in the sets, with their places."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = [w for d in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), sizes)
    prefix = make.prefix(words)
    out: list[list[dict]] = [[] for _ in docs]
    for n in lengths:
        if len(words) < n:
            continue
        grams, kept = make.prints(prefix, n)
        place = np.arange(len(kept))
        whole = owner[place] == owner[place + n - 1]
        at = np.unique(kept[whole])
        known = np.zeros(len(grams), bool)
        known[at[inside(sets[0], signed(grams[at]), bits)]] = True
        near = place[whole & known[kept]]
        hashes = make.powers.spans(prefix, near, near + n)
        both = inside(sets[1], signed(hashes), bits)
        near, hashes = near[both], signed(hashes[both])
        seen: dict[tuple[int, bytes], dict] = {}
        for p, doc, h, g in zip(near.tolist(), owner[near].tolist(), hashes.tolist(), signed(grams[kept[near]]).tolist(), strict=True):
            text = b" ".join(words[p : p + n])
            if (doc, text) not in seen:
                seen[doc, text] = {"n": n, "print": g, "window": h, "words": text, "places": []}
                out[doc].append(seen[doc, text])
            seen[doc, text]["places"].append(p - int(starts[doc]))
    return out


def scan(documents: DataFrame, text: str, found: str, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """documents with n_words and found, their windows that may be the benchmark's."""
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())
    bits, sets = LEAST_BITS, None
    if lengths:
        bits = min(MOST_BITS, max(LEAST_BITS, windows.count().bit_length() + 4))
        sets = documents.sparkSession.sparkContext.broadcast(tuple(np.packbits(fixed_set(windows, c, bits)) for c in ("print", "window")))
    names = [*documents.columns, "n_words", found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Windows(window, gram)
        for batch in batches:
            sizes, rows = [], []
            for _, part in word_chunks(batch.column(text).to_pylist(), alnum_words):
                sizes += [len(d) for d in part]
                rows += _candidates(make, lengths, sets.value, bits, part) if lengths else [[]] * len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(rows, FOUND)], names=names)

    kind = "array<struct<n: int, print: bigint, window: bigint, words: binary, places: array<int>>>"
    schema = documents.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(kind).alias(found)).schema
    return documents.mapInArrow(run, schema)


def _covered(rows: DataFrame) -> DataFrame:
    """k1, k2, hit_words, hit_items of rows (k1, k2, n_words, spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for size, spans in zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                edge = np.zeros(size + 1, np.int64)
                for span in spans:
                    at = np.array(span["places"], np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + span["n"], -1)
                masks.append(np.packbits(np.cumsum(edge[:-1]) > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(masks, pa.binary()), batch.column("items")], names=["k1", "k2", "hit_words", "hit_items"])

    return rows.mapInArrow(run, "k1 long, k2 long, hit_words binary, hit_items array<string>")


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, hit_words (packed bits, one a word, null if none) and hit_items (item ids as strings, sorted) to documents, or to their columns keep alone."""
    scratch = Scratch(documents.sparkSession, "benchmark")
    made = ("n_words", "hit_words", "hit_items")
    plain = [c for c in documents.columns if c not in made]
    found = "found"
    while found in documents.columns:
        found += "_"
    wanted = plain if keep is None else [c for c in keep if c in plain]
    windows = scratch.save(benchmark_windows(benchmark, item_id, item_text, window, gram), "windows")
    scanned = scan(documents.select(*plain), text, found, windows, window, gram)
    scanned = scratch.save(scanned.select(*wanted, "n_words", found), "scanned")

    # what is hit depends on the windows found and the number of words alone
    keys = [F.xxhash64("n_words", found).alias("k1"), F.xxhash64(F.lit(7), "n_words", found).alias("k2")]
    some = scanned.where(F.size(found) > 0)
    kinds = some.select(*keys, "n_words", F.col(found).alias("found")).dropDuplicates(["k1", "k2"])
    hits = kinds.select("k1", "k2", "n_words", F.inline("found")).join(windows, ["n", "print", "window", "words"])
    united = hits.groupBy("k1", "k2").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("n", "places")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    results = scratch.save(_covered(united), "results")

    n, size = results.agg(F.count(F.lit(1)), F.sum(F.length("hit_words") + F.length(F.array_join("hit_items", " ")))).first()
    columns = [*[F.col(f"`{c}`") for c in wanted], F.col("n_words"), F.col("hit_words"), F.coalesce("hit_items", F.expr("cast(array() as array<string>)")).alias("hit_items")]
    taken = [F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(wanted)]
    back = [F.col(f"d{i}").alias(c) for i, c in enumerate(wanted)]
    if n <= broadcast_rows and (size or 0) <= BROADCAST_BYTES:
        joined = scanned.select(*taken, "n_words", *keys).join(F.broadcast(results), ["k1", "k2"], "left")
        return joined.select(*back, *columns[len(wanted) :])
    salted = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dirty = some.select(*taken, "n_words", *keys, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).join(salted, ["k1", "k2", "salt"], "left").select(*back, *columns[len(wanted) :])
    clean = scanned.where(F.size(found) == 0).select(*columns[: len(wanted) + 1], F.lit(None).cast("binary").alias("hit_words"), F.expr("cast(array() as array<string>)").alias("hit_items"))
    return dirty.unionByName(clean)


def n_hit(hit_words: Column | str = "hit_words") -> Column:
    """Number of bits that are set."""
    digits = F.coalesce(F.hex(hit_words), F.lit(""))
    return sum(((F.length(digits) - F.length(F.regexp_replace(digits, f"[{having}]", ""))) * bits for bits, having in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F"))), F.lit(0)).cast("long")


def report(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(documents.select(doc_id, "text"), benchmark, keep=[doc_id], **options)
    return found.select(
        doc_id,
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
    )


def brute_force(documents: list[tuple[int, str | None]], benchmark: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The rows of report(), by comparing every window with every place."""
    out = []
    for doc, text in documents:
        words = alnum_words(text)
        hit, items = set(), set()
        for item, body in benchmark:
            own = alnum_words(body)
            n = min(window, len(own))
            if not n:
                continue
            wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in wanted:
                    hit.update(range(p, p + n))
                    items.update([] if item is None else [str(item)])
        out.append((doc, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
