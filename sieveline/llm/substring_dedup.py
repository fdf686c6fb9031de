"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``window`` consecutive words of one document. It is removed if the same words start in an earlier
document: one of the index's history, or one of the batch with a smaller id.

Windows are not stored one by one. Winnowing gives each its anchor, the ``gram``-word run with the least hash
in it, so equal windows have equal anchors at equal places. Consecutive windows with the same anchor form a
segment, which is stored as (anchor, two independent hashes of its words, first owner and place there). The index is
log-structured: every batch adds one immutable run, sorted by those columns; a batch's segments are merge-joined
with the runs, and runs are compacted to one when there are more than ``most_runs``.

A segment known from an earlier owner is covered whole. Where an anchor has different segments (the ends of a
shared passage, or a mere common phrase), the texts of their first owners are joined to them and the single windows
are compared by 128 bits of independent hashes, the verification. Both steps group by content, so no pairs are
formed, and groups of any size are pre-aggregated before they are shuffled. Sets that grow with what they hold spare
shuffles of rows that join nothing; which segments' windows are compared is settled by joins, so that a full set
makes no windows.

Null texts have no words. Null ids count as larger than all others and don't precede each other. Repeated
rows don't precede each other, as their ids are equal; rows with one id and different texts are kept apart.
Documents of fewer words than a window keep all. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import BASE_2, SPACES, ByteWords, Powers, Scratch, mix, signed, space_words, text_chunks, winnow

WINDOW, GRAM, MOST_RUNS, BATCHES = 50, 8, 2, 3
#: No set that workers hold is larger: 16 MB.
SET_BITS = 27
LAST = (1 << 63) - 1


class Segments:
    """Windows, anchors and segments of a run of documents."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        # two hashes of the words themselves, so that what one confuses the other tells apart
        self.words, self.one, self.two = ByteWords(SPACES, seconds=True), Powers(), Powers(BASE_2)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """owner, p, n (windows), anchor, s1, s2 of the segments; sizes and chars of the texts' words."""
        (x, y), begin, end, sizes = self.words.of(data, offsets)
        starts = np.cumsum(sizes) - sizes
        one, two = self.one.prefix(x), self.two.prefix(y)
        chars = np.concatenate([[0], np.cumsum(end - begin)])
        whole = {"sizes": sizes, "chars": chars[starts + sizes] - chars[starts]}
        kept = winnow(self.one.grams(one, self.gram), self.window - self.gram + 1)
        place = np.arange(len(kept))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inner = owner[place] == owner[place + self.window - 1] if len(kept) else np.zeros(0, bool)
        place, kept = place[inner], kept[inner]
        if not len(place):
            none = np.zeros(0, np.int64)
            return {"owner": none, "p": none, "n": none, "anchor": none.view(np.uint64), "s1": none.view(np.uint64), "s2": none.view(np.uint64), **whole}
        first = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (owner[place[1:]] != owner[place[:-1]])]))
        n = np.diff(np.concatenate([first, [len(place)]]))
        start, at = place[first], kept[first]
        end = start + n - 1 + self.window
        inside_ = (at - start).astype(np.uint64)
        whose = owner[start]
        return {"owner": whose, "p": start - starts[whose], "n": n, "anchor": self.one.spans(one, at, at + self.gram), "s1": mix(self.one.spans(one, start, end) + inside_), "s2": mix(self.two.spans(two, start, end) ^ inside_), **whole}


def _digest(data: np.ndarray, chars: int, words: int) -> str:
    """sha256 of a text's words joined by blanks."""
    raw = data.tobytes().translate(SPACES)
    # as long as its words and one blank between each: that is the text itself
    return hashlib.sha256(raw if len(raw) == chars + max(words - 1, 0) else b" ".join(raw.split())).hexdigest()


def _bit(x: np.ndarray, bits: int) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def inside(packed: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Which of x are in a set of fixed size, as fixed_set() gives it, packed."""
    at = _bit(x, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def fixed_set(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of fixed size of 64-bit values, by their upper bits: 2**bits bits, whatever the number of values."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = values.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def set_bits(n: int) -> int:
    """The size of a set of n values: 16 to 32 bits for each value, up to 2**SET_BITS bits."""
    return min(max(16, (16 * n).bit_length()), SET_BITS)


def within(held: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a set that sized_set() gives."""
    at = x.view(np.uint64) >> np.uint64(64 - (64 * len(held)).bit_length() + 1)
    return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sized_set(values: DataFrame, column: str) -> np.ndarray:
    """A set of 64-bit values by their upper bits, as words of 64 bits. It grows with the number of values up to a bound;
    beyond, more values than those given are in it, so what it lets through is joined exactly."""
    bits = set_bits(values.count())
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = values.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy()
    return out.view(np.uint64)


def among_set(rows: DataFrame, column: str, held: np.ndarray) -> DataFrame:
    """Rows whose value of a column is in a set; the others are dropped where they are read."""
    shared = rows.sparkSession.sparkContext.broadcast(held)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(within(shared.value, part.column(at).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


class WindowIndex:
    """The log of runs in a folder, and what a batch has in common with it."""

    KEY = ["anchor", "s1", "s2"]
    #: A segment's first owner: id, hash of its text, first window and number of windows.
    FIRST = ["doc", "t", "p", "n"]
    RUN = "anchor long, s1 long, s2 long, doc long, t long, p int, n int, owners long, old_doc long"

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, most_runs: int = MOST_RUNS):
        self.spark, self.window, self.gram, self.most_runs = spark, window, gram, most_runs
        self.scratch = Scratch(spark, "windows")
        self.runs: list[str] = []
        self.made = 0

    def history(self) -> DataFrame:
        """anchor, s1, s2, doc, t, p, n of the segments of all runs, each once."""
        rows = self.spark.read.schema(self.RUN).parquet(*[f"{self.scratch.path}/{r}" for r in self.runs]) if self.runs else self.spark.createDataFrame([], self.RUN)
        return rows.where("old_doc is null").select(*self.KEY, *self.FIRST)  # the others are in an older run

    def _write(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        self.runs.append(f"run-{self.made}")
        return self.scratch.save(rows.select(*self.KEY, *self.FIRST, "owners", "old_doc").sortWithinPartitions(*self.KEY), self.runs[-1])

    def compact(self) -> None:
        """Merges all runs into one; the first owner of each segment stays."""
        old = list(self.runs)
        merged = self.history().withColumns({"owners": F.lit(1).cast("long"), "old_doc": F.lit(None).cast("long")}).repartition(*self.KEY)
        self.runs = []
        self._write(merged)
        for name in old:
            self.scratch.drop(name)

    def scan(self, batch: DataFrame, name: str) -> DataFrame:
        """Per document: doc, t (hash of the text), n_words, words_sha256, segments."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Segments(window, gram)
            fields = [("p", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
            for rows in batches:
                for first, data, at in text_chunks(rows.column(2)):
                    found, n = make.of(data, at), len(at) - 1
                    offsets = np.searchsorted(found["owner"], np.arange(n + 1))
                    columns = [pa.array(signed(found[k]) if found[k].dtype == np.uint64 else found[k]).cast(kind) for k, kind in fields]
                    segments = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields]))
                    digests = [_digest(data[a:b], c, w) for a, b, c, w in zip(at[:-1].tolist(), at[1:].tolist(), found["chars"].tolist(), found["sizes"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0)[first : first + n], rows.column(1)[first : first + n], pa.array(found["sizes"], pa.int64()), pa.array(digests, pa.string()), segments], names=["doc", "t", "n_words", "words_sha256", "segments"])

        schema = "doc long, t long, n_words long, words_sha256 string, segments array<struct<p int, n int, anchor long, s1 long, s2 long>>"
        return self.scratch.save(batch.select("doc", "t", "text").mapInArrow(run, schema), name)

    def windows(self, corpus: DataFrame, chosen: DataFrame) -> DataFrame:
        """w1, w2, doc, t, p, new of the windows of chosen segments (doc, t, p, n, new). Only the texts that hold them are shuffled."""
        lists = chosen.groupBy("doc", "t").agg(F.collect_list(F.struct("p", "n", "new")).alias("chosen"))
        held = sized_set(chosen.select("doc", "t").distinct().select(F.xxhash64("doc", "t").alias("h")), "h")
        texts = among_set(corpus.select("doc", "t", "text", F.xxhash64("doc", "t").alias("h")), "h", held)
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, one, two = ByteWords(SPACES, seconds=True), Powers(), Powers(BASE_2)
            for rows in batches:
                lists = rows.column("chosen")
                sizes, each = lists.value_lengths().to_numpy(), lists.flatten()
                begin = np.concatenate([[0], np.cumsum(sizes)])
                first_p, n, new = (each.field(k).to_numpy(zero_copy_only=False) for k in ("p", "n", "new"))
                for first, data, at in text_chunks(rows.column("text")):
                    (x, y), _, _, counts = words.of(data, at)
                    starts = np.cumsum(counts) - counts
                    low, high = begin[first], begin[first + len(counts)]
                    whose = np.repeat(np.arange(len(counts)), sizes[first : first + len(counts)])
                    many = n[low:high].astype(np.int64)
                    owner, p = np.repeat(whose, many), np.repeat(first_p[low:high].astype(np.int64), many)
                    p += np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
                    start = starts[owner] + p
                    w1, w2 = one.spans(one.prefix(x), start, start + window), two.spans(two.prefix(y), start, start + window)
                    of = pa.array(first + owner)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), rows.column("doc").take(of), rows.column("t").take(of), pa.array(p, pa.int32()), pa.array(np.repeat(new[low:high], many), pa.bool_())], names=["w1", "w2", "doc", "t", "p", "new"])

        return texts.drop("h").join(lists, ["doc", "t"]).mapInArrow(run, "w1 long, w2 long, doc long, t long, p int, new boolean")

    def among(self, scanned: DataFrame, wanted: np.ndarray) -> DataFrame:
        """Segments (doc, t, p, n, anchor, s1, s2) of the scanned documents whose s1 is in the set."""
        held = self.spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                lists = rows.column("segments")
                flat, row = lists.flatten(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
                at = np.flatnonzero(within(held.value, flat.field("s1").to_numpy()))
                take, of = pa.array(at), pa.array(row[at])
                yield pa.RecordBatch.from_arrays([rows.column("doc").take(of), rows.column("t").take(of), *(flat.field(k).take(take) for k in ("p", "n", "anchor", "s1", "s2"))], names=["doc", "t", "p", "n", "anchor", "s1", "s2"])

        return scanned.select("doc", "t", "segments").where(F.size("segments") > 0).mapInArrow(run, "doc long, t long, p int, n int, anchor long, s1 long, s2 long")

    def add(self, batch: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Takes in a batch (doc, t, text). corpus: the batch and all earlier ones, as verification reads their texts again.

        Returns the scanned documents, and spans of covered windows: doc, t, p (first window), n (windows).
        """
        k = self.made + 1
        scanned = self.scan(batch, f"scan-{k}")
        rows = scanned.where(F.size("segments") > 0).select("doc", "t", F.explode("segments").alias("x")).select("doc", "t", *[f"x.{c}" for c in ("p", "n", *self.KEY)])
        # of one owner, as the same rows come in the same order to each
        own = rows.groupBy(*self.KEY).agg(F.min("doc").alias("doc"), *[F.min_by(c, "doc").alias(c) for c in self.FIRST[1:]], F.count(F.lit(1)).alias("owners"))
        old = self.history()
        later = bool(self.runs)
        # the merge join; its result is the batch's run
        known = self._write(own.join(old.select(*self.KEY, F.col("doc").alias("old_doc")), self.KEY, "left") if later else own.withColumn("old_doc", F.lit(None).cast("long")))
        fresh = known.where("old_doc is null")
        # anchors with different segments, one of them new
        held = fresh.select("anchor", F.lit(1).alias("fresh"))
        if later:
            held = held.unionByName(old.select("anchor", F.lit(0).alias("fresh")))
        mixed = self.scratch.save(held.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("fresh")).where("n > 1 and fresh > 0").select("anchor"), f"anchors-{k}")
        self.scratch.release()
        anchors = sized_set(mixed, "anchor")
        chosen = among_set(fresh.select(*self.KEY, *self.FIRST), "anchor", anchors).withColumn("new", F.lit(True))
        if later:
            chosen = chosen.unionByName(among_set(old, "anchor", anchors).withColumn("new", F.lit(False)))
        chosen = self.scratch.save(chosen.join(mixed, "anchor", "left_semi"), f"chosen-{k}")
        # of the batch's segments, those covered whole, and all those of a first owner's id whose windows are compared
        whole = known.where("old_doc is not null or owners > 1").select(*self.KEY, F.least("doc", "old_doc").alias("first"), F.lit(False).alias("new"))
        targets = whole.unionByName(chosen.where("new").select(*self.KEY, F.col("doc").alias("first"), "new"))
        found = self.among(scanned, sized_set(targets.select("s1"), "s1")).join(targets, self.KEY).where("if(new, first = doc, first < doc)")
        found = self.scratch.save(found.select(*self.FIRST, "new"), f"found-{k}")
        self.scratch.release()
        both = found.where("new").unionByName(chosen.where("not new").select(*self.FIRST, "new"))
        w = self.scratch.save(self.windows(corpus, both), f"windows-{k}")
        self.scratch.release()
        twice = w.groupBy("w1").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).where("n > 1 and new").select("w1")
        twice = self.scratch.save(twice, f"twice-{k}")
        self.scratch.release()
        again = among_set(w, "w1", sized_set(twice, "w1"))
        least = again.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
        # the history was judged when it came
        single = again.where("new").join(least, ["w1", "w2"]).where("first < doc").select("doc", "t", "p", F.lit(1).alias("n"))
        spans = self.scratch.save(found.where("not new").select(*self.FIRST).unionByName(single), f"spans-{k}")
        docs = self.scratch.save(scanned.drop("segments"), f"docs-{k}")
        for name in ("scan", "anchors", "chosen", "found", "windows", "twice"):
            self.scratch.drop(f"{name}-{k}")
        del rows, own, known, fresh, held, mixed, chosen, whole, targets, found, both, twice, w, again, least, single, scanned, old
        self.scratch.release()
        if len(self.runs) > self.most_runs:
            self.compact()
        return docs, spans


def cover(n_words: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Mask of the words that covered windows hold."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 0] + at[:, 1] - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def find_spans(documents: DataFrame, window: int = WINDOW, batches: int = BATCHES, gram: int = GRAM, most_runs: int = MOST_RUNS) -> tuple[DataFrame, DataFrame, Scratch]:
    """Takes documents (doc, t, text) in by batches of ascending ids: the scanned documents, and spans by document (doc, t, spans)."""
    cuts = sorted(set(documents.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    index = WindowIndex(documents.sparkSession, window, gram, most_runs)
    scanned = spans = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        corpus = documents if high is None else documents.where(F.col("doc") <= high)
        batch = corpus if low is None else corpus.where(F.col("doc") > low)
        part, found = index.add(batch, corpus)
        scanned, spans = (part, found) if scanned is None else (scanned.unionByName(part), spans.unionByName(found))
    by_doc = index.scratch.save(spans.groupBy("doc", "t").agg(F.collect_set(F.struct("p", "n")).alias("spans")), "spans")
    return scanned, by_doc, index.scratch


def _apply(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """doc, t, n_removed, kept_sha256, kept_text of rows (doc, t, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            removed, digests, texts = [], [], []
            for body, at in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = space_words(body)
                mask = cover(len(words), [(x["p"], x["n"]) for x in at or []], window)
                kept = b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone])
                removed.append(int(mask.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("t"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc", "t", "n_removed", "kept_sha256", "kept_text"])

    return rows.select("doc", "t", "text", "spans").mapInArrow(run, "doc long, t long, n_removed long, kept_sha256 string, kept_text string")


def _documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, t, text; t, a hash of the text, tells rows with one id apart."""
    return documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def _id(doc_id: str):
    return F.when(F.col("doc") != LAST, F.col("doc")).alias(doc_id)


def kept_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per document: doc_id, n_removed, kept_text (words joined by blanks)."""
    docs = _documents(documents, doc_id, text)
    _, by_doc, _ = find_spans(docs, window, **options)
    return _apply(docs.join(by_doc, ["doc", "t"], "left"), window, True).select(_id(doc_id), "n_removed", "kept_text")


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256. Only texts that lose words are shuffled."""
    docs = _documents(documents, doc_id, text)
    scanned, by_doc, _ = find_spans(docs, window, **options)
    h = F.xxhash64("doc", "t").alias("h")
    touched = among_set(docs.select("doc", "t", "text", h), "h", sized_set(by_doc.select(h), "h"))
    edited = _apply(touched.drop("h").join(by_doc, ["doc", "t"]), window, False).drop("kept_text").dropDuplicates(["doc", "t"])
    joined = scanned.join(edited, ["doc", "t"], "left")
    return joined.select(_id(doc_id), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"))


def brute_force(documents: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The rows of report(), with every window in one table."""
    least: dict[tuple, int] = {}
    split = [(LAST if i is None else i, space_words(x)) for i, x in documents]
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            least[key] = min(i, least.get(key, LAST))
    out = []
    for i, words in split:
        spans = [(p, 1) for p in range(len(words) - window + 1) if least[tuple(words[p : p + window])] < i]
        mask = cover(len(words), spans, window)
        kept = b" ".join(w for w, gone in zip(words, mask, strict=True) if not gone)
        out.append((None if i == LAST else i, len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest()))
    return out
