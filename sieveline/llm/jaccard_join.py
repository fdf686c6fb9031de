"""N-gram Jaccard similarity join by vertical partitioning.

Each document is the set of its ``n``-word shingles, by 64-bit hashes. Two documents link when
100 * |A & B| >= percent * |A | B|; the join gives each document its number of shingles, its component, its class and
its number of links, and misses no link, up to collisions of the hashes.

1. The global order of shingles is that of their hashes. It is cut into even fragments. Linked sets of at most T
   shingles differ in at most d = 2 T (100 - percent) / (100 + percent) of them, so of d + s fragments at least s
   hold the same shingles in both. Sizes are dealt into levels by T; a set shows, for the levels that a partner of
   its size may have, the hash of each fragment, its keys.
2. Keys shared by different sets are counted in one aggregation. A set that shares fewer keys than it must goes;
   the others drop their most frequent keys, as many as they can and still meet each linked set in one of the rest.
   Passages that many documents share thus bring no documents together, and unrelated ones don't meet by chance,
   as a key stands for several shingles.
3. Documents with equal sets (128 bits) are one class. Classes that share a key are paired with a leader of its list,
   where their components differ, in two rounds; then all remaining pairs of different components are looked at.
   Parity bitmaps reject pairs that differ in too many shingles, in the join itself. A group of near copies thus takes about as many pairs as it has members.
4. For each pair and fragment the overlap is counted by itself, on rows that hold one fragment of a set, and the
   counts are summed per pair.
5. Components are found by passing on the least label along links, with pointer jumps, until nothing changes.
6. Links are counted last. All of them lie within components, so the classes of a component are dealt into blocks,
   and every two blocks of it are compared by a product of their matrices of shared shingles. Only counts leave a
   block; the pairs of a group of k near copies are all judged, and never become rows.

Null texts and texts without words have an empty set and link with nothing. Fewer words than ``n`` are one
shingle. Null ids are never the smallest of a component unless all are null; repeated rows are linked by their
equal sets. Empty tables give no rows. Further columns are not read.

Sets of fixed size (bits) only spare work; where they are full, more rows are shuffled and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import LOWER_SPACES, ByteWords, Powers, Scratch, cut, lower_space_words, mix, signed, text_chunks
from sieveline.llm.substring_dedup import fixed_set, inside

N, PERCENT, FRAGMENTS = 3, 90, 6
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 8
KEY_BITS, DOC_BITS = 25, 22
#: Sizes of neighbouring levels, as a factor, and the least of them.
STEP, FIRST_TOP = 1.7, 8
#: Rounds of leaders before all remaining pairs of different components are looked at.
STAR_ROUNDS = 2
#: Partitions of tables that are small enough to be broadcast.
SMALL_PARTITIONS = 8
#: Labels of so many classes (some 5 MB) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000
#: Classes and shingles of a block, about, and the shared shingles that one product of matrices takes.
BLOCK_CLASSES, BLOCK_TOKENS, BLOCK_WIDTH = 512, 1_000_000, 4096
NODE = ["nid", "nid2"]
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


class Shingles:
    def __init__(self, n: int):
        self.n, self.words, self.powers = n, ByteWords(LOWER_SPACES), Powers()

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, hash) of the distinct shingles of a run of texts, sorted by both."""
        (words,), _, _, sizes = self.words.of(data, offsets)
        starts = np.cumsum(sizes) - sizes
        prefix = self.powers.prefix(words)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        grams = self.powers.grams(prefix, self.n)
        whole = owner[: len(grams)] == owner[self.n - 1 :] if len(grams) else np.zeros(0, bool)
        short = np.flatnonzero((sizes > 0) & (sizes < self.n))
        h = np.concatenate([grams[whole], self.powers.spans(prefix, starts[short], starts[short] + sizes[short])])
        who = np.concatenate([owner[: len(grams)][whole], short])
        if len(short):
            order = np.argsort(who, kind="stable")
            h, who = h[order], who[order]
        ends = np.cumsum(np.bincount(who, minlength=len(sizes))).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            h[a:b].sort()
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        return who[first], h[first]


class Levels:
    """Levels of sizes; for each the fragments that the order is cut into."""

    def __init__(self, percent: int):
        self.percent, tops = percent, [FIRST_TOP]
        while tops[-1] < 1 << 40:
            tops.append(int(tops[-1] * STEP))
        self.tops = np.array(tops, np.int64)
        self.differ = 2 * self.tops * (100 - percent) // (100 + percent)
        #: two fragments at least are the same in linked sets, and more in larger ones
        self.fragments = np.where(self.differ > 0, self.differ + 2 + self.differ // 8, 0)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last level of the larger one of a set of this size and a partner."""
        return np.searchsorted(self.tops, sizes), np.searchsorted(self.tops, sizes * 100 // self.percent)

    def least(self, sizes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """How many keys of a level a set of this size has in common with any that it links with, at least."""
        most = np.minimum(sizes * 100 // self.percent, self.tops[level])
        return self.fragments[level] - (sizes + most) * (100 - self.percent) // (100 + self.percent)


def shown(levels: Levels, owner: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the sets of a run: keys, and by set and level the level, the number of keys and how many of them a partner must share; the offsets of the sets in both."""
    low, high = levels.of(sizes)
    high = np.where(sizes > 0, high, low - 1)
    n = high - low + 1
    group_ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(sizes)), n)
    level = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(group_ends - n, n)
    k, least = levels.fragments[level], levels.least(sizes[doc], level)
    ends = np.cumsum(k)
    keys = np.zeros(int(k.sum()), np.uint64)
    weighed = mix(h ^ np.uint64(0x6A09E667F3BCC909))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for j in range(int(n.max(initial=0))):
        group = np.flatnonzero((np.arange(len(doc)) - (group_ends - n)[doc] == j) & (k > 0))
        if not len(group):
            continue
        mine = doc[group]
        # the shingles of the sets that have a j-th level
        size = sizes[mine]
        at = np.repeat(bounds[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        many = np.repeat(k[group], size)
        base = np.cumsum(k[group]) - k[group]
        slot = np.repeat(base, size) + (((h[at] >> np.uint64(32)) * many.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(slot, minlength=int(k[group].sum()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(weighed[at])])
        to = np.cumsum(held)
        place = np.arange(len(held)) - np.repeat(base, k[group])
        salt = mix((place.astype(np.uint64) << np.uint64(8)) + np.repeat(level[group], k[group]).astype(np.uint64))
        keys[np.repeat((ends - k)[group], k[group]) + place] = mix((total[to] - total[to - held]) + held.astype(np.uint64) * np.uint64(0xBB67AE8584CAA73B) ^ salt)
    doc_ends = np.concatenate([[0], ends])[np.concatenate([[0], group_ends])]
    return keys, level, k, least, doc_ends, np.concatenate([[0], group_ends])


def _nodes(owner: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(seed)))]) for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
    one, two = (mix(t[bounds[1:]] - t[bounds[:-1]]) for t in totals)
    return signed(one), signed(two)


def _parity(owner: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Per set the parities of its hashes' slots; two differ in no more bits than the sets in elements."""
    slots = 64 * PARITY_WORDS
    odd = np.bincount(owner * slots + (h % np.uint64(slots)).astype(np.int64), minlength=n_docs * slots) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(n_docs, PARITY_WORDS)


def scan(documents: DataFrame, n: int, percent: int, doc: str, text: str) -> DataFrame:
    """Per document: doc, size, nid and nid2 (hashes of its set), parity words, keys; by level, its number, that of its keys, and how many of them a partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, levels = Shingles(n), Levels(percent)
        for rows in batches:
            for first, data, offsets in text_chunks(rows.column(1)):
                owner, h = make.of(data, offsets)
                n_docs = len(offsets) - 1
                sizes = np.bincount(owner, minlength=n_docs)
                one, two = _nodes(owner, h, n_docs)
                parity = _parity(owner, h, n_docs)
                keys, level, k, least, key_ends, level_ends = shown(levels, owner, h, sizes)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for at, x in ((key_ends, signed(keys)), (level_ends, level), (level_ends, k), (level_ends, least))]
                yield pa.RecordBatch.from_arrays([rows.column(0)[first : first + n_docs], pa.array(sizes, pa.int64()), pa.array(one), pa.array(two), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY_WORDS)), *lists], names=["doc", "size", *NODE, *PARITY, "keys", "level", "many", "least"])

    schema = "doc long, size long, nid long, nid2 long, " + ", ".join(f"{p} long" for p in PARITY) + ", keys array<long>, level array<long>, many array<long>, least array<long>"
    return documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def fragment_rows(documents: DataFrame, fragments: int, n: int) -> DataFrame:
    """doc, nid, nid2, fragment, tokens of documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(n)
        for rows in batches:
            for begin, data, offsets in text_chunks(rows.column(1)):
                owner, h = make.of(data, offsets)
                one, two = _nodes(owner, h, len(offsets) - 1)
                key = owner * fragments + (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                whose = key[first] // fragments
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(key)]]), pa.int32()), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(begin + whose)), pa.array(one[whose]), pa.array(two[whose]), pa.array(key[first] % fragments, pa.int32()), tokens], names=["doc", *NODE, "fragment", "tokens"])

    return documents.mapInArrow(run, "doc long, nid long, nid2 long, fragment int, tokens array<long>")


def overlaps(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, a2, b, b2, common: overlaps counted fragment by fragment, and summed. A missing row is a fragment without shingles."""
    left = rows.select(F.col("nid").alias("a"), F.col("nid2").alias("a2"), "fragment", F.col("tokens").alias("own"))
    right = rows.select(F.col("nid").alias("b"), F.col("nid2").alias("b2"), "fragment", F.col("tokens").alias("other"))
    key = ["a", "a2", "b", "b2"]
    counted = pairs.select(*key).join(left, ["a", "a2"]).join(right, ["b", "b2", "fragment"]).select(*key, "fragment", F.size(F.array_intersect("own", "other")).cast("long").alias("n"))
    # repeated rows of a document have rows of their own, with equal counts
    partial = counted.groupBy(*key).agg(F.collect_set(F.struct("fragment", "n")).alias("parts"))
    return partial.select(*key, F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("common"))


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """node, label of the nodes of links (a, b), and how many they are; label: the least node of the component."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    n = labels.count()
    few = n <= BROADCAST_LABELS
    held = F.broadcast if few else (lambda x: x)
    while True:  # the least label of a component is passed on each round, so it ends
        near = both.join(held(labels.withColumnRenamed("node", "a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = near.join(held(labels), "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = lower.join(held(jump), "new", "left").select("node", "label", F.least("new", "far").alias("new"))
        moved = cut(moved.coalesce(SMALL_PARTITIONS) if few else moved)
        changed = not moved.where("new <> label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels, n


def linked(owner: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of left (rows) and right (columns) link; owner and tokens: the elements of all sets."""
    _, slot, n = np.unique(tokens, return_inverse=True, return_counts=True)
    # what one set alone has adds to no overlap
    often = n > 1
    keep = often[slot]
    slot, owner = (np.cumsum(often) - 1)[slot[keep]], owner[keep]
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(often.sum()), BLOCK_WIDTH):
        a, b = np.searchsorted(slot, (low, low + BLOCK_WIDTH))
        has = np.zeros((len(sizes), BLOCK_WIDTH), np.float32)
        has[owner[a:b], slot[a:b] - low] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    return common * 100 >= (sizes[left][:, None] + sizes[right][None, :] - common) * percent


def block_links(percent: int):
    """For rows (i, j, block, nid, nid2, copies, tokens) of blocks i and j of a component: nid, nid2, n, the documents of classes of the other block, or of the same where i = j, that a class links with."""

    def run(rows: pa.Table) -> pa.Table:
        # repeated rows of a document have rows of their own
        nodes = np.stack([rows.column(c).to_numpy() for c in NODE], axis=1)
        rows = rows.take(pa.array(np.sort(np.unique(nodes, axis=0, return_index=True)[1]))).combine_chunks()
        block, copies = rows.column("block").to_numpy(), rows.column("copies").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        lists = pa.concat_arrays(rows.column("tokens").chunks)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = linked(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), sizes, left, right, percent)
        if i == j:
            np.fill_diagonal(links, False)
        count = np.zeros(len(sizes), np.int64)
        count[left] += links @ copies[right]
        if i != j:
            count[right] += links.T @ copies[left]
        return pa.table({"nid": rows.column("nid"), "nid2": rows.column("nid2"), "n": pa.array(count)})

    return run


class Join:
    """The steps of one join; scratch tables are in the shared folder."""

    def __init__(self, documents: DataFrame, n: int, percent: int, fragments: int, doc_id: str, text: str):
        self.spark, self.documents, self.n, self.percent, self.fragments, self.doc_id, self.text = documents.sparkSession, documents, n, percent, fragments, doc_id, text
        self.scratch = Scratch(self.spark, "jaccard")
        self.saves = self.n_labels = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.saves += 1
        return self.scratch.save(df, f"table-{self.saves}")

    def drop_from(self, first: int, last: int) -> None:
        """Deletes the tables with these numbers; nothing lazy may read them any more."""
        for i in range(first, last + 1):
            self.scratch.drop(f"table-{i}")

    def able(self) -> F.Column:
        """Of a pair of classes, left with plain names and right with names in other_: whether sizes and parities allow a link."""
        fits = F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * self.percent
        differing = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in PARITY), F.lit(0))
        return fits & (differing * (100 + self.percent) <= (F.col("size") + F.col("other_size")) * (100 - self.percent))

    def chosen(self, owners: DataFrame, n: int) -> DataFrame:
        """doc, text of the documents with the ids of owners (doc), n at most; some others, too, where they are many."""
        given = F.col(self.doc_id).cast("long")
        docs = self.documents.select(given.alias("doc"), F.col(self.text).alias("text"), F.xxhash64(given).alias("h"))
        keys = owners.select(F.xxhash64("doc").alias("h"))
        if n <= BROADCAST_LABELS:
            return docs.join(F.broadcast(keys.distinct()), "h", "left_semi").select("doc", "text")
        held = self.spark.sparkContext.broadcast(np.packbits(fixed_set(keys, "h", DOC_BITS)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield rows.filter(pa.array(inside(held.value, rows.column("h").to_numpy(), DOC_BITS))).select(["doc", "text"])

        return docs.mapInArrow(run, "doc long, text string")

    def links(self, pairs: DataFrame) -> DataFrame:
        """a, a2, b, b2 of the pairs (a, b: nid) that link."""
        first = self.saves + 1
        pairs = self.save(pairs)
        n = 2 * pairs.count()
        held = F.broadcast if n <= BROADCAST_LABELS else (lambda x: x)
        ids = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        mine = self.save(self.classes.drop("copies").join(held(ids), "nid"))
        sides = [held(mine.select(*[F.col(c).alias(name.format(c)) for c in ("doc", "size", *PARITY)], F.col("nid").alias(k), F.col("nid2").alias(k + "2"))) for k, name in (("a", "{}"), ("b", "other_{}"))]
        pairs = self.save(pairs.join(sides[0], "a").join(sides[1], "b").where(self.able()).select("a", "a2", "b", "b2", "size", "other_size", "doc", "other_doc"))
        if pairs.isEmpty():
            self.drop_from(first, self.saves)
            return self.spark.createDataFrame([], "a long, a2 long, b long, b2 long")
        owners = pairs.select(F.col("a").alias("nid"), F.col("a2").alias("nid2"), "doc").unionByName(pairs.select(F.col("b").alias("nid"), F.col("b2").alias("nid2"), F.col("other_doc").alias("doc"))).distinct()
        rows = fragment_rows(self.chosen(owners, n), self.fragments, self.n)
        # one document a class: copies with the same id, and those that the set lets through, go
        rows = self.save(rows.join(held(owners.withColumnRenamed("doc", "own")), NODE).where("doc <=> own").drop("doc", "own"))
        common = overlaps(pairs, rows)
        judged = pairs.join(common, ["a", "a2", "b", "b2"]).where(F.col("common") * 100 >= (F.col("size") + F.col("other_size") - F.col("common")) * self.percent)
        found = self.save(judged.select("a", "a2", "b", "b2"))
        self.drop_from(first, self.saves - 1)
        self.scratch.release()
        return found

    def run(self) -> tuple[DataFrame, DataFrame | None]:
        """doc, size, nid, nid2 of the documents, and nid, nid2, label of the classes that have links."""
        scanned = self.save(scan(self.documents, self.n, self.percent, self.doc_id, self.text))
        full = scanned.where("size > 0")
        self.classes = self.save(full.groupBy(*NODE).agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("size", *PARITY)]))
        first, posts = self.saves + 1, self.posts(full)
        found, labels, r, more = None, None, 0, True
        while True:
            held = self.save(self.labelled(posts, labels))
            lists = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            if lists.isEmpty():
                break
            last = r >= STAR_ROUNDS or not more
            new = self.links(self.rest(held, lists) if last else self.stars(held, r))
            more = not new.isEmpty()
            if more:
                found = new if found is None else found.unionByName(new)
                labels, self.n_labels = components(found)
            if last:
                break
            r += 1
        docs = scanned.select("doc", "size", *NODE)
        if found is None:
            return docs, None
        nodes = found.select(F.col("a").alias("nid"), F.col("a2").alias("nid2")).unionByName(found.select(F.col("b").alias("nid"), F.col("b2").alias("nid2"))).distinct()
        return docs, self.save(nodes.join(self.small(labels.withColumnRenamed("node", "nid")), "nid"))

    def posts(self, full: DataFrame) -> DataFrame:
        """key, nid of the classes that may link, without the keys that they needn't show."""
        shared = self.save(full.select("nid", F.explode("keys").alias("key")).groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n"))
        first = fixed_set(self.classes.select(F.xxhash64(*NODE, "doc").alias("h")), "h", DOC_BITS)
        held = self.spark.sparkContext.broadcast((np.packbits(fixed_set(shared, "key", KEY_BITS)), np.packbits(first)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, own = held.value
            for rows in batches:
                rows = rows.filter(pa.array(inside(own, rows.column("h").to_numpy(), DOC_BITS)))
                keys, level, many, least = (rows.column(c).flatten().to_numpy() for c in ("keys", "level", "many", "least"))
                nid = np.repeat(rows.column("nid").to_numpy(), rows.column("many").value_lengths().to_numpy())
                group = np.repeat(np.arange(len(many)), many)
                kept = inside(wanted, keys, KEY_BITS)
                enough = np.bincount(group[kept], minlength=len(many)) >= least
                kept &= enough[group]
                group = group[kept]
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(nid[group]), pa.array(level[group]), pa.array(least[group])], names=["key", "nid", "level", "least"])

        offered = full.select("nid", F.xxhash64(*NODE, "doc").alias("h"), "keys", "level", "many", "least").mapInArrow(run, "key long, nid long, level long, least long")
        sets = offered.join(shared, "key").groupBy("nid", "level", "least").agg(F.sort_array(F.collect_set(F.struct("n", "key"))).alias("keys"))
        kept = sets.where("size(keys) >= least").select("nid", F.explode(F.expr("slice(keys, 1, cast(size(keys) - least + 1 as int)).key")).alias("key"))
        return self.save(kept.select("key", "nid"))

    def small(self, rows: DataFrame) -> DataFrame:
        """rows, with a row a labelled class at most, broadcast if those are few."""
        return F.broadcast(rows) if self.n_labels <= BROADCAST_LABELS else rows

    def labelled(self, posts: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return posts.withColumn("label", F.col("nid"))
        return posts.join(self.small(labels.withColumnRenamed("node", "nid")), "nid", "left").withColumn("label", F.coalesce("label", "nid"))

    def stars(self, posts: DataFrame, r: int) -> DataFrame:
        """Pairs of a leader of each list with the classes of other components in it. The leader is of the component with most classes there; first one for many lists, then one of each list's own."""
        by = F.xxhash64("nid", F.lit(r)) if r == 0 else F.xxhash64("nid", "key", F.lit(r))
        parts = posts.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("by"), F.min_by("nid", by).alias("a"))
        leaders = parts.groupBy("key").agg(F.max_by(F.struct("a", "label"), F.struct("n", -F.col("by"))).alias("lead"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        return posts.join(leaders.select("key", "lead.a", F.col("lead.label").alias("own")), "key").where("label <> own").select("a", F.col("nid").alias("b")).distinct()

    def rest(self, posts: DataFrame, lists: DataFrame) -> DataFrame:
        """Pairs of classes of different components that share a key."""
        sides = self.classes.select("nid", "size", *PARITY)
        own = posts.join(lists.select("key"), "key").join(sides, "nid")
        other = own.select("key", *[F.col(c).alias(f"other_{c}") for c in ("nid", "label", "size", *PARITY)])
        return own.join(other, "key").where((F.col("nid") < F.col("other_nid")) & (F.col("label") != F.col("other_label")) & self.able()).select(F.col("nid").alias("a"), F.col("other_nid").alias("b")).distinct()

    def counts(self, labels: DataFrame) -> DataFrame:
        """nid, nid2, n: with how many documents of other classes each class of a component links."""
        members = self.save(self.classes.select(*NODE, "doc", "copies", "size").join(self.small(labels), NODE))
        at = self.saves
        blocks = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
        groups = members.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("tokens"), F.sum("copies").alias("all")).select("label", "k", "all", blocks.alias("blocks"))
        members = self.save(members.join(self.small(groups), "label"))
        # two classes are a component by their one link
        two = members.where("k = 2").select(*NODE, (F.col("all") - F.col("copies")).alias("n"))
        more = members.where("k > 2").select(*NODE, "label", F.col("doc").alias("own"), "copies", "blocks", F.expr("cast(pmod(xxhash64(nid, nid2), blocks) as int)").alias("block"))
        rows = fragment_rows(self.chosen(members.where("k > 2").select("doc"), self.n_labels), 1, self.n).select("doc", *NODE, "tokens")
        dealt = rows.join(self.small(more), NODE).where("doc <=> own").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *NODE, "copies", "tokens")
        found = dealt.groupBy("label", "i", "j").applyInArrow(block_links(self.percent), "nid long, nid2 long, n long")
        counted = self.save(found.unionByName(two).groupBy(*NODE).agg(F.sum("n").alias("n")))
        self.drop_from(at, self.saves - 1)
        return counted


def _named(join: Join, labels: DataFrame | None) -> DataFrame:
    """nid, nid2, copies, class (least id of the equal sets), component (least id reachable by links)."""
    classes = join.classes.select(*NODE, F.col("doc").alias("class"), "copies")
    if labels is None:
        return classes.withColumn("component", F.col("class"))
    least = labels.join(classes, NODE).groupBy("label").agg(F.min("class").alias("component"))
    return classes.join(join.small(labels.join(least, "label").select(*NODE, "component")), NODE, "left").withColumn("component", F.coalesce("component", "class"))


def cluster(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    join = Join(documents, n, percent, fragments, doc_id, text)
    docs, labels = join.run()
    by_node = _named(join, labels).select(*NODE, "component")
    return docs.join(by_node, NODE, "left").select(F.col("doc").alias(doc_id), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def cluster_links(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """As cluster(), with class_id (least doc_id with an equal set) and n_links (documents it links with, those of its class too)."""
    join = Join(documents, n, percent, fragments, doc_id, text)
    docs, labels = join.run()
    by_node = _named(join, labels)
    if labels is None:
        by_node = by_node.withColumn("n", F.lit(None).cast("long"))
    else:
        by_node = by_node.join(join.small(join.counts(labels)), NODE, "left")
    links = F.when(F.col("size") > 0, F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0).alias("n_links")
    named = [F.when(F.col("size") > 0, F.col(c)).otherwise(F.col("doc")).alias(f"{c}_id") for c in ("component", "class")]
    return docs.join(by_node, NODE, "left").select(F.col("doc").alias(doc_id), F.col("size").alias("n_shingles"), *named, links)


def brute_force(documents: list[tuple[int, str | None]], n: int = N, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """doc_id, n_shingles, component_id, from all pairs."""
    sets = []
    for _, text in documents:
        words = lower_space_words(text)
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(documents):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(documents)]
