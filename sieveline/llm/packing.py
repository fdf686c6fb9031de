"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters for the packing, so the search runs on a histogram of at
most ``capacity`` lengths, whatever the number of documents. Its result is a list of patterns (lengths that
share a sequence) with multiplicities; pieces take their places in it by their rank among those of equal
length, which Spark counts in salted buckets.

The search: best-fit decreasing gives the incumbent. Bin completion takes the longest piece left and branches on
the undominated fillings of the rest of its sequence, each as often as the counts allow, or once. A branch is left
once its waste shows that it can't beat the incumbent. Packings that deviate little from the first choices (least
waste) are looked at first, then those that deviate more, until the lower bound is met or nothing is left out. That
is exact, but takes exponential time: ``nodes`` bounds the steps of the whole search, ``steps`` those of the
enumeration for one sequence. Where they are spent, the best packing found so far is the result.

A null text is an empty one: it is the end token alone. Repeated rows are packed each on their own. Empty
tables give no rows. Texts of any length are cut, never shortened.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import Scratch, text_chunks

CAPACITY, END_ID = 1024, 2
#: Steps of the search, and of the enumeration of the fillings of one sequence.
NODES, STEPS = 1_000_000, 1500


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenBytes:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A text is parted before each blank that follows another character than white space; the tokenizer's own first
    step parts there as well, so the parts can be encoded apart. The distinct parts of a run of texts are encoded once,
    many in a call; the lengths of the tokens tell where each part ends. Texts with the text of a special token are
    encoded whole.
    """

    SPECIAL = "<|endoftext|>"
    #: Bytes of a run of texts, and of the parts encoded in a call; parts whose ids are copied at once.
    RUN, CALL, BLOCK = 1 << 22, 1 << 17, 1 << 18
    #: Letters beyond Latin (from U+0250) begin with this byte or a larger one.
    BEYOND = 0xC9

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # last bytes of white space: alone, after C2, two after E1 to E3 (with some that are none)
        self.spaces = np.zeros((3, 256), bool)
        for k, last in enumerate(([*range(9, 14), *range(28, 33)], [0x85, 0xA0], [*range(0x80, 0x90), 0x9F, 0xA8, 0xA9, 0xAF])):
            self.spaces[k, last] = True

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str, latin: bool) -> np.ndarray:
        # the same ids by either library; letters beyond Latin are left to the one that defines them
        return np.array(self.fast.encode_ordinary(text) if latin else self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def after_space(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether white space may stand before these places: true for all of it, and for few other characters."""
        one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
        return self.spaces[0, one] | self.spaces[1, one] & (two == 0xC2) | self.spaces[2, one] & (three >= 0xE1) & (three <= 0xE3)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; those of null are empty."""
        texts = texts.fill_null("")
        marked = pc.match_substring(texts, self.SPECIAL)
        plain = pc.if_else(marked, pa.scalar("", texts.type), texts)
        for first, data, offsets in text_chunks(plain, self.RUN):
            ids, ends = self.run(data, offsets)
            for i, whole in enumerate(marked[first : first + len(offsets) - 1].to_pylist()):
                yield self.ids(texts[first + i].as_py(), False).tobytes() if whole else ids[ends[i] : ends[i + 1]].tobytes()

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts, and where those of each text begin (one more than texts)."""
        blanks = np.flatnonzero(data == 32)
        begins = np.zeros(len(data) + 1, bool)
        begins[blanks[~self.after_space(data, blanks)]] = begins[offsets] = True
        begin = np.flatnonzero(begins).astype(np.int32)
        n = len(begin) - 1
        parts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
        which = parts.indices.to_numpy()
        known, start, count = self.distinct(parts.dictionary)
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(count[which], out=ends[1:])
        ids = np.empty(ends[-1], "<u4")
        for a in range(0, n, self.BLOCK):
            b = min(a + self.BLOCK, n)
            ids[ends[a] : ends[b]] = known[np.repeat(start[which[a:b]] - ends[a:b], np.diff(ends[a : b + 1])) + np.arange(ends[a], ends[b])]
        return ids, ends[np.searchsorted(begin, offsets)]

    def distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and by part where its own begin there and their number."""
        n = len(parts)
        start, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n:
            return np.zeros(0, "<u4"), start, count
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[: n + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)[: offsets[-1]]
        size = np.diff(offsets)
        latin = np.maximum.reduceat(data, offsets[:-1]) < self.BEYOND
        # such parts are parted again where they meet
        row = (data[offsets[:-1]] == 32) & ~self.after_space(data, offsets[1:])
        found, have = [], 0
        for by in (True, False):
            among = np.flatnonzero(row & (latin == by))
            calls = np.split(among, np.flatnonzero(np.diff(np.cumsum(size[among], dtype=np.int64) // self.CALL)) + 1)
            for some in calls if len(among) else ():
                ids = self.ids(b"".join(parts.take(pa.array(some)).to_pylist()).decode(), by)
                ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size[some], dtype=np.int64)) + 1
                count[some] = np.diff(ends, prepend=0)
                start[some] = have + ends - count[some]
                found.append(ids)
                have += len(ids)
        for i in np.flatnonzero(~row).tolist():
            ids = self.ids(parts[i].as_py().decode(), bool(latin[i]))
            start[i], count[i] = have, len(ids)
            found.append(ids)
            have += len(ids)
        return np.concatenate(found), start, count


def cut_pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokenizes and cuts: doc_id, piece, start, length, ids_crc32."""
    paths = paths or tokenizer_paths()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenBytes(*paths).encode
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for i, body in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                data = memoryview(body + end)
                n = len(data) // 4
                at, to = 0, n % capacity or capacity
                while at < n:
                    ids.append(i)
                    piece.append(at // capacity + (at % capacity > 0))
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, to = to, to + capacity
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[doc_id, "piece", "start", "length", "ids_crc32"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal pieces and equal sequences are handled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, times))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            fit = room // s
            use = min(times, left // fit) if left >= fit else 0
            if use:
                put(room - fit * s, (*pattern, (s, fit)), use)
                left -= use * fit
            else:
                put(room - left * s, (*pattern, (s, left)), 1)
                left, use = 0, 1
            if times > use and pattern:
                put(room, pattern, times - use)
    return [x for room in open_.values() for x in room]


def dominated(chosen: tuple[int, ...], waste: int, free: int) -> bool:
    """Whether pieces of a filling, or none, can give way to one free piece that is longer than they, or as long as two or more.

    Such an exchange never needs another sequence: what gives way fits where the free piece would have stood.
    Sums of pieces are the bits of a number, as are the lengths of the free pieces.
    """
    one = many = 0
    for s in chosen:
        many |= (many | one) << s
        one |= 1 << s
    if many & free:
        return True
    wide, have = 1 | one | many, 1
    while have < waste:
        step = min(have, waste - have)
        wide |= wide << step
        have += step
    return waste > 0 and wide << 1 & free > 0


def fillings(room: int, free: int, counts: dict[int, int], steps: int, one: bool = False) -> tuple[list[tuple[int, tuple[int, ...]]], bool, int]:
    """Undominated fillings of a room as (waste, lengths), least waste first; whether all were looked at; the steps that it took.

    free: the lengths of free pieces, as bits. Long pieces are tried first, up to so many steps; if one will do, until
    nothing is wasted.
    """
    if free >> room & 1:  # it dominates all others
        return [(0, (room,))], True, 1
    found: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []
    fits = lambda left, mask: mask & ((2 << left) - 1)
    # by piece: what may follow the pieces before it, the room before it, the free pieces before it
    stack = [(fits(room, free), room, free)]
    spent = 0
    while stack:
        mask, left, now = stack.pop()
        if not mask:
            if chosen:
                chosen.pop()
            continue
        s = mask.bit_length() - 1
        stack.append((mask ^ 1 << s, left, now))
        spent += 1
        if spent > steps and found:
            break
        chosen.append(s)
        after = now if chosen.count(s) < counts[s] else now ^ 1 << s
        below = fits(min(left - s, s), after)
        if not below:
            if not dominated(tuple(chosen), left - s, after):
                found.append((left - s, tuple(chosen)))
                if one and left == s:
                    return found[-1:], False, spent
            chosen.pop()
            continue
        stack.append((below, left - s, after))
    if not found:  # nothing fits
        found.append((room, ()))
    return sorted(found, key=lambda x: (x[0], len(x[1]), tuple(-s for s in x[1]))), spent <= steps, spent


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and, for every k, the bound that leaves out pieces shorter than k."""
    number, volume = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for s, c in counts.items():
        number[s], volume[s] = c, s * c
    above = lambda x, at: int(x[at:].sum())
    half = capacity // 2 + 1
    best = -(-above(volume, 0) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = above(number, capacity - k + 1)
        large, filled = above(number, half) - alone, above(volume, half) - above(volume, capacity - k + 1)
        small = above(volume, k) - above(volume, half)
        best = max(best, alone + large + max(0, -(-(small - (large * capacity - filled)) // capacity)))
    return best


class Completion:
    """Branch and bound: the sequence of the longest piece left is completed by one undominated filling after the other."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int, steps: int):
        self.left = {s: c for s, c in counts.items() if c}
        self.capacity, self.nodes, self.steps = capacity, nodes, steps
        self.total, self.least = sum(s * c for s, c in self.left.items()), lower_bound(self.left, capacity)
        self.best = best_fit(self.left, capacity)
        self.size = sum(m for _, m in self.best)
        self.free = sum(1 << s for s in self.left)
        self.spent = 0

    def options(self, one: bool) -> tuple[list[tuple[dict[int, int], int, int]], bool]:
        """(pieces, how often, waste of each) for the longest piece left: each filling as often as the counts allow, then once."""
        s = self.free.bit_length() - 1
        self.left[s] -= 1
        found, whole, steps = fillings(self.capacity - s, self.free if self.left[s] else self.free ^ 1 << s, self.left, self.steps, one)
        self.left[s] += 1
        self.spent += steps
        often, once = [], []
        for rest, chosen in found:
            need: dict[int, int] = {}
            for x in (s, *chosen):
                need[x] = need.get(x, 0) + 1
            times = min(self.left[x] // n for x, n in need.items())
            often.append((need, times, rest))
            if times > 1:
                once.append((need, 1, rest))
        return often + once, whole

    def take(self, need: dict[int, int], times: int) -> None:
        for x, n in need.items():
            had = self.left[x]
            self.left[x] = had - n * times
            if (had > 0) != (self.left[x] > 0):
                self.free ^= 1 << x

    def search(self, deviations: int) -> bool:
        """Looks at all packings with so many deviations at most, the n-th option counting n - 1; whether there are no others."""
        first, whole = self.options(deviations == 0)
        # by sequence: its options, the one to take next (from the last that is allowed to the first), the deviations before it
        stack = [[first, min(deviations, len(first) - 1), 0]]
        whole &= len(first) - 1 <= deviations
        taken: list[tuple[dict[int, int], int, int]] = []
        waste = bins = 0
        while stack:
            options, i, used = stack[-1]
            if i < 0 or self.size <= self.least or self.spent >= self.nodes:
                whole &= i < 0
                stack.pop()
                if taken:
                    need, times, rest = taken.pop()
                    self.take(need, -times)
                    waste, bins = waste - rest * times, bins - times
                continue
            stack[-1][1] -= 1
            need, times, rest = options[i]
            if waste + rest * times > (self.size - 1) * self.capacity - self.total:  # no better than the incumbent any more
                continue
            self.take(need, times)
            if self.free:
                taken.append((need, times, rest))
                waste, bins = waste + rest * times, bins + times
                more = deviations - used - i
                following, all_ = self.options(more == 0)
                whole &= all_ and len(following) - 1 <= more
                stack.append([following, min(more, len(following) - 1), used + i])
                continue
            if bins + times < self.size:
                self.size = bins + times
                self.best = [(tuple(sorted(n.items(), reverse=True)), m) for n, m, _ in (*taken, (need, times, rest))]
            self.take(need, -times)
        return whole


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold all pieces, by bin completion; as few as can be, if nodes and steps suffice."""
    search, deviations = Completion(counts, capacity, nodes, steps), 0
    while search.size > search.least and search.spent < nodes and not search.search(deviations):
        deviations += 1
    return search.best


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, copies in a sequence, first sequence, place in it), sorted."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for s, n in pattern:
            first = next_rank.get(s, 0)
            next_rank[s] = first + n * times
            rows.append((s, first, first + n * times, n, sequence, at))
            at += n * s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None, nodes: int = NODES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut_pieces(documents, doc_id, text, capacity, end_id, paths), "pieces")
    # a bucket of a length is ranked in one task, so their number follows the number of pieces
    buckets = max(16, pieces.count() // 200_000)
    bucket = F.pmod(F.xxhash64(doc_id, "piece", "ids_crc32"), F.lit(buckets))
    dealt = pieces.withColumn("bucket", bucket)
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = spark.sparkContext.broadcast(places(complete(histogram, capacity, nodes)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # equal rows alone tie, so a task that runs again gives each piece its place again
    own = Window.partitionBy("length", "bucket").orderBy(doc_id, "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"]).select(doc_id, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            _, first, _, copies, sequence, offset = table[at].T
            nth = rank - first
            columns = [batch.column(c) for c in (doc_id, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + nth // copies), pa.array(offset + nth % copies * length)], names=[doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(assign, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
