"""Helpers shared by the operators of this subpackage: words, hashes, shared scratch tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: An odd multiplier; powers of it weigh the words of a rolling hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_2 = 0xC2B2AE3D27D4EB4F | 1
BASE_3 = 0xD6E8FEB86659FD93 | 1
BASE_4 = 0xA0761D6478BD642F | 1
MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where a local session names none (tests). A cluster must name one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or None
    context = spark.sparkContext
    if given is None:
        given = context.getCheckpointDir()
        if given is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="sieveline-checkpoint-")
            context.setCheckpointDir(given)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared checkpoint folder, and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder, deleted by drop() once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/sieveline/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps that nothing refers to any more; it does so when garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch, where the session names no number: whole texts of some kilobytes are in them.
BATCH_ROWS = 2_000


def worker_path(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it, and keeps batches of whole texts small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


#: One heap for all threads of a worker, of which what is freed goes back to the system; Arrow's batches come from it too.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(1 << 17), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """worker_path, and Python workers that keep no memory from one task for the next; settings that the session has stay."""
    worker_path(spark)
    for key, value in LEAN.items():
        spark.sparkContext.environment.setdefault(key, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: str | None) -> list[bytes]:
    """Maximal runs of [^\\x20\\x09-\\x0D], as UTF-8; bytes.split() parts at just these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes that part words, as blanks: those of [\x20\x09-\x0D]; then with A-Z in lower case; then all but alphanumeric ones and those above ASCII.
SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
LOWER_SPACES = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lower_space_words(text: str | None) -> list[bytes]:
    """space_words after lower-casing A-Z alone."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes maximal runs of 0-9, a-z and all above ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def word_chunks(texts: list[str | None], words_of: Callable[[str | None], list[bytes]], most: int = 200_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts as words, of about ``most`` words each, with the place of their first text; only one run is held at a time."""
    first, part, n = 0, [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        part.append(words)
        n += len(words) + 4
        if n >= most or i == len(texts) - 1:
            yield first, part
            first, part, n = i + 1, [], 0


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of the texts of a string column, of about ``most`` bytes each: place of the first, bytes, offsets of the texts in them (one more than texts)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        to = min(to, first + 20_000, len(column))
        yield first, data[offsets[first] : offsets[to]], offsets[first : to + 1] - offsets[first]
        first = to


class ByteWords:
    """Words of texts, with 64-bit hashes of their bytes.

    classes: by byte the byte that stands for it, 32 if it parts words. Texts are hashed in blocks, so that a long one
    takes no more memory than its words. A second, independent hash (other values of the bytes, another base) on demand.
    """

    BLOCK = 1 << 17

    def __init__(self, classes: bytes, seconds: bool = False):
        table = np.frombuffer(classes, np.uint8)
        self.parts = table == 32
        bases = (BASE_3, BASE_4) if seconds else (BASE_3,)
        self.kinds = [(mix(table.astype(U64) + U64(seed << 32)), Powers(base)) for seed, base in enumerate(bases, 1)]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (of either kind), first byte and end of all words, and the number of words of each text."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return [none.view(U64) for _ in self.kinds], none, none, np.zeros(len(offsets) - 1, np.int64)
        inner = ~self.parts[data]
        start, end = inner.copy(), inner.copy()
        start[1:] &= ~inner[:-1]
        end[:-1] &= ~inner[1:]
        full = np.flatnonzero(np.diff(offsets))
        at, last = offsets[full], offsets[full + 1] - 1
        start[at], end[last] = inner[at], inner[last]
        begin, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        sizes = np.diff(np.searchsorted(begin, offsets))
        hashes = [np.empty(len(begin), U64) for _ in self.kinds]
        i = 0
        while i < len(begin):
            low = begin[i]
            to = max(i + 1, int(np.searchsorted(end, low + self.BLOCK, "right")))
            a, b = begin[i:to] - low, end[i:to] - low
            part = data[low : low + b[-1]]
            for (values, powers), out in zip(self.kinds, hashes, strict=True):
                prefix = powers.prefix(values[part])
                out[i:to] = mix((prefix[b] - prefix[a]) * powers.down[a] + (b - a).astype(U64))
            i = to
        return hashes, begin, end, sizes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1024)
            self.up = self._powers(self.base, size)
            self.down = self._powers(self.inverse, size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, U64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """prefix[i]: the weighed sum of x[:i]."""
        self.grow(len(x) + 1)
        out = np.zeros(len(x) + 1, U64)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of x[start:end], the same wherever the span stands."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k; empty if there are fewer values."""
        n = len(prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((prefix[k:] - prefix[:-k]) * self.down[:n] + U64(k))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 step)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w gram hashes the place of the smallest (its upper 32 bits; the leftmost of equals)."""
    keys = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    return (sliding_min(keys, w) & U64(0xFFFFFFFF)).astype(np.int64) if len(grams) >= w else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
