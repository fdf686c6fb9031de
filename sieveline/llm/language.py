"""Language identification as inference in a mixture of languages.

Each language has a letter-trigram model (the chance of a letter after the two before it, backed off to pairs
and single letters). A document's words are a mixture of draws from the languages; expectation-maximisation
estimates the proportions. A set of languages is chosen by penalised likelihood: starting from all, the
language with the least share is left out for as long as the likelihood lost is below the penalty for it.
Estimation ends by a bound of the likelihood that is still missing, not after a number of rounds.
The predicted language is the one with the largest share in the chosen set.

The models are fitted on at most about ``sample`` documents of each language, taken evenly by a hash of
their id; this bound is part of the interface. Prediction covers every document, whole.

Null texts and texts without a letter are predicted ``und`` with score 0, as are all if nothing was learned.
Null ids are never held out. Repeated documents each get their row. A language is any non-null value of the
language column; equal likelihoods go to the first in sorted order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 3_000
ROUNDS, PENALTY = 12, 3.0
#: Log-likelihood that may be missing when estimation ends; it rises in proportion beyond SLOW rounds, so that ties end.
TOLERANCE, SLOW = 0.05, 600
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def count_trigrams(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts by language and letter trigram (words are padded by blanks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        grams: Counter = Counter()

        def flush() -> None:
            for name, counts in words.items():
                for w, n in counts.items():
                    padded = f"  {w} "
                    for i in range(len(padded) - 2):
                        grams[name, padded[i : i + 3]] += n
            words.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(letter_words(body))
            if sum(map(len, words.values())) > 300_000:
                flush()
        flush()
        keys = list(grams)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([grams[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    return documents.select(lang, text).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trigrams(dict):
    """Log-likelihoods of words by language; a word's row number in the table, remembered up to a bound."""

    BOUND = 1 << 18

    def __init__(self, counts: list[tuple[str, str, int]]):
        super().__init__()
        self.langs = sorted({c[0] for c in counts})
        size = len(self.langs)
        column = {name: i for i, name in enumerate(self.langs)}
        self.by_order: list[dict[str, np.ndarray]] = [{}, {}, {}, {}]
        self.by_context: list[dict[str, np.ndarray]] = [{}, {}, {}, {}]
        for name, gram, n in counts:
            for k in (1, 2, 3):  # a trigram counts for the shorter ends of it as well
                for store, key in ((self.by_order, gram[-k:]), (self.by_context, gram[-k:-1])):
                    if (row := store[k].get(key)) is None:
                        row = store[k][key] = np.zeros(size)
                    row[column[name]] += n
        self.letters = max(1, len(self.by_order[1])) + 50
        self.known: dict[str, np.ndarray] = {}
        self.table = np.zeros((1024, size), np.float32)

    def chance(self, gram: str) -> np.ndarray:
        p = np.full(len(self.langs), 1 / self.letters)
        for k, weight in ((1, 1.0), (2, 4.0), (3, 4.0)):
            context = self.by_context[k].get(gram[-k:-1])
            if context is None:
                break
            p = (self.by_order[k].get(gram[-k:], 0.0) + weight * p) / (context + weight)
        return np.log(p)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.BOUND:
            raise MemoryError  # renew() is called between documents
        padded, total = f"  {word} ", 0
        for i in range(len(padded) - 2):
            gram = padded[i : i + 3]
            if (row := self.known.get(gram)) is None:
                row = self.known[gram] = self.chance(gram)
            total = total + row
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = total
        self[word] = at
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, word by language."""
        if len(self) + len(words) > self.BOUND:
            self.clear()
            if len(words) > self.BOUND:
                return np.concatenate([self.rows(words[i : i + self.BOUND]) for i in range(0, len(words), self.BOUND)])
        places = [self[w] for w in words]  # may replace the table
        return self.table[places]

    def renew(self) -> None:
        if len(self.known) > 300_000:
            self.known.clear()


def mixture(logs: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, enough: float = -math.inf) -> tuple[np.ndarray, float, float]:
    """Shares of the languages by expectation-maximisation, the log-likelihood under them, and a bound of what is missing to the greatest.

    After the first ``rounds``, rounds go on until the bound is below TOLERANCE, or no likelihood above ``enough`` can be reached.
    """
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    total, shift = counts.sum(), float(counts @ top[:, 0])
    shares = np.full(logs.shape[1], 1 / logs.shape[1])
    done = 0
    while True:
        for _ in range(rounds):
            shares = shares * ((counts / np.maximum(p @ shares, 1e-30)) @ p) / total
        done += rounds
        shares /= shares.sum()
        under = np.maximum(p @ shares, 1e-30)
        like = float(counts @ np.log(under)) + shift
        # the likelihood is concave in the shares, so its slope towards the best single language bounds the gain
        gain = max(0.0, float(((counts / under) @ p).max()) - total)
        if gain <= TOLERANCE * max(1.0, done / SLOW) or like + gain <= enough:
            return shares, like, gain


def choose(logs: np.ndarray, counts: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """The chosen languages, and their shares (largest first)."""
    n_langs = logs.shape[1]
    single = counts @ logs
    best = int(single.argmax())
    price = penalty * math.log(1 + counts.sum())
    if n_langs == 1:
        return [0], np.ones(1)
    shares, like, gain = mixture(logs, counts, rounds, float(single[best]) + price)
    if like + gain - single[best] <= price:  # no larger set can make up for even one more penalty
        return [best], shares[[best]]
    members = list(range(n_langs))
    while len(members) > 1:
        weak = int(shares.argmin())
        fewer = members[:weak] + members[weak + 1 :]
        new_shares, new_like, _ = mixture(logs[:, fewer], counts, rounds, like - price)
        if like - new_like > price:
            break
        members, shares, like = fewer, new_shares, new_like
    order = np.argsort(-shares, kind="stable")
    return [members[i] for i in order], shares[order]


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> list[tuple[str, str, int]]:
    """Trigram counts of at most about sample documents of each language."""
    able = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in able.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1_000_000))
    taken = [(F.col(lang) == name) & (draw < int(1_000_000 * sample / n)) if n > sample else F.col(lang) == name for name, n in sizes.items()]
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen | t
    return [tuple(r) for r in count_trigrams(able.where(chosen), text, lang).collect()]


def identify(documents: DataFrame, counts: list[tuple[str, str, int]], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Adds lang_pred, score and lang_shares (language to share, of the chosen set) to documents."""
    held = documents.sparkSession.sparkContext.broadcast(counts)
    plain = documents.select(*[c for c in documents.columns if c not in ("lang_pred", "score", "lang_shares")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trigrams(held.value)
        for batch in batches:
            names, scores, mixes = [], [], []
            for body in batch.column(text).to_pylist():
                words = Counter(letter_words(body))
                if not model.langs or not words or not any(c.isalpha() for c in body):
                    names.append("und")
                    scores.append(0.0)
                    mixes.append([])
                    continue
                model.renew()
                members, shares = choose(model.rows(list(words)), np.fromiter(words.values(), np.float64, len(words)), penalty)
                names.append(model.langs[members[0]])
                scores.append(min(1.0, float(shares[0])))
                mixes.append([(model.langs[i], float(s)) for i, s in zip(members, shares, strict=True)])
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "lang_shares": pa.array(mixes, pa.map_(pa.string(), pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, lang_pred string, score double, lang_shares map<string,double>")
