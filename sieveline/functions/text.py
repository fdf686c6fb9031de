"""Text expressions on built-in functions; the few that Spark lacks are Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.lexicons import CUES, ROMANISED, STOP_WORDS

DEVANAGARI = r"ऀ-ॿ"
#: Java's form of Unicode word characters without combining marks.
WORD = r"\p{L}\p{N}_"
BLANKS = r"[\s\u0085   -     　\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uid(source: Column | str, source_id: Column | str) -> Column:
    """Key of a record: the first 16 digits of sha1('source:source_id')."""
    return F.substring(F.sha1(F.concat_ws(":", _col(source), _col(source_id).cast("string"))), 1, 16)


def strip(text: Column | str) -> Column:
    """Trims all Unicode white space, not blanks alone."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"^{BLANKS}+", ""), f"{BLANKS}+$", "")


def normalise(text: Column | str) -> Column:
    """Lower case; other signs than word characters and Devanagari become blanks; runs of blanks become one."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    words = F.regexp_replace(lowered, f"[^{WORD}\\s{DEVANAGARI}]+", " ")
    return F.trim(F.regexp_replace(words, f"{BLANKS}+", " "))


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFKC form of all texts; nfkc() spares those that have none."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column | str) -> Column:
    """NFKC form; ASCII texts, which it leaves as they are, don't go to Python."""
    text = _col(text)
    return F.coalesce(compose(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """NFC form with white space collapsed."""
    return text.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFC", x or "")).strip())


def has_devanagari(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(f"[{DEVANAGARI}]"), F.lit(False))


def has_latin(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike("[A-Za-z]"), F.lit(False))


def count_of(text: Column | str, signs: str) -> Column:
    """How many characters of a class a text holds."""
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), f"[^{signs}]", ""))


def script_profile(text: Column | str) -> Column:
    """Struct of the shares of Devanagari, Latin and digits among their sum, rounded to 3; zeros if there are none."""
    n = {"devanagari": count_of(text, DEVANAGARI), "latin": count_of(text, "A-Za-z"), "digit": count_of(text, "0-9")}
    total = sum(n.values(), F.lit(0))
    return F.struct(*[F.when(total > 0, F.round(x / total, 3)).otherwise(F.lit(0.0)).alias(k) for k, x in n.items()])


def looks_like_garbage(text: Column | str, min_chars: int = 8, min_ratio: float = 0.5) -> Column:
    """Too short, or with too few letters and digits."""
    core = strip(F.coalesce(_col(text), F.lit("")))
    return (F.length(core) < min_chars) | (count_of(core, r"\p{L}\p{N}") / F.greatest(F.length(core), F.lit(1)) < min_ratio)


def cues(text: Column | str, patterns: list[tuple[str, str]] = CUES, most: int = 5) -> Column:
    """Array of (cue, matches): distinct matches in order of their first place, at most ``most`` each; cues without any are left out."""
    found = [F.struct(F.lit(name).alias("cue"), F.slice(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(f"(?i)(?:{p})"), F.lit(0))), 1, most).alias("matches")) for name, p in patterns]
    return F.filter(F.array(*found), lambda x: F.size(x["matches"]) > 0)


def content_words(text: Column | str, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of a-z, digits and Devanagari that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(f"[a-z0-9{DEVANAGARI}]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop_words))


def shingles(words: Column | str, n: int = 3) -> Column:
    """Distinct runs of n words; fewer words give the words themselves.

    Shifted slices are zipped, so that the words stand outside of all lambdas: wherever the optimiser moves the
    expression, they are computed a few times a row, never once a shingle.
    """
    w = _col(words)
    runs = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
    for i in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(w, i, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(w) < n, w).otherwise(runs))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def transliterate(text: Column | str, words: dict[str, str] = ROMANISED) -> Column:
    """Known romanised words in Devanagari; tokens joined by blanks, with punctuation close to the word before it."""
    tokens = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"[A-Za-z{DEVANAGARI}0-9]+|[^\\sA-Za-z{DEVANAGARI}0-9]"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    mapped = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, F.lower(t)), t))
    return F.trim(F.regexp_replace(F.array_join(mapped, " "), f" ([^{WORD}{DEVANAGARI}])", "$1"))


def both_forms(text: Column | str, words: dict[str, str] = ROMANISED) -> Column:
    """text, and after ' | ' its transliteration, if that differs."""
    own, other = _col(text), transliterate(text, words)
    return F.when(own == other, own).otherwise(F.concat(own, F.lit(" | "), other))


def assemble(parts: list[Column | str], separator: str = " [SEP] ", max_chars: int = 4000) -> Column:
    """Non-blank parts in order, joined and cut."""
    kept = [F.when(F.length(strip(p)) > 0, strip(p)) for p in parts]
    return F.substring(F.concat_ws(separator, *kept), 1, max_chars)


def guard_cell(text: Column | str) -> Column:
    """Keeps spreadsheets from reading a cell as a formula."""
    return F.when(_col(text).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _col(text))).otherwise(_col(text))
