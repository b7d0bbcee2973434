"""Text functions as Catalyst expressions; only what Spark has no expression for is an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F


def compact_text(text: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def caption_characters(text: Column) -> Column:
    """Letters and numbers of a caption without blanks, case kept."""
    return F.regexp_replace(without_blanks(text), r"[^\p{L}\p{N}]", "")


def fold_text(text: Column) -> Column:
    """Compatibility form (NFKC) without blanks, punctuation and symbols."""

    def run(s: pd.Series) -> pd.Series:
        keep = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if not c.isspace() and unicodedata.category(c)[0] not in "PS")
        return s.map(keep, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def folded_with_offsets(text: Column) -> Column:
    """Case-folded letters and numbers of each character's NFKC form, with the position (from 0) each came from."""

    def run(s: pd.Series) -> pd.DataFrame:
        texts, offsets = [], []
        for t in s:
            kept = [] if t is None else [(c, i) for i, x in enumerate(t) for c in unicodedata.normalize("NFKC", x).casefold() if unicodedata.category(c)[0] in "LN"]
            texts.append(None if t is None else "".join(c for c, _ in kept))
            offsets.append(None if t is None else [i for _, i in kept])
        return pd.DataFrame({"text": texts, "offsets": offsets})

    return F.pandas_udf(run, "text string, offsets array<int>")(text)


def language_family(text: Column, least: int = 2) -> Column:
    """'zh' or 'latin' by the majority of at least `least` letters of that script, else 'unknown'; NULL for NULL."""
    han = F.length(F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-zÀ-ÖØ-öø-ɏ]", ""))
    return F.when(text.isNull(), F.lit(None).cast("string")).when((han >= least) & (han >= latin), "zh").when((latin >= least) & (latin > han), "latin").otherwise("unknown")


def strip_event_tags(text: Column) -> Column:
    """Text without <...> tags and note symbols, blanks collapsed, trimmed of punctuation at both ends."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>|[♪♫🎵]", " "), r"\s+", " ")
    return F.regexp_replace(plain, r"^[\s\p{P}]+|[\s\p{P}]+$", "")


def event_tags(text: Column) -> Column:
    """Distinct <|tag|> names in order of first appearance, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"<\|([^|<>]+)\|>"), F.lit(1)))


def is_substantial_speech(text: Column, fillers: list[str], han: int = 4, words: int = 3, letters: int = 8) -> Column:
    """At least `han` Han characters, or `words` distinct-from-filler Latin words of `letters` letters together."""
    latin = F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zà-öø-ÿ]+)"), F.lit(1)), F.array(*[F.lit(f) for f in fillers]))
    total = F.aggregate(latin, F.lit(0), lambda a, w: a + F.length(w))
    return (F.length(F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", "")) >= han) | ((F.size(latin) >= words) & (total >= letters))


def surface_tokens(text: Column) -> Column:
    """Latin words, numbers and every other character that is no blank, in order."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z]+(?:['’\-][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*|\S)"), F.lit(1))


def join_tokens(tokens: Column) -> Column:
    """Tokens joined with a blank only between two ASCII letters or digits."""
    return F.regexp_replace(F.regexp_replace(F.array_join(tokens, "\u0001"), "(?<=[A-Za-z0-9])\u0001(?=[A-Za-z0-9])", " "), "\u0001", "")


def clause_at(text: Column, start: Column, end: Column, separators: str = "。；;！!？?\n") -> Column:
    """The clause around the characters start..end (from 0), bounded by the nearest separators."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), rf"([^{separators}]*)$", 1)
    inside = F.substring(text, start + 1, end - start)
    after = F.regexp_extract(F.substring(text, end + 1, F.length(text)), rf"^([^{separators}]*)", 1)
    return F.trim(F.concat(before, inside, after))


def quoted_spans(text: Column) -> Column:
    """Contents of straight and curly double quotes and corner brackets, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r'"([^"\n]+)"|“([^”\n]+)”|「([^」\n]+)」|『([^』\n]+)』'), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2))), lambda x: x != ""))


def canonical_number(raw: Column, least: int = 4) -> Column:
    """Digits of at least `least` places, however many, without leading zeros; NULL for fewer digits and for all zeros."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when((F.length(digits) >= least) & ~digits.rlike("^0*$"), F.regexp_replace(digits, "^0+", ""))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))


def last_time_range(text: Column, within: int = 900) -> Column:
    """(start, end) of the last 'a - b s' range in the last `within` characters."""
    tail = F.substring(text, F.greatest(F.length(text) - within + 1, F.lit(1)), F.lit(within))
    all_ = F.regexp_extract_all(tail, F.lit(r"(\d+(?:\.\d+)?\s*(?:s|秒)?\s*[-–—~至到]\s*\d+(?:\.\d+)?\s*(?:s|秒))"), F.lit(1))
    last = F.try_element_at(all_, F.lit(-1))
    pick = lambda g: F.regexp_extract(last, r"(\d+(?:\.\d+)?)\s*(?:s|秒)?\s*[-–—~至到]\s*(\d+(?:\.\d+)?)", g).try_cast("double")
    return F.when(last.isNotNull(), F.struct(pick(1).alias("start_sec"), pick(2).alias("end_sec")))


def contains_any(text: Column, markers: list[str]) -> Column:
    """One alternation over literal markers; false for an empty list, NULL for NULL."""
    if not markers:
        return F.when(text.isNotNull(), F.lit(False))
    return text.rlike("|".join(re.escape(m) for m in markers))


def fenced_blocks(text: Column) -> Column:
    """Contents of fenced blocks, in order; the form of a fence is a fixed value."""
    return F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?[ \t]*\r?\n(.*?)```"), F.lit(1))
