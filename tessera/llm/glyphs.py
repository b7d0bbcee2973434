"""One form for visually identical text.

A longest-match transducer over grapheme clusters, compiled from rules into one table of single characters and one
pattern, rewrites a text in one pass: wide and narrow forms, compatibility characters that look like the normal one,
kinds of space, invisible characters, accents (composed) and look-alike letters. The table is checked at compile
time: every output is a fixed point, so no rule feeds another and the result does not depend on their order.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.runtime import cut

# Letters of other alphabets that look like a Latin letter.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}

_VISIBLE_FORMAT = {0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD, *range(0x600, 0x606), *range(0x890, 0x892)}
_RANGES = (range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE01F0))
_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def invisible(c: str) -> bool:
    o = ord(c)
    if U.category(c) == "Cf":
        return o not in _VISIBLE_FORMAT
    return o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


_MAY_CHANGE = frozenset(("Cf", "Cc", "Zs", "Zl", "Zp", "Mn", "Mc", "Me"))


def _may_change(c: str) -> bool:
    """False for letters that are sure to stay: nothing to decompose, visible and no look-alike."""
    return U.category(c) in _MAY_CHANGE or U.decomposition(c) != "" or c in LOOKALIKES or c in "\u115f\u1160"


def _plain(c: str) -> str:
    """The normal form of one character, still in its own alphabet."""
    if invisible(c):
        return ""
    if U.category(c) == "Zs" or c in "\t\v\f":
        return " "
    if c in "\u0085  \r":
        return "\n"
    kind = U.decomposition(c)
    o = ord(c)
    if kind.startswith(_TAGS) or kind.startswith("<compat>") and (0x2E80 <= o <= 0x2FDF or 0xFB00 <= o <= 0xFB06 or 0x3130 <= o <= 0x318F or c in "…‥"):
        return U.normalize("NFKC", c)
    return U.normalize("NFC", c)


def _latin(c: str) -> str:
    return U.normalize("NFC", "".join(LOOKALIKES.get(x, x) for x in U.normalize("NFD", _plain(c))))


def _ranges(chars: list[str]) -> str:
    out, start, prev = [], None, None
    for o in sorted(map(ord, chars)) + [None]:
        if prev is not None and o != prev + 1:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(prev)) if prev > start else ""))
            start = o
        start = o if start is None else start
        prev = o
    return "".join(out)


class Transducer:
    """table: single characters; pattern: clusters that need rewriting (longest first)."""

    def __init__(self, fold_lookalikes: bool):
        self.one = _latin if fold_lookalikes else _plain
        self.table, marks = {}, []
        ascii_part = (chr(o) for o in (9, 11, 12, 13))
        every = [*ascii_part, *(chr(o) for r in _RANGES for o in r if not 0xD800 <= o <= 0xDFFF)]
        for c in filter(_may_change, every):
            if U.combining(c) or c in "ﾞﾟ":
                marks.append(c)
            out = self.one(c)
            if out != c:
                self.table[c] = out
        self.check()
        ext = _ranges([*marks, *(c for c, v in self.table.items() if v == "")])
        #: characters with which a cluster can be longer than one character
        self.joining = frozenset([*marks, *(c for c, v in self.table.items() if v == ""), "\r", *map(chr, range(0x1100, 0x1113))])
        self.pattern = re.compile(rf"\r\n|[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[^{ext}]?[{ext}]+|[{_ranges(list(self.table))}]")
        self.cluster = lru_cache(1 << 16)(self._cluster)

    def check(self) -> None:
        for c, out in self.table.items():
            if any(self.table.get(x, x) != x for x in out) or U.normalize("NFC", out) != out:
                raise ValueError(f"conflicting rules at U+{ord(c):04X}")

    def _cluster(self, text: str) -> str:
        if text == "\r\n":
            return "\n"
        return U.normalize("NFC", "".join(self.one(x) for x in U.normalize("NFD", "".join(self.table.get(c, c) for c in text))))

    def __call__(self, text: str) -> str:
        if text.isascii() and "\r" not in text and "\t" not in text and "\v" not in text and "\f" not in text:
            return text
        table, cluster = self.table, self.cluster
        used = set(text)
        if used.isdisjoint(self.joining):  # every cluster is one character, and no output is rewritten again
            for c in used & table.keys():
                text = text.replace(c, table[c])
            return text

        def put(m: re.Match) -> str:
            s = m[0]
            return table[s] if len(s) == 1 and s in table else cluster(s)

        return self.pattern.sub(put, text)


@lru_cache(2)
def transducer(fold_lookalikes: bool = True) -> Transducer:
    return Transducer(fold_lookalikes)


def skeleton(text: str) -> str:
    """Equal for texts that look the same, and only for those."""
    return transducer(True)(text)


def widths(text: str) -> str:
    """As skeleton, but every letter stays in its alphabet."""
    return transducer(False)(text)


# -- look-alikes by the alphabet of their word ---------------------------------------------------------------------
_LATIN_OF = LOOKALIKES
_CYRILLIC_OF = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ӿ" and k not in "ЅІЈҮԚԜѕіјһԁԛԝӏ"}
_GREEK_OF = {v: k for k, v in LOOKALIKES.items() if "Ͱ" <= k <= "Ͽ" and k not in "ϲϳϹͿ"}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ]")


def _script(c: str) -> str:
    if "Ѐ" <= c <= "ԯ":
        return "C"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "G"
    return "L" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "-"


def _votes(word: str) -> dict[str, int]:
    """Letters that look like none of another alphabet, by alphabet."""
    votes = {"L": 0, "C": 0, "G": 0}
    for c in U.normalize("NFD", word):
        s = _script(c)
        if s == "-" or U.combining(c):
            continue
        if c not in (_LATIN_OF if s != "L" else _CYRILLIC_OF) and not (s == "L" and c in _GREEK_OF):
            votes[s] += 1
    return votes


def _to(word: str, script: str) -> str:
    out = []
    for c in U.normalize("NFD", word):
        s = _script(c)
        if s not in ("-", script) and not U.combining(c):
            latin = _LATIN_OF.get(c, c) if s != "L" else c
            c = latin if script == "L" else (_CYRILLIC_OF if script == "C" else _GREEK_OF).get(latin, c)
        out.append(c)
    return U.normalize("NFC", "".join(out))


def own_alphabet(text: str) -> str:
    """Look-alike letters of a text (as of widths) moved to the alphabet of their word, or else of the text."""
    if not _FOREIGN.search(text):
        return text
    total = {"L": 0, "C": 0, "G": 0}
    words = {}
    for w in set(_WORD.findall(text)):
        v = words[w] = _votes(w)
        for s in v:
            total[s] += v[s]
    main = max(total, key=lambda s: (total[s], s == "L"))
    if any("぀" <= c <= "鿿" for c in text) and main != "L" and total[main] < 3:
        main = "L"

    def put(m: re.Match) -> str:
        w = m[0]
        v = words[w]
        best = max(v, key=lambda s: (v[s], s == main))
        if v[best] == 0:
            used = {_script(c) for c in U.normalize("NFD", w) if not U.combining(c)} - {"-"}
            if used <= {"L"}:
                return w
            best = main
        return _to(w, best)

    return _WORD.sub(put, text)


# -- operators -----------------------------------------------------------------------------------------------------
def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _digests(texts: pd.Series) -> pd.DataFrame:
    """Digests of look and spelling; NULL for null and blank texts."""
    rows = [(_digest(s), _digest(t)) if t is not None and (s := skeleton(t)).strip() else (None, None) for t in texts]
    return pd.DataFrame(rows, columns=["look", "chars"])


def canonical_text(text: Column) -> Column:
    """The text in the one form; NULL stays NULL, empty stays empty, very long texts are rewritten whole."""
    return F.pandas_udf(lambda s: s.map(skeleton, na_action="ignore"), "string")(text)


def look_alike_pairs(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Pairs of records of one group whose whole texts look the same and are not the same characters.

    Result: group, id_a < id_b. Null and blank texts have no pairs; a record delivered twice counts once; an empty
    table gives no pairs. Rows whose look has only one spelling leave before the join, whatever their number; the join
    is on 128-bit digests of look and spelling, meets records of different spellings only, and a spelling with many
    records is split by Spark's skew join. Other columns of df, whatever their names, are not read.
    """
    # not deterministic: else the filter on the digests would compute them a second time
    kind = T.StructType([T.StructField("look", T.BinaryType()), T.StructField("chars", T.BinaryType())])
    d = F.pandas_udf(_digests, kind).asNondeterministic()(F.col(text))
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_id"), d.alias("_d"))
    rows = rows.select("_g", "_id", F.col("_d.look").alias("_look"), F.col("_d.chars").alias("_chars")).where(F.col("_look").isNotNull()).distinct()
    rows = cut(rows)  # digests and ids only: both readers below would else digest all texts again
    spelled = rows.groupBy("_g", "_look").agg(F.min("_chars").alias("_lo"), F.max("_chars").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    many = cut(rows.join(spelled.select("_g", "_look"), ["_g", "_look"], "left_semi"))
    # spellings of one look are paired first, then their records: no two records of one spelling ever meet
    spellings = many.select("_g", "_look", "_chars").distinct()
    other = spellings.select("_g", "_look", F.col("_chars").alias("_other"))
    met = spellings.join(other, ["_g", "_look"]).where(F.col("_chars") < F.col("_other"))
    one = many.join(met, ["_g", "_look", "_chars"]).select("_g", "_look", F.col("_other").alias("_chars"), F.col("_id").alias("_one"))
    pairs = one.join(many, ["_g", "_look", "_chars"]).where(F.col("_one") != F.col("_id"))
    return pairs.select(F.col("_g").alias(group), F.least("_one", "_id").alias("id_a"), F.greatest("_one", "_id").alias("id_b"))
