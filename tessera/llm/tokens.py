"""Encoding of a corpus with a public byte-level tokenizer, long texts by overlapping chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.nested import union_all
from tessera.runtime import cut

#: rank file of byte_bpe_50k; the folder is described in its README
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the vocabulary splits text before merging (fixed value of the vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 16_384
OVERLAP = 1_024
#: characters before a cut whose splits may depend on what follows it
_UNSURE = 4


@lru_cache(4)
def encoder(ranks_file: str = RANKS):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _splitter():
    return regex.compile(PATTERN)


def split_points(text: str, lo: int, hi: int, whole: bool) -> list[int]:
    """Starts of pre-tokens in [lo, hi); near the end of a text that is not whole they are left out."""
    hi = hi if whole else min(hi, len(text) - _UNSURE)
    return [m.start() for m in _splitter().finditer(text, 0) if lo <= m.start() < hi]


def _encode(ranks_file: str):
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks_file)
        return pd.Series([enc.encode_ordinary(t) if t else [] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<int>")


def _chunks(frames: Iterator[pd.DataFrame], size: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for key, text in zip(pdf["_id"], pdf["_text"]):
            # a last chunk within the overlap of the one before it is not needed
            starts = range(0, max(1, len(text) - overlap), size)
            yield pd.DataFrame(
                {"_id": key, "_chunk": range(len(starts)), "_start": starts, "_part": [text[s : s + size + overlap] for s in starts], "_whole": [s == starts[-1] for s in starts]}
            )


def _zones(frames: Iterator[pd.DataFrame], size: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Split points of each chunk in the zone it shares with the chunk before it and with the one after it."""
    for pdf in frames:
        head, tail = [], []
        for start, part, whole in zip(pdf["_start"], pdf["_part"], pdf["_whole"]):
            points = split_points(part, 0, size + overlap, whole)
            head.append([start + p for p in points if p < overlap - _UNSURE])
            # a piece must not end in blanks: how they split depends on what follows them
            tail.append([start + p for p in points if p >= size and not part[p - 1].isspace()])
        yield pdf.assign(_head=head, _tail=tail)[["_id", "_chunk", "_start", "_part", "_whole", "_head", "_tail"]]


_CHUNK_COLS = "_id bigint, _chunk int, _start bigint, _part string, _whole boolean"


def token_ids(df: DataFrame, key: str, text: str, ranks_file: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and ids, the token ids of each text without special tokens, as an ARRAY<INT>.

    Null and empty texts have an empty list; strings of special tokens are ordinary text; repeated rows stay repeated;
    an empty table gives no rows; other columns of df are not read. Decoding an id list concatenates the raw bytes of
    its tokens and gives the text back.

    Texts of at most `chunk` characters are encoded where they lie. Longer ones are cut into overlapping chunks that
    are pre-tokenised by any tasks. Splitting a text has no memory: where two neighbouring chunks share a split point
    in their overlap, they agree from there on. The first such point ends one piece and begins the next; the pieces
    are encoded independently and put together in order. Where an overlap has no shared point (one unbroken run of
    over `overlap` characters), the two chunks are one piece; the other pieces of the text stay as they are.
    """
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    long = F.length("_text") > chunk
    encode = _encode(ranks_file)
    short = rows.where(F.coalesce(~long, F.lit(True))).select("_id", encode("_text").alias("ids"))

    parts = rows.where(long).mapInPandas(lambda it: _chunks(it, chunk, overlap), _CHUNK_COLS).repartition("_id", "_chunk")
    zones = cut(parts.mapInPandas(lambda it: _zones(it, chunk, overlap), _CHUNK_COLS + ", _head array<bigint>, _tail array<bigint>"))
    once = zones.dropDuplicates(["_id", "_chunk"])
    # where the pieces begin and end is found without the texts
    order = Window.partitionBy("_id").orderBy("_chunk")
    met = once.select("_id", "_chunk", "_start", F.array_min(F.array_intersect("_head", F.lag("_tail").over(order))).alias("_at"))
    piece = F.sum(F.when(F.col("_at").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_piece")
    ends = F.coalesce(F.lead("_at").over(order), F.lead("_start").over(order)).alias("_end")
    cuts = met.select("_id", "_chunk", (F.coalesce("_at", "_start") - F.col("_start")).alias("_from"), (ends - F.col("_start")).alias("_to"), piece)
    own = F.expr("substr(_part, CAST(_from + 1 AS INT), CAST(coalesce(_to, length(_part)) - _from AS INT))")
    texts = once.select("_id", "_chunk", "_part").join(cuts, ["_id", "_chunk"]).select("_id", "_piece", "_chunk", own.alias("_own")).repartition("_id", "_piece")
    whole = lambda c, f: F.transform(F.array_sort(F.collect_list(F.struct(c, f))), lambda x: x[f])
    pieces = texts.groupBy("_id", "_piece").agg(F.array_join(whole("_chunk", "_own"), "").alias("_text")).select("_id", "_piece", encode("_text").alias("_ids"))
    joined = pieces.groupBy("_id").agg(F.flatten(whole("_piece", "_ids")).alias("ids"))
    # one id list a distinct long text; repeated rows take it again
    copies = zones.where(F.col("_chunk") == 0).select("_id")
    return union_all([short, copies.join(joined, "_id")]).withColumnRenamed("_id", key)


def token_count(text: Column, ranks_file: str = RANKS) -> Column:
    """Number of tokens of each text; 0 for null and empty ones."""

    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks_file)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, "bigint")(text)


def decode(ids: list[int], ranks_file: str = RANKS) -> str:
    return encoder(ranks_file).decode_bytes(list(ids)).decode("utf-8")
