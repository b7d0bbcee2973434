"""Several values packed in one field: delimiter skeletons, one splitting rule a skeleton, positional extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.runtime import cut

#: characters of an unquoted value beside letters, marks and digits
PLAIN = r"/:._\-%?=&"
_ORDINARY = rf"[\p{{L}}\p{{M}}\p{{N}}{PLAIN}]+"
#: characters that can open, close or escape; all others only divide
_MARKS = "\"'“”‘’\\\\\\[\\]"
#: where one token ends and the next begins: around every mark; a backslash before what is no mark is part of a run
_SIGNS = _MARKS.replace("\\\\", "", 1)
_EDGE = rf"(?=[{_SIGNS}]|\\(?:[{_MARKS}]|\z))|(?<=[{_SIGNS}])|(?<=\\)(?=\\)"
#: symbols of runs: by whether they begin and end with an ordinary character; a comma has none at all
_STARTS, _ENDS, _RUNS = "xb", "xc", "xbcd,"
#: rules of more text than this are not broadcast but joined by the skeleton
MAX_RULE_CHARS = 4_000_000

_CLOSE = {'"': '"', "'": "'", "“": "”", "‘": "’"}
RAW, ESCAPED, DOUBLED, TWICE, CSV_JSON, CURLY, RAW_LISTED = range(7)
_RULE = "array<struct<f:int,t:int,m:int>>"


def _list_items(sym: list[tuple[str, int, int]], mode: int) -> list[tuple[int, int, int]] | None:
    """Items of a printed list; sym holds (symbol, first token, token after) without the outer brackets."""
    out, i = [], 0
    while i < len(sym):
        c = sym[i][0]
        if c in _CLOSE:
            j = i + 1
            while j < len(sym) and sym[j][0] != _CLOSE[c]:
                j += 2 if sym[j][0] == "\\" else 1
            if j >= len(sym):
                return None
            out.append((sym[i][2], sym[j][1], mode))
            i = j + 1
        elif c == "\\":  # it escapes a mark; what it escapes in a run, as a line break, is part of the run
            i += 1 if sym[i + 1 : i + 2] and sym[i + 1][0] in _RUNS else 2
        else:
            if c in "xbcd":
                out.append((sym[i][1], sym[i][2], RAW_LISTED))
            i += 1
    return out


def resolve(skeleton: str) -> list[tuple[int, int, int]]:
    """Token ranges (from, to, mode) of the values of one skeleton, a string of one symbol a token: x, b, c or d for a
    run with ordinary characters, a comma for a run of dividers, quotes, backslashes and square brackets as themselves.
    A range of a raw mode is one run, which holds one value or, divided, several."""
    n = len(skeleton)
    lo, hi = n - len(skeleton.lstrip(",")), len(skeleton.rstrip(","))
    body = skeleton[lo:hi]
    flat = [(c, lo + i, lo + i + 1) for i, c in enumerate(body)]
    inner = body[1:-1].strip(",")
    if len(body) >= 4 and body[0] == '"' and body[-1] == '"' and inner[:1] == "[" and inner[-1:] == "]":
        # a list printed into a string: undo the string's own escapes first
        csv = '\\"' not in inner and '""' in inner
        sym, i = [], 1
        while i < len(flat) - 1:
            c = flat[i][0]
            if i + 1 < len(flat) - 1 and (csv and c == '"' and flat[i + 1][0] == '"' or not csv and c == "\\" and flat[i + 1][0] in '"\\'):
                sym.append((flat[i + 1][0], flat[i][1], flat[i + 1][2]))
                i += 2
            else:
                sym.append(flat[i])
                i += 1
        while sym and sym[0][0] == ",":
            sym.pop(0)
        while sym and sym[-1][0] == ",":
            sym.pop()
        got = _list_items(sym[1:-1], CSV_JSON if csv else TWICE)
        if got is not None:
            return got
    if len(body) >= 2 and body[0] == "[" and body[-1] == "]":
        got = _list_items(flat[1:-1], ESCAPED)
        if got is not None:
            return got
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c in "xbcd":
            out.append((lo + i, lo + i + 1, RAW))
        elif c in _CLOSE and (i == 0 or body[i - 1] not in _ENDS):
            j, q = i + 1, _CLOSE[c]
            while j < len(body):
                if body[j] == "\\" and c in "\"'":
                    j += 2
                elif body[j] == q and c == '"' and body[j + 1 : j + 2] == '"':
                    j += 2
                elif body[j] == q and (c != "'" or j + 1 == len(body) or body[j + 1] not in _STARTS):
                    break
                else:
                    j += 1
            if j < len(body):
                out.append((lo + i + 1, lo + j, DOUBLED if c in "\"'" else CURLY))
                i = j
        i += 1
    return out


def tokens(cell: Column) -> Column:
    return F.split(cell, _EDGE, -1)


def skeleton(cell: Column) -> Column:
    """One symbol a token: ordinary characters are masked, and so is how many values and escapes a run holds, so that
    skeletons tell quotes, escapes of quotes and brackets only."""
    out = F.regexp_replace(cell, _ORDINARY, "x")
    out = F.regexp_replace(out, f"[^x{_MARKS}]+", ",")
    out = F.regexp_replace(out, r"\\(?=[x,])", "e")
    edge, end = "(?<![x,e])", "(?![x,e])"
    for run, symbol in (("x(?:[x,e]*x)?", "x"), ("x[x,e]*[,e]", "b"), ("[,e][x,e]*x", "c"), ("[,e][x,e]*x[x,e]*[,e]", "d"), ("[,e]+", ",")):
        out = F.regexp_replace(out, f"{edge}{run}{end}", symbol)
    return out


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"_skeleton": pdf["_skeleton"], "_rule": [[{"f": f, "t": t, "m": m} for f, t, m in resolve(s)] for s in pdf["_skeleton"]]})


def _unjson(v: Column) -> Column:
    """Backslash escapes of JSON and of printed Python strings."""
    quoted = F.regexp_replace(v, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    quoted = F.regexp_replace(quoted, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    opts = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    done = F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>", opts)[0]
    return F.when(F.instr(v, "\\") == 0, v).otherwise(F.coalesce(done, v))


def _values(r: Column) -> Column:
    """The values of one range of tokens: those of a raw run, or the one that was quoted."""
    # an empty quoted value has f = t
    raw = F.when(r["t"] > r["f"], F.array_join(F.slice(F.col("_tokens"), r["f"] + 1, r["t"] - r["f"]), "")).otherwise(F.lit(""))
    csv = F.regexp_replace(F.regexp_replace(raw, '""', '"'), r"\\(['\"])", "$1")
    value = (
        F.when(r["m"] == ESCAPED, _unjson(raw))
        .when(r["m"] == DOUBLED, csv)
        .when(r["m"] == TWICE, _unjson(_unjson(raw)))
        .when(r["m"] == CSV_JSON, _unjson(F.regexp_replace(raw, '""', '"')))
        .otherwise(raw)
    )
    value = F.regexp_replace(value, r"^[\s\p{Z}\x{feff}\x{200b}]+|[\s\p{Z}\x{feff}\x{200b}]+$", "")
    bare = F.when(r["m"] == RAW_LISTED, F.regexp_replace(raw, rf"\\{_ORDINARY}", " ")).otherwise(raw)
    found = F.filter(F.regexp_extract_all(bare, F.lit(f"({_ORDINARY})"), F.lit(1)), lambda v: ~F.lower(v).isin("null", "none"))
    return F.when(r["m"].isin(RAW, RAW_LISTED), found).otherwise(F.array(value))


def split_packed(df: DataFrame, key: str, cell: str, max_rule_chars: int = MAX_RULE_CHARS) -> DataFrame:
    """One row for each value packed in a cell: key, pos (INT from 1), ref_value.

    Values are trimmed, without quotes and escapes. Null and blank cells, blank values and the words null and none
    outside quotes give no row and take no position; repeated values keep theirs; a quote that never closes only
    divides. Rows repeated with equal key and cell count once. Very long cells are only longer token arrays. Other
    columns of df, whatever their names, are not read. An empty table gives no rows.

    The splitting rules, one a distinct skeleton, are broadcast while their text is within max_rule_chars, and joined
    by the skeleton beyond it (a skeleton of very many rows is split by the join's own skew handling).
    """
    rows = df.where(F.col(cell).rlike(r"[\p{L}\p{M}\p{N}" + PLAIN + r"]")).select(F.col(key).alias("_key"), F.col(cell).alias("_cell")).distinct()
    shaped = rows.select("_key", tokens(F.col("_cell")).alias("_tokens"), skeleton(F.col("_cell")).alias("_skeleton"))
    # the distinct skeletons are found from the raw table: copies change nothing
    shapes = df.where(F.col(cell).rlike(r"[\p{L}\p{M}\p{N}" + PLAIN + r"]")).select(skeleton(F.col(cell)).alias("_skeleton")).distinct()
    rules = cut(shapes.mapInPandas(_rules, f"_skeleton string, _rule {_RULE}"))
    size = rules.agg(F.sum(F.length("_skeleton") + 12 * F.size("_rule"))).first()[0] or 0
    ruled = shaped.join(F.broadcast(rules) if size <= max_rule_chars else rules.hint("merge"), "_skeleton")
    values = F.filter(F.flatten(F.transform(F.col("_rule"), _values)), lambda v: v != "")
    return ruled.select(F.col("_key").alias(key), F.posexplode(values).alias("_pos", "ref_value")).select(
        key, (F.col("_pos") + 1).cast("int").alias("pos"), "ref_value"
    )
