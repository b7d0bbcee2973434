"""Requirements on a medium that free text states, and their check against measured facts; gates of verified candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geometry import duration_within, resolution_meets
from tessera.operators.contracts import first_wins

# ---- Fixed values: forms and word lists -----------------------------------------------------------------------------
NAMED_SIZE = re.compile(r"(?<!\d)(720p|1080p|1440p|2160p|2k|4k|8k)(?!\d)", re.IGNORECASE)
STATED_SIZE = re.compile(r"(?<!\d)(\d{3,5})\s*[xX×*]\s*(\d{3,5})(?!\d)")
SIZES = {"720p": (720, 1280), "1080p": (1080, 1920), "1440p": (1440, 2560), "2k": (1440, 2560), "2160p": (2160, 3840), "4k": (2160, 3840), "8k": (4320, 7680)}
REQUIRES = ("输出", "直出", "生成", "成片", "视频", "分辨率", "清晰度", "画质", "规格", "达到", "达不到", "要求", "至少", "最低", "不低于", "客户")
NOT_REQUIRED = ("不需要", "无需", "无须", "不要求", "不必", "不用", "不采用", "禁止")
REFERENCE = ("参考图", "参考视频", "原视频", "输入素材")
RESULT = ("输出", "直出", "生成", "成片", "达到", "要求")
CLAUSE_ENDS = "，。；！？\n"
NEGATION_WINDOW = 20
_SEC = r"(\d+(?:\.\d+)?)\s*(?:秒|s\b)"
WHOLE_LENGTH = re.compile(rf"(?:总时长|视频总时长|视频时长|成片时长|视频总长)\s*(?:要求|需要|应当|应|为|是|达到|保持|[:：=]){{0,3}}\s*{_SEC}", re.IGNORECASE)
MADE_LENGTH = re.compile(rf"(?:生成|制作|输出)\s*(?:一个|一段|一条)?\s*(?:时长(?:为|是|[:：=])?\s*)?{_SEC}\s*(?:的)?\s*视频", re.IGNORECASE)
SHOT_LENGTH = re.compile(rf"镜头\s*(\d+)\s*[:：]?\s*(?:时长\s*(?:为|是|[:：=])?\s*)?(?:持续\s*)?{_SEC}", re.IGNORECASE)
AT_LEAST, AT_MOST = ("至少", "不低于"), ("最多", "不超过")

_CONSTRAINT = "struct<kind:string,mode:string,short_side:int,long_side:int,seconds:double,scope:string,field:string,clause:string>"


def clause_around(text: str, start: int, end: int) -> tuple[str, int]:
    """The clause around text[start:end], trimmed, and where the match stands in it."""
    left = max(text.rfind(c, 0, start) for c in CLAUSE_ENDS) + 1
    right = min((at for c in CLAUSE_ENDS if (at := text.find(c, end)) >= 0), default=len(text))
    raw = text[left:right]
    return raw.strip(), max(0, start - left - (len(raw) - len(raw.lstrip())))


def required_size(clause: str, at: int) -> bool:
    """Whether the size at a place of the clause is asked of the result: not denied just before, not only that of a
    reference, and with a word of requirement."""
    compact = "".join(clause.casefold().split())
    if any(w in clause[max(0, at - NEGATION_WINDOW) : at].casefold() for w in NOT_REQUIRED):
        return False
    if any(w in compact for w in REFERENCE) and not any(w in compact for w in RESULT):
        return False
    return any(w in compact for w in REQUIRES)


def _stated(field: str, text: str) -> Iterator[tuple]:
    sizes = [(m, SIZES[m[1].lower()]) for m in NAMED_SIZE.finditer(text)] + [(m, tuple(sorted(map(int, m.groups())))) for m in STATED_SIZE.finditer(text)]
    for m, (short, long) in sizes:
        clause, at = clause_around(text, *m.span())
        if required_size(clause, at):
            yield "resolution", "minimum", short, long, None, None, field, clause
    shots = list(SHOT_LENGTH.finditer(text))
    lengths = [("whole", m, m[1]) for m in WHOLE_LENGTH.finditer(text)] + [("made", m, m[1]) for m in MADE_LENGTH.finditer(text)]
    # lengths of shots are the length of the whole only where there is one shot
    lengths += [("shot", m, m[2]) for m in shots] if len({m[1] for m in shots}) == 1 else []
    for scope, m, seconds in lengths:
        if float(seconds) > 0:
            clause = clause_around(text, *m.span())[0]
            compact = "".join(clause.casefold().split())
            mode = "minimum" if any(w in compact for w in AT_LEAST) else "maximum" if any(w in compact for w in AT_MOST) else "exact"
            yield "duration", mode, None, None, float(seconds), scope, field, clause


def stated_constraints(fields: dict[str, Column]) -> Column:
    """ARRAY of the requirements on resolution and duration that the texts state, field by field in the given order:
    kind, mode, short_side and long_side or seconds, scope, field, clause. NULL and empty texts state none."""
    names = [f.split(":")[0] for f in _CONSTRAINT[7:-1].split(",")]
    where = list(fields)

    def run(*texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, c)) for f, t in zip(where, row) if t for c in _stated(f, t)] for row in zip(*texts)])

    return F.pandas_udf(run, f"array<{_CONSTRAINT}>")(*fields.values())


def constraints_of(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key and its distinct requirements, the first mention of each: equal sizes are one, equal mode and seconds are."""
    rows = df.select(key, F.posexplode(stated_constraints(fields)).alias("pos", "c")).select(key, "pos", "c.*")
    return first_wins(rows, [key, "kind", "mode", "short_side", "long_side", "seconds"], "pos")


def check_constraints(df: DataFrame, key: str, fields: dict[str, Column], width: Column, height: Column, duration: Column) -> DataFrame:
    """Status of each row of df against its own requirements: key, kind, mode, short_side, long_side, seconds, scope,
    field, clause, status.

    status is 'met', 'missed', or 'not_evaluable' where the fact is missing; a row without requirements has one row of
    status 'not_requested'. What is not measured is never a miss."""
    facts = df.select(key, width.alias("_w"), height.alias("_h"), duration.alias("_d"))
    rows = facts.join(constraints_of(df, key, fields).drop("pos"), key, "left")
    sized = resolution_meets(F.nullif("_w", F.lit(0)), F.nullif("_h", F.lit(0)), F.col("short_side"), F.col("long_side"))
    timed = F.when(F.col("_d") > 0, duration_within(F.col("_d"), F.col("seconds"), F.col("mode")))
    holds = F.when(F.col("kind") == "resolution", F.when(F.col("_w").isNotNull() & F.col("_h").isNotNull(), sized)).otherwise(timed)
    status = F.when(F.col("kind").isNull(), "not_requested").when(holds.isNull(), "not_evaluable").when(holds, "met").otherwise("missed")
    return rows.withColumn("status", status).drop("_w", "_h", "_d")


def gated_by_verdicts(candidates: DataFrame, settled: DataFrame, verdicts: DataFrame, key: str, verified: Column) -> DataFrame:
    """What stays when candidates are verified: all settled rows, and candidates found supported. Where the verifier
    failed (`verified` is not true), or gave no verdict, a candidate is abstained from, never dropped as wrong: rows of
    both tables with `outcome` ('settled', 'supported', 'contradicted', 'inconclusive', 'not_verified')."""
    first = first_wins(verdicts.select(key, "pos", "verdict"), [key], "pos").select(key, "verdict")
    judged = candidates.join(first, key, "left")
    outcome = F.when(~F.coalesce(verified, F.lit(False)), "not_verified").when(F.col("verdict").isin("supported", "contradicted"), F.col("verdict")).otherwise("inconclusive")
    return settled.withColumn("outcome", F.lit("settled")).unionByName(judged.withColumn("outcome", outcome).drop("verdict"))
