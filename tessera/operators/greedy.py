"""Order-dependent operators: each works on one independent run or group, in order of position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.keys import packed_key
from tessera.functions.similarity import _ratio
from tessera.operators.runs import by_group, by_run, label_runs


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def merge_captions(obs: DataFrame, entity: str, interval: float, least_ratio: float = 0.9, dx: float = 0.15, dy: float = 0.12) -> DataFrame:
    """Observed captions as segments: an observation joins the best open segment (time gap at most 1.5 intervals, like
    text, near centre), else opens one. Needs pos BIGINT, t DOUBLE, text, cx, cy, confidence.

    Result: entity, start_sec, end_sec, text (the first longest), observations, confidence (mean). Runs with a larger
    time gap are independent, so each is one group.
    """
    rows = obs.where(F.col("t").isNotNull() & F.col("text").isNotNull()).select(entity, "t", "pos", "text", "cx", "cy", "confidence")
    runs = label_runs(rows, entity, ["t", "pos"], ["t"], lambda a, b: (b["t"] - a["t"]).astype(float) > 1.5 * interval)

    def run(rows: list[dict]) -> list[tuple]:
        groups: list[list[dict]] = []
        first = 0  # groups before it are too old to be joined
        for r in rows:
            while first < len(groups) and r["t"] - groups[first][-1]["t"] > 1.5 * interval:
                first += 1
            best, score = None, -1.0
            for g in groups[first:]:
                last = g[-1]
                if r["t"] - last["t"] <= 1.5 * interval and abs(r["cx"] - last["cx"]) <= dx and abs(r["cy"] - last["cy"]) <= dy:
                    like = _ratio(last["text"], r["text"], True)
                    if like >= least_ratio and like > score:
                        best, score = g, like
            if best is None:
                groups.append([r])
            else:
                best.append(r)
        known = lambda g: [x["confidence"] for x in g if x["confidence"] is not None and x["confidence"] == x["confidence"]]
        return [(g[0][entity], g[0]["t"], g[-1]["t"] + interval, max((x["text"] for x in g), key=len), len(g), sum(known(g)) / len(known(g)) if known(g) else None) for g in groups]

    return by_run(runs, entity, ["t", "pos"], run, f"{entity} string, start_sec double, end_sec double, text string, observations int, confidence double")


def suppress_near(df: DataFrame, entity: str, value: str, time: str, rank: list[str], within: float = 0.25) -> DataFrame:
    """Of rows with one value closer than `within` seconds the one with the higher rank stays (ties: earlier, then
    smaller pos). Runs of near rows are independent. Needs pos BIGINT."""
    cols = df.columns
    keyed = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).withColumn("_key", packed_key([F.col(entity).cast("string"), F.col(value).cast("string")]))
    runs = label_runs(keyed, "_key", [time, "pos"], [time], lambda a, b: (b[time] - a[time]).astype(float) > within)

    def run(rows: list[dict]) -> list[tuple]:
        if len(rows) == 1:
            return [tuple(rows[0][c] for c in cols)]
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (*(-r[x] for x in rank), r[time], r["pos"])):
            if all(abs(r[time] - k[time]) > within for k in kept):
                kept.append(r)
        return [tuple(r[c] for c in cols) for r in kept]

    return by_run(runs, "_key", [time, "pos"], run, _ddl(df))


def match_in_order(left: DataFrame, right: DataFrame, entity: str, tolerance: float = 1.75) -> DataFrame:
    """Monotone nearest matching: each left event takes the nearest right event not used yet and later in order than
    the last one taken, within the tolerance: entity, left_pos, right_pos, gap. Needs pos BIGINT and t DOUBLE.

    Both timelines are cut where no event follows within the tolerance: no match crosses such a cut.
    """
    side = lambda d, s: d.where(F.col("t").isNotNull()).select(entity, "t", (F.col("pos") * 2 + s).cast("bigint").alias("tag"))
    both = side(left, 0).unionByName(side(right, 1))
    runs = label_runs(both, entity, ["t", "tag"], ["t"], lambda a, b: (b["t"] - a["t"]).astype(float) > tolerance)

    def run(rows: list[dict]) -> list[tuple]:
        lefts = [(r["t"], r["tag"] // 2) for r in rows if r["tag"] % 2 == 0]
        rights = [(r["t"], r["tag"] // 2) for r in rows if r["tag"] % 2]
        at, out = 0, []
        for t, p in lefts:
            while at < len(rights) and rights[at][0] < t - tolerance:
                at += 1
            best, i = None, at
            while i < len(rights) and rights[i][0] <= t + tolerance:
                gap = abs(rights[i][0] - t)
                best = (gap, i) if best is None or gap < best[0] else best
                i += 1
            if best is not None:
                out.append((rows[0][entity], p, rights[best[1]][1], best[0]))
                at = best[1] + 1
        return out

    return by_run(runs, entity, ["t", "tag"], run, f"{entity} string, left_pos bigint, right_pos bigint, gap double")


def span_capped_groups(df: DataFrame, entity: str, gap: float = 0.45, span: float = 8.0) -> DataFrame:
    """df with group_no inside its run: segments of one speaker with gaps up to `gap`, cut so that no group is longer
    than `span` seconds. Needs pos BIGINT, speaker, start_sec, end_sec."""
    rows = df.where(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull())
    runs = label_runs(
        rows.select(entity, "start_sec", "pos", "speaker", "end_sec"), entity, ["start_sec", "pos"], ["speaker", "start_sec", "end_sec"],
        lambda a, b: ((b["start_sec"] - a["end_sec"]).astype(float) > gap) | (a["speaker"] != b["speaker"]),
    )

    def run(rows: list[dict]) -> list[tuple]:
        no, begin, out = -1, None, []
        for r in rows:
            if begin is None or r["end_sec"] - begin > span:
                no, begin = no + 1, r["start_sec"]
            out.append((r[entity], r["start_sec"], r["pos"], r["speaker"], r["end_sec"], r["run_start"], no))
        return out

    return by_run(runs, entity, ["start_sec", "pos"], run, f"{entity} string, start_sec double, pos bigint, speaker string, end_sec double, run_start bigint, group_no int")


def keep_uncovered(df: DataFrame, group: list[str], text: str, least: float = 0.72) -> DataFrame:
    """Order-preserving semantic de-duplication inside a blocking group: a row is dropped if an earlier kept row covers
    it or is covered by it (one text holds the other, or block ratio at least `least`). Needs pos."""
    cols = df.columns

    def run(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in rows:
            t = r[text] or ""
            if not any(t in (k[text] or "") or (k[text] or "") in t or _ratio(k[text] or "", t, False) >= least for k in kept):
                kept.append(r)
        return [tuple(r[c] for c in cols) for r in kept]

    return by_group(df, group, ["pos"], run, _ddl(df))


def spatially_distinct(df: DataFrame, group: list[str], rank: list[str], most: int = 3, dx: float = 0.15, dy: float = 0.12) -> DataFrame:
    """Greedy non-maximum suppression: the best `most` rows of a group without two of equal text and near centre."""
    cols = df.columns

    def run(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (*(-r[x] for x in rank), r["pos"])):
            if len(kept) == most:
                break
            if not any(k["text"] == r["text"] and abs(k["cx"] - r["cx"]) <= dx and abs(k["cy"] - r["cy"]) <= dy for k in kept):
                kept.append(r)
        return [tuple(r[c] for c in cols) for r in kept]

    return by_group(df, group, ["pos"], run, _ddl(df))
