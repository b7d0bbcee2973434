"""Dialogue in free text: who is to say what, and when; constraints; and where it is heard."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.similarity import passes_anchor_gates, semi_global
from tessera.functions.textops import compact_text
from tessera.operators.contracts import first_wins

_QUOTE = re.compile(r"“([^”]{1,400})”|\"([^\"\n]{1,400})\"|「([^」]{1,400})」")
_NAME = r"(?:图\s*\d+\s*[里中]?的?)?[一-鿿]{1,10}|(?:the|The|an?|A)\s[a-z][\w\-]*(?:\s[a-z][\w\-]*){0,3}?|[A-Z][\w'’\-]*(?:\s[A-Z][\w'’\-]*){0,3}|[Ss]peaker\s?\d+|角色\s?[A-Z\d]+"
_SAYS = r"(?:[^，,。；;：:“\"「\n]{0,8}?)(?:说道|说|问道|问|答道|回答|喊道|喊|低声说|道|念|唱|says?|said|asks?|replies|whispers?|shouts?|yells?)"
#: forms of an introduction right before a quote, the closest first
_INTRO = (re.compile(rf"({_NAME})\s*{_SAYS}\s*[，,：:]?\s*$"), re.compile(rf"({_NAME})\s*[：:]\s*$"))
_RANGE = re.compile(r"(\d+(?:\.\d+)?)\s*(?:s|秒)?\s*[-–—~至到]\s*(\d+(?:\.\d+)?)\s*(?:s|秒)")
_CLOSED = re.compile(r"只有以上|没有其他(?:台词|对白)|除此之外(?:不|没)|no other (?:speech|dialogue|lines)", re.IGNORECASE)
_LEAD = re.compile(r"^(?:然后|接着|这时|随后|最后|此时|于是|the|The|an?|A)\s*")
_TURNS = "array<struct<turn:int,role:string,dialogue:string,start:int,end:int,start_sec:double,end_sec:double>>"


def mine_turns(text: str | None, role_window: int = 220, time_window: int = 900) -> list[tuple]:
    """(turn from 1, role or None, dialogue, start, end, start_sec, end_sec) of each quote, positions from 0."""
    out = []
    for m in _QUOTE.finditer(text or ""):
        before = text[max(0, m.start() - role_window) : m.start()]
        clause = re.split(r"[。！？!?\n；;”\"」]", before)[-1]
        hit = next((h for p in _INTRO if (h := p.search(clause))), None)
        role = _LEAD.sub("", hit[1]).strip() or None if hit else None
        times = _RANGE.findall(text[max(0, m.start() - time_window) : m.start()])
        a, b = map(float, times[-1]) if times else (None, None)
        k = next(i for i in (1, 2, 3) if m[i] is not None)
        out.append((len(out) + 1, role, m[k].strip(), m.start(k), m.end(k), a, b))
    return out


def speech_plan(text: Column) -> Column:
    """STRUCT(scope, turns): scope 'none' without quotes, 'closed' where the text rules out other speech, else
    'partial'; NULL texts have no turns."""

    def run(s: pd.Series) -> pd.DataFrame:
        names = ("turn", "role", "dialogue", "start", "end", "start_sec", "end_sec")
        turns = [[dict(zip(names, t)) for t in mine_turns(x)] for x in s]
        scope = ["none" if not t else "closed" if _CLOSED.search(x) else "partial" for x, t in zip(s, turns)]
        return pd.DataFrame({"scope": scope, "turns": turns})

    return F.pandas_udf(run, f"scope string, turns {_TURNS}")(text)


def media_constraints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stated resolutions and durations: key, kind, mode ('exact', 'minimum', 'maximum'), value; the first mention of
    each kind and mode counts. Mentions behind a negation are none."""
    no = r"(?<!\d)(?<!不要)(?<!无需)(?<!not )"
    patterns = (
        ("resolution", "exact", rf"(?i){no}(\d{{3,4}})p\b"), ("resolution", "exact", rf"(?i){no}\d{{3,4}}\s*[x×*]\s*(\d{{3,4}})"),
        ("duration", "minimum", r"(?i)(?:至少|不少于|at least)\s*(\d+(?:\.\d+)?)\s*(?:s\b|秒|seconds?)"), ("duration", "maximum", r"(?i)(?:不超过|最多|at most|no longer than)\s*(\d+(?:\.\d+)?)\s*(?:s\b|秒|seconds?)"),
        ("duration", "exact", r"(?i)(?:时长|片长|duration|length)(?:为|是|of|:|：)?\s*(\d+(?:\.\d+)?)\s*(?:s\b|秒|seconds?)"),
    )
    def mentions(kind: str, mode: str, pattern: str, rank: int) -> Column:
        one = lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), v.cast("double").alias("value"), F.lit(rank).alias("rank"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), one)

    found = F.flatten(F.array(*[mentions(k, m, p, n) for n, (k, m, p) in enumerate(patterns)]))
    rows = df.select(key, F.posexplode(F.coalesce(found, F.array().cast("array<struct<kind:string,mode:string,value:double,rank:int>>"))).alias("pos", "c")).select(key, "pos", "c.*")
    return first_wins(rows.select(key, "kind", "mode", "pos", "value"), [key, "kind", "mode"], "pos").select(key, "kind", "mode", "value")


def may_hold(query: Column, target: Column, edits: int = 4) -> Column:
    """Lossless screen for a place of query in target with at most `edits` edits: of edits + 1 pieces of the query one
    must stand in the target unchanged."""
    n = F.length(query)
    step = F.greatest(F.lit(1), F.floor(n / (edits + 1)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.substring(query, i * step + 1, step))
    return (n > 0) & F.exists(pieces, lambda p: (p != "") & F.contains(target, p))


def anchors(segments: DataFrame, prompts: DataFrame, on: str, seg_id: str) -> DataFrame:
    """Segments whose words stand in their prompt, nearly or exactly: seg_id, edits, start, end (in the normalised
    prompt), similarity. segments: on, seg_id, text; prompts: on (unique), prompt."""
    pairs = segments.select(on, seg_id, compact_text(F.col("text")).alias("q")).join(prompts.select(on, compact_text(F.col("prompt")).alias("p")), on)
    near = pairs.where((F.length("q") >= 5) & may_hold(F.col("q"), F.col("p"))).withColumn("m", semi_global(F.col("q"), F.col("p")))
    return near.where(passes_anchor_gates(F.col("q"), F.col("m"))).select(seg_id, "m.edits", "m.start", "m.end", "m.similarity")


# Words of speech before a colon, and the bounds of windows and of the list of candidates.
CUES = ("说", "说道", "说到", "道", "问", "问道", "回答", "喊", "喊道", "大喊", "高喊", "急喊", "低声说", "大声说")
WINDOW_SEGMENTS, WINDOW_LETTERS, LEAST_LETTERS, MOST_CANDIDATES = 3, 72, 5, 12
_ANCHOR = "first_seg bigint, last_seg bigint, width int, sequence int, observed string, expected string, similarity double, edits int, place int, start_sec double, differences array<struct<kind:string,observed:string,expected:string,observed_start:int,observed_end:int,expected_start:int,expected_end:int>>"


def is_cue_artifact(observed: Column, expected: Column, differences: Column) -> Column:
    """Whether all that differs is a word of speech that stands in the prompt before the line and was never spoken."""
    cue = F.coalesce(*[F.when(expected.startswith(c), F.lit(c)) for c in sorted(CUES, key=len, reverse=True)])
    body = F.substring(expected, F.length(cue) + 1, F.length(expected))
    early = F.forall(differences, lambda d: (d["expected_end"] <= F.length(cue)) & (d["observed_end"] <= F.greatest(F.length(cue), F.lit(1))))
    return F.coalesce((F.length(body) >= LEAST_LETTERS) & observed.endswith(body) & (F.size(differences) > 0) & early, F.lit(False))


def _chosen(rows: list[dict]) -> list[tuple]:
    """The anchors of one clip: single segments first; then, in order, for each segment that has none the best window
    around it that shows a difference not seen yet, or none at all."""
    fields = ("first_seg", "last_seg", "width", "sequence", "observed", "expected", "similarity", "edits", "place", "start_sec", "differences")
    seen, placed, taken, out = set(), set(), set(), []
    mark = lambda r: {(d["kind"], r["place"] + d["expected_start"], r["place"] + d["expected_end"], d["observed"], d["expected"]) for d in r["differences"]}

    def take(r: dict) -> None:
        seen.update(mark(r))
        placed.update(range(r["sequence"], r["sequence"] + r["width"]))
        out.append((r["_clip"], *(r[f] for f in fields)))

    for r in rows:
        if r["width"] == 1:
            take(r)
    windows = [r for r in rows if r["width"] > 1]
    around: dict[int, list[dict]] = {}
    for r in windows:
        for k in range(r["sequence"], r["sequence"] + r["width"]):
            around.setdefault(k, []).append(r)
    for k in sorted(around):
        fit = [r for r in around[k] if (r["sequence"], r["width"]) not in taken and not (mark(r) and mark(r) <= seen)]
        if k not in placed and fit:
            best = max(fit, key=lambda r: (r["similarity"], len(r["observed"]), -r["edits"], -r["width"], -r["sequence"]))
            taken.add((best["sequence"], best["width"]))
            take(best)
    return out


def prompt_candidates(segments: DataFrame, prompts: DataFrame, on: str, seg_id: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """Where the speech of a clip stands in its prompt, and what was said otherwise: on, first_seg, last_seg, observed,
    expected, similarity, edits, differences, status.

    Two passes: segments by themselves, then windows of two or three neighbours for segments left over. status is
    'matched' without a difference, 'cue' where only a word of speech of the prompt is missing, 'candidate' for the best
    `most` others of a clip by likeness, length and time, 'further' for the rest. segments: on, seg_id, start_sec,
    end_sec, speaker, text; prompts: on (unique), prompt. Segments without a start have no place and no window; null
    texts count as empty. Alignment runs on windows anywhere in the cluster behind a lossless screen; only what passes
    the gates meets in the choice, one clip at a time.
    """
    from tessera.functions.similarity import block_differences
    from tessera.functions.textops import folded_with_offsets
    from tessera.operators.runs import by_group, compatible_neighbours, numbered, windows

    fold = lambda c: F.coalesce(folded_with_offsets(c)["text"], F.lit(""))
    own = segments.where(F.col(on).isNotNull() & F.col("start_sec").isNotNull()).select(F.col(on).alias("_clip"), F.col(seg_id).cast("bigint").alias("_seg"), "start_sec", "end_sec", "speaker", fold(F.col("text")).alias("_w"))
    rows = numbered(own, "_clip", ["start_sec", "_seg"])
    text = prompts.select(F.col(on).alias("_clip"), fold(F.col("prompt")).alias("_p"))
    parts = []
    for width in range(1, WINDOW_SEGMENTS + 1):
        w = windows(rows, "_clip", "sequence", width, ["_seg", "start_sec", "end_sec", "speaker", "_w"])
        for k in range(1, width):
            w = w.where(compatible_neighbours(F.col("window")[k - 1], F.col("window")[k]))
        parts.append(w.select("_clip", F.col("window")[0]["_seg"].alias("first_seg"), F.col("window")[width - 1]["_seg"].alias("last_seg"), F.lit(width).alias("width"), F.col("pos").cast("int").alias("sequence"), F.array_join(F.transform("window", lambda x: x["_w"]), "").alias("observed"), F.col("window")[0]["start_sec"].alias("start_sec")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sized = every.where(F.length("observed").between(LEAST_LETTERS, WINDOW_LETTERS)).join(text, "_clip")
    near = sized.where(may_hold(F.col("observed"), F.col("_p"))).withColumn("m", semi_global(F.col("observed"), F.col("_p")))
    hit = near.where(passes_anchor_gates(F.col("observed"), F.col("m")) & (F.col("m.end") - F.col("m.start") >= LEAST_LETTERS))
    hit = hit.withColumn("expected", F.substring(F.col("_p"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")))
    hit = hit.select("_clip", "first_seg", "last_seg", "width", "sequence", "observed", "expected", "m.similarity", "m.edits", F.col("m.start").alias("place"), "start_sec", block_differences(F.col("observed"), F.col("expected")).alias("differences"))
    chosen = by_group(hit, ["_clip"], ["sequence", "width"], _chosen, f"_clip string, {_ANCHOR}")
    cue = is_cue_artifact(F.col("observed"), F.col("expected"), F.col("differences"))
    out = chosen.withColumn("status", F.when(F.size("differences") == 0, "matched").when(cue, "cue").otherwise("candidate"))
    rank = F.struct((-F.col("similarity")).alias("a"), (-F.length("observed")).alias("b"), F.col("start_sec").alias("c"), F.col("first_seg").alias("d"))
    best = out.where("status = 'candidate'").groupBy("_clip").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, most).alias("_best"))
    out = out.join(best, "_clip", "left").withColumn("status", F.when((F.col("status") == "candidate") & ~F.array_contains("_best", rank), "further").otherwise(F.col("status")))
    return out.select(F.col("_clip").alias(on), "first_seg", "last_seg", "observed", "expected", "similarity", "edits", "differences", "status")


def likelihood_decision(observed: Column, expected: Column, same_sound: Column, delta: float = 0.70) -> Column:
    """'failed' without both scores, 'homophone', or which reading is preferred by more than delta, else 'ambiguous'."""
    lead = expected - observed
    return (
        F.when(observed.isNull() | expected.isNull() | F.isnan(observed) | F.isnan(expected), "failed").when(F.coalesce(same_sound, F.lit(False)), "homophone")
        .when(lead > delta, "expected_preferred").when(lead < -delta, "observed_preferred").otherwise("ambiguous")
    )


def likelihood_ratio(observed: Column, expected: Column, most: float = 50.0) -> Column:
    lead = expected - observed
    return F.when(lead.isNotNull(), F.exp(F.least(F.lit(most), F.greatest(F.lit(-most), lead))))


