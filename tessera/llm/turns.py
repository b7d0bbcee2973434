"""Speech transcripts into clean speaker turns.

Gradient-boosted trees decide whether a turn begins between two neighbouring kept segments, from their labels, the gap
and their context. They are fitted on pairs of the table at hand (a bounded sample) and then, as what a boundary is has
an exact definition, proved: every cell that the trees' thresholds cut out of the feature space is compared with the
definition, and cells in which they differ are added to the training pairs until none is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.timeops import to_ms
from tessera.llm.boost import Boosted
from tessera.llm.spoken import speaker_number, spoken_words
from tessera.operators.carryscan import Batches, carry_scan, range_sorted
from tessera.runtime import cut

#: a segment that starts later than this after the start of the one before begins a turn
PAUSE_MS = 30_000
#: pairs of the table, at most, that the boundary model is trained on
TRAIN_PAIRS = 12_000
#: what the trees see of two neighbours: whether the speaker number differs, the gap between the starts, where the second's
#: label comes from (0 nowhere, 1 the label column, 2 the text), whether the first speaker is known, and the lengths of both
FEATURES = ("changed", "gap_ms", "source", "known", "chars_before", "chars")
NOBODY = -1
_CLEAN = "sample_id string, start_ms bigint, seg_id bigint, label int, source int, spoken string"
_PIECE = "sample_id string, first_seg_id bigint, speaker_no int, last_start bigint, last_seg_id bigint, turn_text string"
_PAIR = ", ".join(f"{f} bigint" for f in FEATURES)


def is_boundary(pairs: np.ndarray) -> np.ndarray:
    """The definition of a turn boundary between neighbouring kept segments."""
    return (pairs[:, 0] > 0) | (pairs[:, 1] > PAUSE_MS)


def disagreements(model: Boosted) -> np.ndarray:
    """One pair of whole numbers from every cell of the feature space in which the trees differ from the definition;
    none is a proof that they agree everywhere."""
    cuts = model.cuts()
    cuts[0], cuts[1] = sorted({*cuts.get(0, ()), 0.5}), sorted({*cuts.get(1, ()), PAUSE_MS + 0.5})
    sides = [sorted({float(np.floor(c)) + d for c in cuts.get(j, ()) for d in (0, 1)} or {0.0}) for j in range(len(FEATURES))]
    cells = np.array(list(product(*sides)))
    return cells[(model.margin(cells) > 0) != is_boundary(cells)]


def boundary_model(sample: np.ndarray) -> Boosted:
    """Trees fitted on the sample and refined until they are proved; every cell that was wrong weighs like the sample's
    rarer class, so that it is learnt."""
    seeds = np.array([[c, g, s, k, 8, 8] for c in (0, 1) for g in (0, 1_000, 20 * PAUSE_MS) for s in (0, 1) for k in (0, 1)], float)
    x = np.vstack([seeds, sample.reshape(-1, len(FEATURES))]).astype(float)
    weight = np.ones(len(x))
    for _ in range(64):
        model = Boosted(rounds=6, depth=2, rate=0.7, least=1e-3 * len(x) ** 0.5).fit(x, is_boundary(x), weight)
        wrong = disagreements(model)
        if not len(wrong):
            return model
        x = np.vstack([x, wrong])
        weight = np.concatenate([weight, np.full(len(wrong), max(1.0, 0.02 * len(x)))])
    raise ValueError("the boundary model does not reach its definition")


def boundaries(model: Boosted, pairs: np.ndarray) -> np.ndarray:
    """The model's decision. The definition only checks it: a disagreement is an error and never replaced in silence."""
    decided = model.margin(pairs) > 0
    if wrong := int((decided != is_boundary(pairs)).sum()):
        raise ValueError(f"the boundary model disagrees with the definition on {wrong} of {len(decided)} pairs")
    return decided


def clean_segments(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spoken words and label of each segment; repeated deliveries (neighbours in the order) and segments without
    spoken words are left out."""
    last = None
    for pdf in frames:
        out: list[tuple] = []
        for sid, start, seg, speaker, text in zip(pdf["sample_id"], pdf["start_ms"], pdf["seg_id"], pdf["speaker"], pdf["text"]):
            if (sid, seg) == last:
                continue
            last = (sid, seg)
            spoken, named = spoken_words(text)
            if spoken:
                no = speaker_number(speaker)
                source = 1 if no is not None else 2 if named is not None else 0
                out.append((sid, start, seg, named if no is None else no, source, spoken))
        yield pd.DataFrame(out, columns=["sample_id", "start_ms", "seg_id", "label", "source", "spoken"]).astype({"label": "Int32"})


class _Turns:
    """Assigns each row (sorted by clip, start, seg_id) its speaker and the first segment of its turn.

    state: [clip, speaker, start and length of the last row, first segment of the open turn].
    """

    def __init__(self, decide: Callable[[np.ndarray], np.ndarray], state: list | None = None):
        self.decide = decide
        self.clip, self.speaker, self.start, self.chars, self.turn = state or (None, NOBODY, 0, 0, 0)

    def pairs(self, batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, which rows begin a clip, speakers, features of each row and the one before it)."""
        clips, starts, segs, labels, sources = (batch.column(i).to_pylist() for i in range(5))
        n = len(clips)
        chars = [len(t) for t in batch.column(5).to_pylist()]
        x, speaker, fresh = np.zeros((n, len(FEATURES))), np.empty(n, np.int64), np.zeros(n, bool)
        for i in range(n):
            if clips[i] != self.clip:
                fresh[i] = True
                self.clip, self.speaker, self.start, self.chars = clips[i], NOBODY, starts[i], 0
            before = self.speaker
            if labels[i] is not None:
                self.speaker = labels[i]
            speaker[i] = self.speaker
            x[i] = before != self.speaker, starts[i] - self.start, sources[i], before >= 0, self.chars, chars[i]
            self.start, self.chars = starts[i], chars[i]
        return [clips, starts, segs, labels], fresh, speaker, x

    def feed(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(clip, start, seg, label or None, speaker, turn, boundary, features) by row; boundary is None for a clip's first
        row."""
        (clips, starts, segs, labels), fresh, speaker, x = self.pairs(batch)
        new = self.decide(x) if len(clips) else []
        for i in range(len(clips)):
            if fresh[i] or new[i]:
                self.turn = segs[i]
            yield clips[i], starts[i], segs[i], labels[i], int(speaker[i]), self.turn, None if fresh[i] else bool(new[i]), x[i]

    @property
    def state(self) -> list:
        return [self.clip, int(self.speaker), int(self.start), int(self.chars), int(self.turn)]


def _sample(batches: Batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Features of the first `rows` pairs of a partition."""
    scan, left = _Turns(lambda x: np.zeros(len(x), bool)), rows
    for b in batches:
        _, fresh, _, x = scan.pairs(b)
        x = x[~fresh][:left].astype(np.int64)
        left -= len(x)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=list(FEATURES))
        if left <= 0:
            return


def _summarise(batches: Batches, decide: Callable) -> dict | None:
    """The state after the partition if it starts afresh, and of the rows of its first clip what is needed to go on
    from a state of the same clip: the first row, the last pause among rows before the first label, that label's row,
    and the last boundary behind it."""
    scan, head, single = _Turns(decide), None, True
    for b in batches:
        for clip, start, seg, label, _, _, new, x in scan.feed(b):
            if head is None:
                head = {"clip": clip, "start": start, "seg": seg, "x": x.tolist(), "lead": 0, "pause": None, "named": None, "after": None, "last": None}
            elif clip != head["clip"]:
                single = False
            if single:
                first = head["lead"] == 0 and head["named"] is None
                if head["named"] is not None:
                    head["after"] = seg if new else head["after"]
                elif label is None:
                    head["lead"] += 1
                    head["pause"] = seg if not first and new else head["pause"]
                else:
                    head["named"] = [label, None if first else x.tolist(), seg]
                head["last"] = head["last"] if label is None else label
    return None if head is None else {"single": single, "head": head, "tail": scan.state}


def _combine(state: list | None, s: dict, decide: Callable) -> list:
    h = s["head"]
    if not s["single"] or state is None or state[0] != h["clip"]:
        return s["tail"]
    _, speaker, start, chars, turn = state

    def bound(label: int, x: list) -> bool:
        return bool(decide(np.array([[speaker != label, x[1], x[2], speaker >= 0, x[4], x[5]]], float))[0])

    first = [0, h["start"] - start, h["x"][2], 0, chars, h["x"][5]]
    if h["lead"]:
        if h["pause"] is not None:
            turn = h["pause"]
        elif bound(speaker, first):
            turn = h["seg"]
    if h["named"] is not None:
        label, inner, seg = h["named"]
        if bound(label, first if inner is None else inner):
            turn = seg
        turn = turn if h["after"] is None else h["after"]
        speaker = h["last"]
    return [h["clip"], speaker, *s["tail"][2:4], turn]


def _rescan(batches: Batches, state: list | None, decide: Callable) -> Iterator[pa.RecordBatch]:
    """One piece of each turn the partition holds a part of."""
    scan = _Turns(decide, state)
    piece: list | None = None
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*[(*p[:5], "".join(p[5])) for p in out])) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["sample_id", "first_seg_id", "speaker_no", "last_start", "last_seg_id", "turn_text"])

    for b in batches:
        texts = b.column(5).to_pylist()
        for (clip, start, seg, _, speaker, turn, _, _), text in zip(scan.feed(b), texts):
            if piece is None or piece[0] != clip or piece[1] != turn:
                if piece is not None:
                    out.append(piece)
                piece = [clip, turn, speaker, start, seg, []]
            piece[3], piece[4] = start, seg
            piece[5].append(text)
        if len(out) >= 4096:
            yield flush()
            out = []
    if piece is not None:
        out.append(piece)
    if out:
        yield flush()


def training_pairs(kept: DataFrame, most: int = TRAIN_PAIRS) -> np.ndarray:
    """At most `most` pairs of the stored rows, the same share from each partition."""
    each = -(-most // max(1, kept.rdd.getNumPartitions()))
    found = kept.mapInArrow(partial(_sample, rows=each), _PAIR).limit(most).toArrow()
    return np.column_stack([found[f].to_numpy() for f in FEATURES])


def speaker_turns(segments: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """Clean speaker turns of each clip: sample_id, first_seg_id, last_seg_id, speaker_no INT, turn_text.

    Segments with null sample_id, seg_id or start_sec (or one that is no number) are left out; those without spoken
    words are dropped and break no turn; equal starts are ordered by seg_id; repeated deliveries count once; clips of
    any length are scanned in partitions with carried state; an empty table gives no turns. A segment without a label
    goes on with the speaker before it, -1 at the start. Other columns, whatever their names, are not read. The
    boundary model is fitted on at most train_pairs neighbours of the table; all rows are decided by it.
    """
    rows = segments.select("sample_id", to_ms(F.col("start_sec")).alias("start_ms"), "seg_id", "speaker", "text")
    rows = rows.where(F.col("sample_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("seg_id").isNotNull() & F.col("text").isNotNull())
    kept = cut(range_sorted(rows, ["sample_id", "start_ms", "seg_id"]).mapInPandas(clean_segments, _CLEAN))
    decide = partial(boundaries, boundary_model(training_pairs(kept, train_pairs)))
    pieces = carry_scan(kept, partial(_summarise, decide=decide), partial(_combine, decide=decide), partial(_rescan, decide=decide), _PIECE, stored=True)
    parts = F.array_sort(F.collect_list(F.struct("last_start", "last_seg_id", "turn_text")))
    return (
        pieces.groupBy("sample_id", "first_seg_id")
        .agg(F.max("speaker_no").alias("speaker_no"), parts.alias("parts"))
        .select("sample_id", "first_seg_id", F.element_at("parts", -1)["last_seg_id"].alias("last_seg_id"), "speaker_no", F.array_join(F.col("parts.turn_text"), "").alias("turn_text"))
    )


def turns_of(rows: list[tuple]) -> list[tuple]:
    """Brute force over (sample_id, start_ms, seg_id, speaker, text), for tests."""
    out: list[list] = []
    clip = prev = None
    for sid, start, seg, speaker, text in sorted({r for r in rows if r[0] is not None and r[1] is not None and r[4] is not None}, key=lambda r: r[:3]):
        spoken, named = spoken_words(text)
        if not spoken:
            continue
        no = speaker_number(speaker)
        no = named if no is None else no
        if sid != clip:
            clip, who = sid, NOBODY
            new = True
        else:
            new = start - prev > PAUSE_MS
        if no is not None and no != who:
            who, new = no, True
        if new:
            out.append([sid, seg, seg, who, ""])
        out[-1][2], out[-1][4], prev = seg, out[-1][4] + spoken, start
    return [tuple(x) for x in out]
