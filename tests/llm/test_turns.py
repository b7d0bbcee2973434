from __future__ import annotations

import random

import numpy as np

from tessera.llm import turns
from tessera.llm.boost import Boosted
from tessera.llm.spoken import SOUNDS, hesitates, hesitation_model, speaker_number, spoken_words
from tessera.llm.turns import FEATURES, PAUSE_MS, boundaries, boundary_model, disagreements, is_boundary, speaker_turns, turns_of

SCHEMA = "sample_id string, start_sec double, seg_id bigint, speaker string, text string, speaker_no string"


def test_speaker_numbers():
    for label, want in {"spk_0": 0, "说话人零": 0, "Ｓ０": 0, "speaker 001": 1, "2.0": 2, " speaker-3 ": 3, "<spk:5>": 5, "说话人十二": 12, "说话人二十": 20, "Speaker Two": 2, "未知": None, "n/a": None, "": None, None: None}.items():
        assert speaker_number(label) == want, label


def test_large_speaker_numbers_do_not_merge():
    assert speaker_number("spk_1234567890") == 1234567890 and speaker_number("spk_12345678901") is None and speaker_number("spk_0000000000007") == 7


def test_tokens_are_classified_by_the_trees():
    """On every combination of features that a token can have."""
    want = {0: lambda d, p: False, 1: lambda d, p: True, 2: lambda d, p: d, 3: lambda d, p: p, 4: lambda d, p: d or p}
    for sound, rule in want.items():
        for d in (0, 1):
            for p in (0, 1):
                x = np.array([[*(int(sound == k) for k in range(SOUNDS)), d, p]], float)
                assert (hesitation_model().margin(x)[0] > 0) == bool(rule(d, p)), (sound, d, p)


def test_spoken_words():
    cases = {
        "[00:01.500] <|Speech|>um, Hello (take two) [laughter]": ("hellotaketwo", None),
        "00:00:18,578 --> 00:00:19,578 - S3: At 10:30 we go": ("at1030wego", 3),
        "【00:09】Speaker 2: 嗯嗯，时间定在10:30。（掌声）": ("时间定在1030", 2),
        "（关门声）【说话人1】用手擦了擦额头，（二号机位）": ("用手擦了擦额头二号机位", 1),
        "served hummus, ummmm, uhh to the host": ("servedhummustothehost", None),
        "эээ... э-э, свет": ("свет", None),
        "えーと、はい。": ("はい", None),
        "pap­er bоаt": ("paperboat", None),
        "S99999999999: hi": ("s99999999999hi", None),
        "♪": ("", None), "": ("", None), None: ("", None), "...": ("", None),
    }
    for text, want in cases.items():
        assert spoken_words(text) == want, text
    assert hesitates("mmm", True) and not hesitates("em", False) and not hesitates("me", True)


def _pairs(rng, n, gap):
    return np.column_stack([rng.integers(0, 2, n), gap, rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 400, n), rng.integers(0, 400, n)]).astype(float)


def test_model_is_refined_until_proved():
    rng = np.random.default_rng(5)
    samples = [np.empty((0, len(FEATURES))), _pairs(rng, 12_000, rng.exponential(4_000, 12_000).astype(int)), _pairs(rng, 500, rng.integers(0, 90_000, 500))]
    samples.append(_pairs(rng, 3_000, np.zeros(3_000)) * [0, 1, 1, 1, 1, 1])  # nothing of what makes a boundary
    for sample in samples:
        model = boundary_model(sample)
        assert not len(disagreements(model))
        x = _pairs(rng, 100_000, rng.integers(-5, 40 * PAUSE_MS, 100_000))
        near = _pairs(rng, 2_001, PAUSE_MS - 1_000 + np.arange(2_001))
        assert (boundaries(model, np.vstack([x, near])) == is_boundary(np.vstack([x, near]))).all()
    rough = Boosted(rounds=4, depth=2).fit(samples[1], is_boundary(samples[1]))
    assert len(disagreements(rough)), "the proof finds what the sample alone does not teach"


def test_trees_learn_and_tell_their_cuts():
    x = np.random.default_rng(1).normal(size=(2000, 3))
    y = (x[:, 0] > 0.3) ^ (x[:, 1] > 0)
    model = Boosted(rounds=40).fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert {0, 1} <= set(model.cuts()) and Boosted(least=1e9).fit(x, y).cuts() == {}


def test_turns_against_brute_force(small_batches):
    rng = random.Random(3)
    for reach, speakers in ((400, (None, None, "?", "spk_0")), (3000, (None, "spk_0", "S1")), (40, (None, "S1")), (9000, (None, None, None, "S2"))):
        rows = []
        for i in range(250):
            start = rng.choice([None] + [float(rng.randrange(reach))] * 12)
            rows.append((rng.choice(["a", "a", "a", "b", None]), start, i, rng.choice(speakers), rng.choice(["hello", "um,", None, "[S1] yes", "world", "（掌声）"])))
        df = small_batches.createDataFrame([(*r, "x") for r in rows + rows[:40]], SCHEMA)
        want = {tuple(t) for t in turns_of([(a, None if b is None else round(b * 1000), c, d, e) for a, b, c, d, e in rows])}
        assert {tuple(r) for r in speaker_turns(df).collect()} == want


def test_turns_edges(spark):
    rows = [("a", 0.0, 1, None, "one"), ("a", 30.0, 2, None, "two"), ("a", 60.001, 3, None, "three"), ("a", float("nan"), 4, "S1", "x"), ("a", 60.001, 5, "S0", "w " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, speaker_turns(df).collect())) == [("a", 1, 2, -1, "onetwo"), ("a", 3, 3, -1, "three"), ("a", 5, 5, 0, "w" * 100_000)]
    assert speaker_turns(df.limit(0)).collect() == []


def test_turn_at_segment_zero(small_batches):
    """A turn that begins with segment 0 where a partition begins is a turn like others."""
    rows = [("a", 40.0 * (9 - i), i, None, f"w{i}") for i in range(10)] + [("b", 0.5 * (9 - i), 20 - i, "S1" if i % 2 else None, f"v{i}") for i in range(10)]
    df = small_batches.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert {tuple(r) for r in speaker_turns(df).collect()} == {tuple(t) for t in turns_of([(a, round(b * 1000), c, d, e) for a, b, c, d, e in rows])}
    never = lambda x: np.zeros(len(x), bool)
    always = lambda x: np.ones(len(x), bool)
    head = {"clip": "a", "start": 5, "seg": 0, "x": [0, 0, 0, 0, 0, 2], "lead": 2, "pause": 0, "named": None, "after": None, "last": None}
    assert turns._combine(["a", 1, 0, 3, 7], {"single": True, "head": head, "tail": ["a", -1, 9, 2, 0]}, never) == ["a", 1, 9, 2, 0]
    named = {**head, "lead": 0, "pause": None, "named": [2, None, 0], "after": 0, "last": 2}
    assert turns._combine(["a", 2, 0, 3, 7], {"single": True, "head": named, "tail": ["a", 2, 9, 2, 0]}, always) == ["a", 2, 9, 2, 0]
