from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import turns


class _Never:
    def margin(self, x):
        return np.full(len(x), -1.0)


def test_disagreement_is_an_error():
    """The rule does not replace the model's decision in silence."""
    pairs = np.array([[0, 10, 1, 1, 5, 5], [1, 10, 1, 1, 5, 5]], float)
    assert turns.boundaries(turns.boundary_model(pairs), pairs).tolist() == [False, True]
    with pytest.raises(ValueError, match="1 of 2"):
        turns.boundaries(_Never(), pairs)


def test_rows_come_through_the_model(spark, monkeypatch):
    """Without the trained trees there are no turns."""
    df = spark.createDataFrame([("a", 0.0, 1, "S1", "one"), ("a", 1.0, 2, "S2", "two")], "sample_id string, start_sec double, seg_id bigint, speaker string, text string")
    assert turns.speaker_turns(df).count() == 2
    monkeypatch.setattr(turns, "boundary_model", lambda sample: _Never())
    with pytest.raises(Exception, match="disagrees with the definition"):
        turns.speaker_turns(df).count()
