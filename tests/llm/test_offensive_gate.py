"""What a pattern needs only saves work: what the patterns hold is found with and without it."""

from __future__ import annotations

import re
from re import _constants as C, _parser

import pytest

from tessera.llm.offensive import _HAN_CLEAR, RULES, THRESHOLD, Grammar, grammar, needed


class Ungated(Grammar):
    """Every pattern is tried on every clause."""

    def candidates(self, views):
        return list(self.rules)

    def active(self, text, views):
        return list(self.VIEWS)


def _one(kind, arg) -> str:
    if kind is C.LITERAL:
        return chr(arg)
    if kind is C.RANGE:
        return chr(arg[0])
    return {C.CATEGORY_WORD: "a", C.CATEGORY_NOT_WORD: "*", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_SPACE: "a", C.CATEGORY_DIGIT: "1", C.CATEGORY_NOT_DIGIT: "a"}[arg]


def _texts(parsed, optional: bool, pick: int) -> list[str]:
    """Texts of a pattern with each of its alternatives in at least one; the others at their first or last."""
    parts = []
    for kind, arg in parsed:
        if kind is C.BRANCH:
            parts.append([t for branch in arg[1] for t in _texts(branch, optional, pick)])
        elif kind is C.SUBPATTERN:
            parts.append(_texts(arg[3], optional, pick))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, _, inner = arg
            times = max(least, int(optional))
            parts.append([t * times for t in _texts(inner, optional, pick)] if times else [""])
        elif kind is C.IN:
            negated = arg[0][0] is C.NEGATE
            parts.append(["q ", "q"] if negated else [_one(*a) for a in arg])
        elif kind is C.NOT_LITERAL or kind is C.ANY:
            parts.append([" "])
        elif kind is C.LITERAL:
            parts.append([chr(arg)])
        else:
            assert kind in (C.AT, C.ASSERT, C.ASSERT_NOT), kind
    base = [p[pick] for p in parts]
    return list(dict.fromkeys("".join([*base[:k], t, *base[k + 1 :]]) for k, p in enumerate(parts) for t in p)) or [""]


def _all(pattern: str) -> list[str]:
    parsed = _parser.parse(pattern)
    return list(dict.fromkeys(t.lower() for optional in (False, True) for pick in (0, -1) for t in _texts(parsed, optional, pick)))


@pytest.mark.parametrize("i", range(len(RULES)))
def test_every_alternative_is_reached(i):
    g, all_, r = grammar(), Ungated(), RULES[i]
    tried, lost = 0, []
    for t in _all(r.pattern):
        views = g.views(t)
        if not r.regex.search(views[r.view]):
            continue
        tried += 1
        reached = any(a in views[r.view] for a in needed(r.source)) and r in g.candidates(views)
        carried = r.weight < 0 or not r.carries or (g.triggered(t, views) and g.score(t) == all_.score(t))
        if not reached or not carried:
            lost.append(t)
    assert tried and not lost


def test_needed_strings():
    assert needed("a(?:bc|de)f?gh") == {"abc", "ade"} and needed("(?:you )?idiots?(?= x)") == {"idiot"} and needed(r"\w+(?:[xy]z|w)") == {"xz", "yz", "w"}
    with pytest.raises(ValueError):
        needed(r"\w+(?:abc)?")


def test_masked_words_are_looked_at():
    """Also where the mask was closed up as a gap, and after a written \\n."""
    g, all_ = grammar(), Ungated()
    for w in (w for w in _HAN_CLEAR if re.fullmatch(r"[一-鿿]{2,}", w)):
        for k in range(1, len(w)):
            for mask in "*x×_.-~·":
                t = f"你这个{w[:k]}{mask}{w[k + 1 :]}"
                assert (g.score(t) >= THRESHOLD) == (all_.score(t) >= THRESHOLD), t
    for t in ("I will burn you alive", "show me her bare ass", "f*ck you", "fuck你", "son basura", "你这个王_蛋", "so\\nyou are a m o r o n", "so\\nm o r o n, you m o r o n"):
        assert g.score(t) == all_.score(t) > 0, t
