"""Neutral uses and rules cancel what they span or govern, nothing else of their clause."""

from __future__ import annotations

import pytest

from tessera.llm.offensive import THRESHOLD, grammar

ABUSE = ("you are an idiot, kill the music", "kill the music, you are an idiot", "你这个废物，性格真差", "你这个废物，电脑又死机了", "你这个白痴，白痴板不要入镜", "no nudity please, you are a moron", "不得出现裸露，你这个废物", "the idiot board is gone, you idiot",
         "avoid profanity, and you are a moron")
HARMLESS = ("you are on the idiot board", "no nudity, masturbation, or porn", "kill the music", "你这个白痴板不要入镜", "真希望你的电脑死机", "不得出现裸露或色情、做爱", "审核说明：你这个废物，去死", "moderation note: the comment you are an idiot, drop dead",
            "the comment you are an idiot was removed", "without any sex, no porn and no nudes of anybody", "这里都是垃圾桶")


@pytest.mark.parametrize("text", ABUSE)
def test_abuse_stands(text):
    assert grammar().score(text) >= THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_what_is_governed_does_not(text):
    assert grammar().score(text) < THRESHOLD
