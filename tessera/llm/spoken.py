"""What is spoken in a transcript segment, and the speaker its labels name."""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import numpy as np

from tessera.llm.boost import Boosted
from tessera.llm.glyphs import own_alphabet, widths

_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_HAN = "零〇一二两三四五六七八九十百"
_NUMBER = rf"(?:\d{{1,9}}(?:\.0+)?(?!\d)|[{_HAN}]{{1,7}})"
#: a speaker label: a word for speaker, then a number
_LABEL = rf"(?:spkr|spk|speaker|spaker|s|说话人|說話人|发言人|話者|讲话人|嘉宾)[ _#:.\-]*({_NUMBER})"
_LABEL_ALONE = re.compile(rf"\s*(?:-\s*)?{_LABEL}\s*[:]?\s*", re.IGNORECASE)
_LABEL_HEAD = re.compile(rf"(?:-\s*)?{_LABEL}\s*:\s*", re.IGNORECASE)
_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_POSITION_ALONE = re.compile(rf"\s*(?:{_CLOCK}(?:\s*(?:-->|->|[-–—~])\s*{_CLOCK})?|\d+(?:\.\d+)?\s*(?:s|sec|secs|seconds|秒))\s*", re.IGNORECASE)
#: unbracketed, a position has hours, fractions or an end; a bare 10:30 is a spoken time
_POSITION_HEAD = re.compile(rf"(?:{_CLOCK}\s*-->\s*{_CLOCK}|\d{{1,3}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?|\d{{1,3}}:\d{{2}}[.,]\d{{1,3}})(?![\d:])\s*")
_TAG = re.compile(r"<\|[^|<>]*\|>")
_BRACKETS = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|【([^【】]*)】|〔([^〔〕]*)〕|<([^<>]*)>|\{([^{}]*)\}|\*([^*]+)\*")

#: what a bracket or tag can begin with
_OPENS = re.compile(r"[\[(【〔<{*]")
#: all but letters and digits
_SILENT = re.compile(r"[\W_]+")

# Words of sound and event annotations, by their beginning.
_EVENTS = tuple(
    "laugh chuckl giggl music applau clap cheer sigh cough sneez nois beep slam knock ring buzz bark sob cries crying gasp breath whisper scream "
    "static silen inaudib crosstalk footstep footfall thunder click sniff groan moan yawn humming whistl bang crash creak vibrat rustl clatter thud chime siren "
    "risa aplauso música suspiro ruido silencio tos rire applaudissement musique toux soupir bruit "
    "смех аплодисмент музык кашель вздох шум тишина".split()
)
_EVENT_HAN = re.compile(
    r"[^\d]{0,6}(?:声|音乐|铃响|响起|叹气|叹息|咳嗽|欢呼|鼓掌|大笑|轻笑|哭泣|抽泣|静音|沉默|停顿|噪音|杂音|喘息|喘气|音效|配乐|清嗓子?|吸气|呼气|打喷嚏|哈欠|尖叫|拍手|笑い|ため息|咳|雑音|音楽|歓声|無音|足音)"
)
_SPEECH_HAN = re.compile(r"大声|小声|出声|轻声|低声|高声|无声")

# Hesitation sounds, letters doubled in speech written once.
_HESITATION = frozenset("um uhm uh er erm hm mhm euh heu эм хм гм".split())
#: single letters hesitate when drawn out
_HESITATION_DRAWN = frozenset("m м э".split())
#: these are also words: they hesitate only before a pause
_HESITATION_AT_PAUSE = frozenset("hum eh em ehm".split())
_HESITATION_HAN = re.compile(
    r"(?:嗯+|呃+|唔+|呣+|えーっ?と|ええっ?と|えっと|うーん|うーむ|あのー+|そのー+|んー+|えー+)(?=[\s,，、。.…—~～!！?？;；:：♪-]|$|嗯|呃|唔|え|う)|(?<![^\s,，、。.…—~～!！?？])(?:额+)(?=[\s,，、。.…—~～!！?？]|$)"
)
#: a token of nothing but letters of these sounds, not a part of a longer one
_SOUND = "[" + "".join(sorted(set("".join(_HESITATION | _HESITATION_DRAWN | _HESITATION_AT_PAUSE)))) + "]+"
_SOUND_TOKEN = re.compile(rf"(?<![^\W\d_])(?<![^\W\d_]['’\-]){_SOUND}(?:-{_SOUND})*(?![^\W\d_])(?!['’\-][^\W\d_])", re.IGNORECASE)


def number_of(label: str) -> int | None:
    if label[0].isdigit():
        return int(re.match(r"\d+", label)[0])
    total, unit = 0, 0
    for c in label:
        if c == "百":
            total, unit = total + (unit or 1) * 100, 0
        elif c == "十":
            total, unit = total + (unit or 1) * 10, 0
        else:
            unit = unit * 10 + _DIGITS[c] if unit and c not in "零〇" else _DIGITS[c]
    return total + unit


@lru_cache(65536)
def speaker_number(speaker: str | None) -> int | None:
    """The number in a speaker label, however written; None where the label names nobody or its number is no INT."""
    if speaker is None:
        return None
    s = widths(speaker).strip().lower()
    if m := re.search(r"\d+", s):
        return int(m[0]) if len(m[0].lstrip("0")) < 11 and int(m[0]) < 1 << 31 else None
    if m := re.search(rf"(?:^|人|者|员|宾|号|#|[ _\-])([{_HAN}]+)号?\W*$", s):
        return number_of(m[1])
    return next((_WORDS[w] for w in re.findall(r"[a-z]+", s) if w in _WORDS), None)


def _is_event(content: str) -> bool:
    c = content.strip().lower()
    if re.search(r"[぀-鿿]", c):
        return _EVENT_HAN.fullmatch(c) is not None and not _SPEECH_HAN.match(c)
    words = re.findall(r"[^\W\d_]+", c)
    return 0 < len(words) <= 4 and any(w.startswith(_EVENTS) for w in words)


#: what the trees see of a token: its sound (0 none, 1 one that hesitates, 2 one that does when drawn out, 3 one that does
#: before a pause, 4 one that does in either case), whether it is drawn out, and whether a pause follows
SOUNDS = 5
#: labelled tokens the trees are trained on: (token, before a pause, hesitates)
_LABELLED = (
    *((t, p, True) for t in ("um", "ummm", "uh-uh", "hm", "Euh", "эм", "гмм", "erm") for p in (False, True)),
    *((t, p, True) for t in ("mmm", "m-m", "ммм", "эээ", "э-э") for p in (False, True)), *((t, p, False) for t in ("m", "м") for p in (False, True)),
    ("э", True, True), ("э", False, False), *((t, p, p) for t in ("em", "hum", "eh", "ehm", "emm", "huuum") for p in (False, True)),
    *((t, p, False) for t in ("me", "hummus", "lantern", "them", "we", "он", "see", "no-no", "um-hum", "le") for p in (False, True)),
)


def token_features(token: str, pause: bool) -> tuple[int, ...]:
    parts = token.lower().split("-")
    once = {re.sub(r"(.)\1+", r"\1", p) for p in parts}
    base = once.pop() if len(once) == 1 else ""
    sound = 4 if base == "э" else 1 if base in _HESITATION else 2 if base in _HESITATION_DRAWN else 3 if base in _HESITATION_AT_PAUSE else 0
    drawn = len(parts) > 1 or len(token) > len(base)
    return (*(int(sound == k) for k in range(SOUNDS)), int(drawn), int(pause))


@lru_cache(1)
def hesitation_model() -> Boosted:
    x = np.array([token_features(t, p) for t, p, _ in _LABELLED], float)
    return Boosted(rounds=40, depth=3, rate=0.7).fit(x, np.array([y for _, _, y in _LABELLED], float))


@lru_cache(1 << 8)
def _hesitates(features: tuple[int, ...]) -> bool:
    return bool(hesitation_model().margin(np.array([features], float))[0] > 0)


@lru_cache(1 << 16)
def hesitates(token: str, pause: bool) -> bool:
    """Token-level classification by the fitted trees: a sound without meaning, its letters drawn out or not; some only
    before a pause. The features have few combinations, so each is decided once."""
    return _hesitates(token_features(token, pause))


def spoken_words(text: str | None) -> tuple[str, int | None]:
    """(spoken letters and digits in lower case and composed form, speaker number of a label in the text or None)."""
    if not text:
        return "", None
    t = own_alphabet(widths(text))
    label: int | None = None

    def bracket(m: re.Match) -> str:
        nonlocal label
        content = next(g for g in m.groups() if g is not None)
        if _POSITION_ALONE.fullmatch(content):
            return " "
        if named := _LABEL_ALONE.fullmatch(content):
            label = number_of(named[1]) if label is None else label
            return " "
        if _is_event(content) or (m[0][0] == "<" and re.fullmatch(r"/?[A-Za-z_|]+", content)):
            return " "
        return f" {content} "

    if _OPENS.search(t):
        t = _BRACKETS.sub(bracket, _TAG.sub(" ", t))
    t = t.lstrip(" \n♪♫>-–—")
    while m := _POSITION_HEAD.match(t) or _LABEL_HEAD.match(t):
        if m.re is _LABEL_HEAD and label is None:
            label = number_of(m[1])
        t = t[m.end() :].lstrip(" \n♪♫>-–—")
    t = _HESITATION_HAN.sub(" ", t)

    def token(m: re.Match) -> str:
        after = t[m.end() : m.end() + 1]
        return " " if hesitates(m[0], after == "" or after in ",.…，。、—–-!?！？;；") else m[0]

    t = _SOUND_TOKEN.sub(token, t)
    t = t.lower()
    return _SILENT.sub("", t if t.isascii() else U.normalize("NFC", t)), label
