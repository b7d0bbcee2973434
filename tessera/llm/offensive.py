"""Abusive, hateful and sexual wording by a weighted finite-state pattern grammar.

Transducers are composed: text -> one form of every character -> disguised words rewritten (leet, masks, separators,
drawn-out letters) -> clauses -> what negation, neutral uses and notes about such content govern is blanked -> weighted
tags with spans (insults, address, targets, threats, dehumanising, explicit, nude, reported speech), each a finite-state
pattern over word classes -> a clause acceptor that adds the weights of tags that stand together. Isolated words do not
reach the threshold: an insult needs an address or a target near it, a harm needs a person.

What a pattern cannot match without is derived from the pattern itself (`needed`), never kept by hand: one automaton over
these literals tells which clauses and which patterns are worth a look.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from re import _constants as C, _parser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.glyphs import own_alphabet, widths

THRESHOLD = 1.0

# ---- fixed vocabularies ------------------------------------------------------------------------------------------
INSULTS = (
    "arsehole, asshole, asswipe, bastard, bellend, bimbo, bitch, blockhead, bonehead, bozo, brainless clown, cocksucker, cretin, cuck, cunt, degenerate, dickhead, dimwit, dipshit, "
    "dirtbag, dolt, douche, douchebag, dullard, dumbass, dumbfuck, dunce, fatass, fathead, fatso, fuckface, fucker, fucktard, fuckwit, halfwit, idiot, ignoramus, imbecile, jackass, "
    "jerk, knobhead, lardass, lowlife, maggot, moron, motherfucker, nincompoop, nitwit, numbnuts, numbskull, numpty, parasite, pathetic loser, peabrain, pervert, pinhead, prick, "
    "retard, scum, scumbag, shit, shitbag, shithead, simpleton, skank, sleazebag, slimeball, slut, sonofabitch, spastic, swine, tosser, turd, twat, wanker, whore, "
    "piece of garbage, piece of shit, piece of trash, piece of crap, sack of shit, son of a bitch, waste of space, waste of oxygen, waste of skin"
)
_SCORN = "brainless, dirty, disgusting, fat, filthy, lazy, miserable, pathetic, stupid, ugly, useless, worthless"
_BEASTS = "animal, ape, clown, cow, creature, dog, garbage, loser, monkey, pig, rat, swine, trash, worm"
SLURS = "nigger, faggot, kike, wetback, gook, raghead, towelhead, tranny"
INSULTS_FOREIGN = (
    "imbécil, idiota, gilipollas, cabrón, cabron, hijo de puta, hija de puta, hijoputa, puta de mierda, puta, subnormal, maricón, zorra, pendejo, capullo, mamón, estúpido de mierda, basura humana, "
    "connard, connasse, salaud, salope, enculé, abruti, fils de pute, pute, bâtard, enfoiré, espèce d'ordure, espèce d'idiot, ordure, crétin, débile, pauvre type, "
    "hurensohn, arschloch, wichser, fotze, schlampe, drecksau, missgeburt, vollidiot, "
    "идиот, ублюдок, мразь, сволочь, тварь, дебил, придурок, урод, скотина, кретин, сука, мудак, гнида, подонок, мудила, шлюха, долбоёб, долбоеб"
)
INSULTS_HAN = (
    "傻逼 傻B 傻叉 傻屌 煞笔 沙比 沙雕 傻13 白痴 白吃 王八蛋 王八羔子 混蛋 脑残 贱货 贱人 婊子 废物 肺物 垃圾玩意 死胖子 死肥猪 狗东西 狗杂种 畜生 畜牲 蠢货 蠢猪 人渣 "
    "杂种 贱种 弱智 智障 败类 狗娘养的 龟孙子 臭婊子 猪脑子 窝囊废 神经病 SB 脑洞残 二逼 狗屎 废柴 下三滥 滚蛋玩意 狗日的 软蛋 孬种 丧门星 骚货 烂货 クズ バカ野郎 馬鹿野郎 くそ野郎 ゴミ野郎 カス野郎 ブス キチガイ"
)
_GROUPS = (
    "africans, arabs, asians, blacks, catholics, chinese, christians, cripples, foreigners, gays, girls, gypsies, hindus, homosexuals, immigrants, indians, infidels, jews, lesbians, "
    "mexicans, migrants, muslims, natives, peasants, refugees, roma, russians, women, whites, villagers, islanders, southerners, northerners"
)
_MASK = "*＊x✗×X✕○●□#"
_JOIN = r"[\s*_.·•~^\-]"


def _vocabulary(text: str) -> list[str]:
    return [w.strip() for w in text.split(",")]


_RUN = re.compile(r"([a-zß-ԯ])\1+")


def squeeze(text: str) -> str:
    """Small letters of alphabets written several times in a row written once."""
    return _RUN.sub(r"\1", text)


# ---- disguises ---------------------------------------------------------------------------------------------------
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
_LEET_WORD = re.compile(r"(?<![\w@$])(?=[a-z0-9@$!|+]*[a-z])(?=[a-z0-9@$!|+]*[0-9@$!|+])[a-z0-9@$]+(?:[!|+]+[a-z0-9@$]+)*(?![\w@$])")
_LEET_PAIR = re.compile(r"[0-9@$!|+][a-z]|[a-z][0-9@$!|+]|@\$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?: {2,}(?:[^\W\d_] )+[^\W\d_])*(?![^\W_])")
_INNER = re.compile(r"[_.\-*·•~^]+(?= ?[^\W\d_])")
_STARRED = re.compile(r"(?<![^\W_])([a-z])\*{2,}([a-z]?)(?![^\W_])")
_ONE_MASK = re.compile(r"(?<![^\W_])[a-z]+[*#%][a-z]+(?![^\W_])")
_HAN = "一-鿿぀-ヿ"
_HAN_RUN = re.compile("[\u2e80-\u2fff\u3040-\u9fff\uac00-\ud7a3\uf900-\ufaff]+")
_HAN_GAP = re.compile(rf"(?<=[{_HAN}]){_JOIN}+(?=[{_HAN}])")
_SWEARS = "fuck, fucking, fucked, cock, dick, pussy, rape, kill, penis, vagina, tits, cum, nazi"


@lru_cache(1)
def _masked_words() -> dict[str, str]:
    """Words with one inner letter masked -> the word; forms of two words are left out."""
    found: dict[str, str | None] = {}
    for w in (w for w in _vocabulary(f"{INSULTS}, {SLURS}, {_SWEARS}") if w.isalpha() and len(w) >= 4):
        for form in (w, w + "s"):
            for k in range(1, len(w) - 1):
                masked = f"{form[:k]}*{form[k + 1 :]}"
                found[masked] = None if found.get(masked, form) != form else form
    return {k: v for k, v in found.items() if v}


def _unmask(m: re.Match) -> str:
    return _masked_words().get(m[0].replace("#", "*").replace("%", "*"), m[0])


@lru_cache(1)
def _known() -> frozenset[str]:
    return frozenset(squeeze(w) for w in _vocabulary(f"{INSULTS}, {INSULTS_FOREIGN}, {SLURS}, {_SWEARS}") if w.isalpha())


@lru_cache(1)
def _scorn() -> frozenset[str]:
    """First words of phrases of insult."""
    return frozenset(squeeze(w.split(" ")[0]) for w in [*_vocabulary(_SCORN), *(w for w in _vocabulary(INSULTS) if " " in w)])


def _close_up(m: re.Match) -> str:
    words = " ".join(w.replace(" ", "") for w in re.split(r" {2,}", m[0]))
    if words[0] not in "ai" or squeeze(words) in _known():
        return words
    # the first letter may be an article before the word
    return f"{words[0]} {words[1:]}" if squeeze(words[1:].split(" ")[0]) in _known() | _scorn() else f"{words} {words[1:]}"


_BANG = re.compile(r"(?<![^\W_])[a-z0-9@$]+(?:![a-z0-9@$]+)+(?![^\W_])")


def _banged(m: re.Match) -> str:
    word = squeeze(m[0].translate(_LEET))
    return word if word in _known() or word.removesuffix("s") in _known() else m[0]


def _separator(m: re.Match) -> str:
    """Nothing for separators between two letters, also where a blank follows; a full stop before a blank stays."""
    ends = m.string[m.end()] == " " and "." in m[0]
    return m[0] if ends or not m.start() or not m.string[m.start() - 1].isalpha() else ""


def undisguised(plain: str) -> str:
    """Lower-case text with disguised Latin words rewritten and every letter run written once; a run of Han, kana or
    Hangul, about which the patterns of alphabets say nothing, is one letter."""
    t = plain if plain.isascii() else _HAN_RUN.sub("一", plain)
    if "*" in t or "#" in t or "%" in t:
        t = _STARRED.sub(lambda m: f"{m[1]}xqx{m[2]}", _ONE_MASK.sub(_unmask, t))
    # letters apart: two words in a row of one letter each
    if b"\1\1" in bytes(map(min, map(len, t.split(" ")), repeat(2))):
        t = _SPACED.sub(_close_up, t)
    if _LEET_PAIR.search(t):
        t = _LEET_WORD.sub(lambda m: m[0].translate(_LEET), t)
    t = squeeze(_INNER.sub(_separator, t))
    return re.sub(r"[ \t]+", " ", t) if "  " in t or "\t" in t else t


def closed_up(plain: str) -> str:
    """Gaps between Han letters closed; nothing is left of a text without any."""
    return "" if plain.isascii() else _HAN_GAP.sub("", plain)


def _any(words: list[str]) -> str:
    """Alternation, longest first; between the words of a phrase any few separators may stand."""
    return "(?:" + "|".join(r"[\W_]{1,3}".join(map(re.escape, w.split(" "))) for w in sorted(words, key=len, reverse=True)) + ")"


def _han_closed(words: list[str]) -> list[str]:
    """Each word without one of its inner characters: its mask was closed up as a gap."""
    return [w[:k] + w[k + 1 :] for w in words if re.fullmatch(r"[一-鿿]{2,}", w) for k in range(1, len(w) - 1)]


def _han_masked(words: list[str]) -> str:
    """Each word with one of its characters masked, or its last one in Latin letters."""
    out = [r"[一-鿿]zha", *_han_closed(words)]
    for w in words:
        if re.fullmatch(r"[一-鿿]{2,}", w):
            out += ["".join(f"[{_MASK}]" if i == k else c for i, c in enumerate(w)) for k in range(1, len(w))]
    return "(?:" + "|".join(sorted(set(out), key=len, reverse=True)) + ")"


# ---- word classes ------------------------------------------------------------------------------------------------
_HAN_CLEAR = [w for w in INSULTS_HAN.lower().split() if not w.isascii()]
_ZH = _any(_HAN_CLEAR) + r"|(?<![a-z])sb(?![a-z])"
_MASKED_HAN = re.compile(rf"[一-鿿](?:[{_MASK}]|zha)")
_ZH_MASKED = re.compile(_han_masked(_HAN_CLEAR))
_B, _E = r"(?<![^\W_])", r"(?![^\W_])"
_SCORNED = rf"(?:{_any(_vocabulary(_SCORN))} {_any(_vocabulary(_BEASTS))})"
_INS = rf"{_B}(?:{_any(_vocabulary(INSULTS))}|{_SCORNED}|{_any(_vocabulary(INSULTS_FOREIGN))}|[a-z]?xqx[a-z]?)(?:e?s)?{_E}"
_FUCK = r"(?:fuck|fuk|fck|fxqxk?|phuck)"
_FILL = r"(?:(?:an?|the|such|just|really|so|nothing|but|one|complete|total|absolute|utter|stupid|dumb|fucking|fking|bloody|goddamn|dirty|damn|little|old|fat|ugly|lazy|big|bunch of|pack of|load of) )*"
_BE = r"(?:are|is|was|were|am|be|must be|'re|'s|’re|’s|sounds? like|looks? like)"
_YOU = r"(?:you|u|ya|y'all|all of you|you people|you all|you lot)"
_PERSONS = r"(?:reviewers?|editors?|directors?|authors?|annotators?|actors?|actresses|writers?|users?|producers?|animators?|translators?|boss|teacher|neighbou?rs?)"
#: somebody who is spoken to or of, as a target
_SPOKEN_TO = rf"(?:{_YOU}|your (?:mother|whole|entire|family|kind|face|mum|mom|kids)|people like (?:you|him|her|them)|someone like you|whoever|anyone who|the (?:one|man|woman|guy|person|idiot) who|the {_PERSONS})"
_THIRD = r"(?:him|her|them|he|she|they)"
_GROUP = rf"(?:[a-z\-]+ )?{_any(_vocabulary(_GROUPS))}"
_PEOPLE = r"(?:people|folks?|men|women) from [a-z\-]+|[a-z\-]+[ -](?:people|folks?|women|men|drivers?)"
_BASE = r"(?:whores|sluts|animals|savages|thieves|criminals|rapists|terrorists|pigs|dogs|rats|apes|monkeys|liars|inferior|filthy|subhumans?)"
_PAIN = r"(?:kill|murder|rape|stab|strangle|choke|slaughter|torture|behead|gut|drown|lynch|beat|hurt|hang|burn|bury|destroy|slap|punch|shoot|smash|cut|break)"
_THING = r"(?:clips?|videos?|shots?|scenes?|films?|movies?|audio|sound|music|subtitles?|captions?|renders?|results?|outputs?|footage|work|edits?|cuts?|takes?|software|tools?|apps?|trailers?|effects?|it|this|that)"
_SLOT = r"[^.!?。!?\n]{1,40}?"
#: "you" that goes on to a sentence and is no vocative
_SENTENCE = r"(?:will|would|can|could|should|must|may|might|need|have|had|has|are|were|do|did|know|see|hear|get|got|like|want|two|three|guys|both|too|and|or|to|in|on|at|with|just|really|only|always|never|also|still|'|’|all|there|for|from|who|if|when|as|be)"

_MANY = r"(?:all|every|every one of|each of|those|these|the|no|most|any|keep|send|until|with no)"


@dataclass(frozen=True)
class Rule:
    tag: str
    weight: float
    pattern: str
    #: folded (undisguised alphabets, letter runs written once) or han (Han and kana, gaps between them closed)
    view: str = "folded"
    #: False for a tag that never carries a clause without another one's or a masked word
    carries: bool = True

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.source)

    @property
    def source(self) -> str:
        """The pattern; for the folded view its letter runs too are written once (escapes stay)."""
        return _squeezed(self.pattern) if self.view == "folded" else self.pattern


@lru_cache(None)
def _squeezed(pattern: str) -> str:
    return "".join(p if p.startswith("\\") else squeeze(p) for p in re.split(r"(\\.)", pattern))


@lru_cache(None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _zh(tag: str, weight: float, pattern: str, carries: bool = True) -> Rule:
    return Rule(tag, weight, pattern, "han", carries)


_HARM = (
    r"(?:never wake up|(?:not|don't|won't) wake up|jump(?:ed)? (?:off|from|out of)|rot (?:in|there|away)|choke(?:d)? (?:on|to)|be beaten|"
    r"make(?:s)? me sick|stop(?:ped)? breathing|break (?:every|your|his|her|their)|regret ever|shed a tear|drop dead|hang (?:you|yourself)|"
    r"(?:kill|slap|punch|stab|beat|strangle|choke) (?:you|him|her|them|yourself)|shoot (?:you|yourself)|slit (?:your|his|her)|burn (?:you|in hell|their houses?)|rape (?:you|her|him|them|your)|"
    r"crawl back|better off dead|waste of (?:air|oxygen|breath)|(?:cleaner|better|nicer|safer) (?:place )?without (?:you|your|them|him|her)|ashamed (?:she|he|they) ever|deserves? to (?:die|suffer|rot|bleed|burn)|"
    r"hope you (?:die|suffer|never (?:wake|walk|come|see|have|find|recover|get|return|live)|choke|rot|burn|bleed|drown)|should(?: have)? (?:die|never been born|been aborted)|should be (?:shot|hanged|raped|beaten|killed|put down)|watch your back|find out where you live|know where you live|gut you|bury you)"
)

RULES: tuple[Rule, ...] = (
    # address that is abuse by itself
    Rule("address", 1.0, rf"{_B}(?:shut (?:your (?:mouth|trap|face|hole)|up|the fuck up),? you|get lost,? you|come here,? you|listen(?: here)?,? you)\s+(?!{_SENTENCE}{_E}){_SLOT}(?=[.!?,\"”\n]|$)"),
    Rule("address", 1.0, rf"{_B}(?:{_FUCK}|piss) (?:off|you|your|u|yourself|(?:all|every one) of you){_E}|{_B}screw you(?! (?:in|on|into|down|to)\b){_E}|{_B}go (?:{_FUCK}|screw|hang|kill) yourself|{_B}{_FUCK}(?:ing?|in'?) (?:you|your|idiot|hell of a)"),
    Rule("address", 1.0, rf"{_B}(?:kys|kill yourself|neck yourself|drink bleach|eat shit|up yours|kiss my (?:ass|arse)|suck my (?:dick|cock|balls)|(?:bugger|sod) off|go to hell,? (?:you|all)|burn in hell|rot in hell){_E}|{_B}shut the fuck up{_E}"),
    Rule("address", 0.8, rf"{_B}{_YOU} ?(?:{_BE} )?{_FILL}{_INS}"),
    Rule("address", 0.8, rf"{_B}(?:only|what|such) an? {_FILL}{_INS}|{_B}(?:[\w'’]+,? )?{_BE} (?:an?|such an?|the|nothing but(?: an?)?) {_FILL}{_INS}|{_B}(?:{_THIRD}|who\w*) {_BE} {_FILL}{_INS}|{_B}(?:listen|get lost|hey|oi|shut up|go away|come here|look),? (?:you )?{_FILL}{_INS}|{_INS} like (?:you|him|her|them){_E}"),
    # a clause of nothing but the insult
    Rule("address", 0.6, rf"^[\W_]*(?:you|oh|hey|du|sale|espèce de?|maldit[oa]|тупой|тупая|ты|ah|ugh)?[\W_]*{_FILL}{_INS}[\W_]*$"),
    Rule("address", 0.5, rf"{_B}(?:says?|said|yell(?:s|ed)|shout(?:s|ed)|scream(?:s|ed)|hiss(?:es|ed)|snarl(?:s|ed)|wrote|writes|call(?:s|ed)? (?:me|him|her|us|them|you|[a-z]+))[:,]? ?[\"“'‘]?(?:an? |you )?{_FILL}{_INS}"),
    # a target near the insult
    Rule("address", 0.45, rf"{_B}{_SPOKEN_TO}{_E}(?! {_SENTENCE}{_E})(?:[\s\"“'’,]+[\w'’]+){{0,5}}?[\s\"“'’,]+{_INS}|{_INS}(?:[\s,]+[\w'’]+){{0,4}}?[\s,]+{_B}{_SPOKEN_TO}{_E}"),
    # what only adds to an insult or an address
    Rule("tone", 0.5, rf"{_B}nobody asked you{_E}|{_B}like you would{_E}|{_B}{_FUCK}|{_B}shit{_E}|{_B}i want to slap{_E}", carries=False),
    Rule("address", 1.0, rf"{_B}(?:you|he|she)(?: is| are|'s|'re|’s|’re) (?:(?:a|an|so|such|just|really|nothing but|total|complete|absolute|human|utterly|completely) )*(?:piece of )?(?:garbage|trash|worthless|pathetic|subhuman|vermin|brain ?dead|filth|retarded){_E}(?! (?:bag|bin|can|at|man|attempt))|{_B}you(?: are|'re|’re) (?:so |too |really |just |such a |a |that )*(?:stupid|dumb|ugly)(?! (?:to|question|thing)){_E}"),
    Rule("slur", 1.0, rf"{_B}{_any(_vocabulary(SLURS))}s?{_E}"),
    Rule("insult", 0.55, _INS),
    Rule("insult", 0.6, _ZH, "han"),
    _zh("address", 1.0, r"操你[妈媽大]|[草肏艹]你[妈媽]|日你[妈媽]|去你[妈媽]的|滚你[妈媽]|你[妈媽]的[,，!！ ]|你[妈媽](?:逼|死了)|fuck你|(?<![a-z])(?:cnm|nmsl|tmd你)(?![a-z])|你(?:给我)?去死(?!亡)|去死吧|死全家|全家死[光绝]|不得好死|生儿子没屁眼"),
    _zh("address", 0.7, r"(?:闭嘴|住口|滚开|滚蛋|滚出去|滚回|给我滚|快滚)(?:[,，!！ ]|$)|妈的[,，]|他妈的|给我跪下|没人问你"),
    _zh("tone", 0.6, r"你(?:们)?(?:这个|这种|这群|这帮|就是个|就是一个|真是个|真是|是个|个)|又是这个|的人是|的人都是|只有[^。!?！？\n]{1,12}才会|大骂|骂道|吼道|骂他|骂她", False),
    _zh("address", 0.6, r"^[\W_]*(?:你|呸|哼|臭|死)?(?:" + _ZH + r")[\W_]*$"),
    _zh("address", 0.6, r"[你他她您](?:们)?[^。,，!！?？\n]{0,4}?(?:是|像|叫)(?:个|一?[群帮个])?(?:" + _ZH + r")|[这那][帮群](?:" + _ZH + r")"),
    Rule("address", 0.6, rf"{_B}(?:ты|вы|он|она|они|вот)(?: [а-яё]+){{0,2}}? {_INS}|{_B}(?:du|er|sie|ihr) (?:bist|ist|seid|sind) (?:so |doch |nur )?(?:ein |eine |einfach )?{_INS}|{_B}(?:él|ella|ese|esa|usted|ustedes|ellos) (?:es|son) (?:un |una |unos |unas )?{_INS}|{_B}(?:il|elle|ce type|vous|ils) (?:est|êtes|sont) (?:un |une |des )?{_INS}"),
    _zh("address", 0.6, r"黙れ|出て行け|失せろ|消えろ|死ね|お前[はらが]|てめ[えぇー]|貴様"),
    Rule("address", 0.6, rf"{_B}(?:ferme ta gueule|ta gueule|va te faire|nique ta|tu es un|espèce d|cállate|eres (?:un|una)|vete a|que te jodan|tu puta madre|заткнись|пошёл|пошел|иди на|ты (?:полный|просто|такой|же)|чтоб ты|du bist ein|halt die|verpiss dich|halt's maul)"),
    # threats and wishes of harm against persons
    Rule("harm", 0.6, rf"{_B}{_HARM}"),
    Rule("harm", 1.0, rf"{_B}crawl back (?:under|into|to) your|{_B}do (?:everyone|us all|the world) a favou?r and (?:stop breathing|die|disappear|jump|kill)|(?:^|[,;:\"“”] ?|(?:just|please|and|should) )go (?:die|drown|choke){_E}"),
    Rule("harm", 1.0, rf"{_B}(?:i|we|they|someone|somebody)(?:'ll|’ll| will| am going to|'m going to|’m going to|'re going to| are going to| is going to| gonna|'m gonna| want to| wanna| would love to| should|'d like to|'d love to) (?:(?:find|come|personally|fucking|really|and|to|you) )*(?:(?:kill|murder|rape|stab|strangle|slaughter|torture|behead|gut|lynch) (?:you|him|her|them|your|every|all)|(?:choke|beat|hurt|hang|burn|bury|destroy|drown|punch|smash|break) (?:you|your)(?! (?:at|to|by|a|an)\b)){_E}(?! with kindness)"),
    Rule("harm", 1.0, rf"{_B}(?:i|we) (?:hope|wish|pray) (?:that )?(?:you|he|she|they|your [a-z]+|all of (?:you|them)|it kills you) (?:(?:all|just|both|slowly|will|would|really|only|get to) )*(?:dies?|died|suffers?|rots?|burns?|chokes?|bleeds?|drowns?|perish(?:es)?|gets? (?:cancer|hit by|run over|raped|shot|sick)|were dead|was dead|never (?:wake|walk|come home|recover)){_E}"),
    Rule("harm", 1.0, rf"{_B}(?:you|he|she|they|people like [a-z]+|(?:all|those|these) [a-z]+)(?: all)? (?:deserves?|ought|needs?) to (?:die|rot|suffer|bleed|be (?:shot|killed|hanged|raped|beaten|whipped|exterminated|put down)|burn)"),
    Rule("harm", 1.0, rf"{_B}(?:no ?body|no ?one|none of us) (?:would|will|'d) (?:even )?(?:miss|mourn|cry for|notice) (?:you|him|her|if you (?:died|were dead|vanished|disappeared))"),
    Rule("person", 0.5, rf"{_B}(?:{_SPOKEN_TO}|him|her|them|each of you|your){_E}", carries=False),
    _zh("harm", 1.0, r"(?:你|你们|像你|这种人|剪这段|写这句|做这个|家伙|全家)[^。!?！？\n]{0,16}(?:去死|死光|断气|打断|拖出去|烂在|跳下去|放屁|恶心死|不得好死|不配活|浪费空气|揍死|挨揍|砍死|弄死|杀了|挨打|别回来|后悔了|下地狱|见鬼去|抽死|打死|该死$|都该死|枪毙)"),
    _zh("harm", 1.0, r"看见你[^。\n]{0,10}(?:想吐|恶心)|滚回你|(?:打断|砍断|剁了)[^。\n]{0,6}(?:手|腿|脖子)|把你的(?:手|腿|头|嘴)[^。\n]{0,4}(?:打断|砍|剁|撕)|你怎么不(?:去死|跳)|真?希望你[^。\n]{0,12}(?:别回来|死|出事)|祝你[^。\n]{0,6}(?:死|完蛋|断子)|劝你[^。\n]{0,10}(?:跳|死)|迟早被人|(?:弄|打|掐|砍)死你|宰了你|杀了?你|强奸你|杀了你全家|生你的时候|揍你"),
    Rule("harm", 1.0, rf"{_B}(?:tu ferais mieux de crever|crève|ojalá (?:no despiertes|te mueras|revientes)|muérete|te voy a matar|je vais te tuer|ich bring dich um|du sollst verrecken|verrecke){_E}|сдохни|чтоб ты сдох|убью тебя|лучше бы ты (?:сдох|умер)"),
    _zh("harm", 1.0, r"死ねばいい|殺してやる|ぶっ殺"),
    # dehumanising groups
    Rule("dehumanise", 1.0, rf"{_B}{_MANY} [^.!?\n]{{2,40}}?{_B}(?:are|is) (?:all |nothing but |just )?(?:vermin|filth|animals|parasites|cockroaches|rats|subhuman|savages|scum|a disease|a plague|thie(?:f|ves) by blood|a thief by blood|born (?:liars|thieves|criminals)){_E}"),
    Rule("dehumanise", 1.0, rf"{_B}(?:all|every|those|these|most) (?:the |of the |of them |these |those )?(?:fucking |damn |dirty )?(?:{_GROUP}|{_PEOPLE}) (?:are|is) (?:all |nothing but |just |such |a bunch of |fucking )*(?:{_INS}|{_BASE}{_E})"),
    Rule("dehumanise", 1.0, rf"{_B}(?:kill|exterminate|gas|deport|hang|shoot|lynch|burn|wipe out|get rid of|eradicate|cleanse us of|castrate|sterili[sz]e) (?:(?:all|every|the|those|these|of|fucking|damn|dirty|last) )+{_GROUP}{_E}"),
    Rule("dehumanise", 1.0, rf"{_B}(?:are|is) (?:vermin|subhuman|born (?:liars|thieves|criminals)|a thief by blood|thieves by blood)|{_B}should (?:all )?be (?:sterili[sz]ed|thrown out|exterminated|wiped out|deported|gassed|caged)|{_B}carry diseases?{_E}[^.\n]{{0,30}}burn|{_B}bre(?:d|ed) like (?:rats|rabbits|vermin)|{_B}in cages{_E}|{_B}in (?:the kitchen or in )?chains{_E}|{_B}left alive{_E}|{_B}smell like animals|{_B}ha(?:ve|s) (?:a )?smaller brains?|{_B}do(?:es)? not deserve to be treated as humans?|{_B}ruin every (?:street|town|place)|{_B}are not (?:really )?human|{_B}away from our children, they are|{_B}never hire one{_E}|{_B}go back to (?:your|their) (?:country|cave|jungle|village)|{_B}belong in (?:the kitchen|a zoo|cages|camps|the gas)"),
    _zh("dehumanise", 1.0, r"都是(?:害虫|寄生虫|老鼠|蟑螂|畜生|垃圾|小偷|骗子|罪犯|婊子|贱人|贱货|强盗)|全部?赶出去|跟(?:牲口|畜生|猪狗)没(?:两样|区别)|不配当人|不配做人|断子绝孙|关进笼子|要是没有[^。\n]{1,14}(?:干净|太平|清净)|走到哪脏到哪|低人一等|天生就是(?:小偷|骗子|贼|坏种)|骨子里(?:脏|坏)|身上都带病|脑子天生|生下来就(?:低|贱|坏)|别录用|滚回(?:老家|你们)|全部?杀光|杀光(?:所有|那些|这些|他们)|灭绝|(?:所有|那些|这些)[^。\n]{1,8}(?:都该死|都去死|死光)"),
    Rule("dehumanise", 1.0, rf"{_B}son (?:unas |unos |todos |todas )?(?:ratas|cucarachas|escoria|parásitos|basura){_E}|{_B}que se larguen|{_B}sont (?:de la |des |tous des )?(?:vermine|cafards|rats|parasites|ordures){_E}|(?:—|это|все)\s*(?:паразиты|крысы|мусор|твари|скот)|гнать их вон"),
    _zh("dehumanise", 1.0, r"(?:全員|みんな)(?:害虫|ゴミ|クズ|寄生虫)|人は害虫"),
    # explicit
    Rule("explicit", 1.0, rf"{_B}masturbat|{_B}fondl[a-z]+ (?:and|her|him|his)|{_B}(?:have|has|having|had) (?:rough |oral |anal |wild )?(?:sex|intercourse){_E}(?! (?:education|ed|appeal|work|scenes?|talk))|{_B}(?:oral|anal) sex{_E}|{_B}boner{_E}|{_B}panties{_E}|{_B}begs? for more|{_B}porn(?!hub\.com is blocked)|{_B}send (?:me )?(?:your )?nudes{_E}|{_B}nudes of{_E}|{_B}legs spread|{_B}spread (?:her|his|their|your) legs|{_B}blow ?job|{_B}hand ?job|{_B}orgasm|{_B}cum(?:s|ming|shot)?{_E}(?! laude)|{_B}jerk(?:s|ing)? off|{_B}gang ?bang|{_B}dildo|{_B}deep ?throat(?:s|ed|ing)?{_E}"),
    Rule("explicit", 1.0, rf"{_B}her tits{_E}|{_B}show (?:me )?(?:more of )?(?:her|your) (?:bare )?(?:tits|breasts|ass|pussy)|{_B}touch(?:es|ing)? (?:herself|himself)|{_B}lick(?:s|ing)? (?:every part|her|his|my) (?:pussy|cock|dick|ass|clit|nipples|neck down|body|thigh)|{_B}lick every part|{_B}rough and from behind|{_B}camera between the thighs|{_B}rides? (?:him|her) hard|{_B}moaning loudly|{_B}{_FUCK}(?:s|ed|ing)? (?:her|him|hard|me){_E}|{_B}pussy{_E}(?![ -](?:willow|cat|foot))|{_B}bare breasts|{_B}suck(?:s|ed|ing)? (?:his|my|your) (?:cock|dick)|{_B}(?:hard|wet|throbbing) (?:cock|dick|pussy){_E}|{_B}rap(?:e|es|ed|ing) (?:her|him|you|the (?:girl|woman|boy|man)){_E}|{_B}both of them climax"),
    Rule("nude", 0.5, rf"{_B}naked{_E}(?! eye)|{_B}stripped bare{_E}|{_B}strips? naked{_E}|{_B}topless{_E}|{_B}undress(?:es|ed)?{_E}|{_B}fully (?:exposed|explicit|nude){_E}|{_B}nothing covered{_E}|{_B}no blanket{_E}"),
    Rule("nude", 0.5, rf"{_B}(?:sucks?|fondles?|moans?|gasps? with pleasure|thrusts?|climax(?:es|ed)?){_E}(?! of the| arrives| comes| is )|{_B}from behind{_E}|{_B}between (?:her|his|the) thighs{_E}|{_B}on the sofa{_E}.*{_B}moan"),
    _zh("explicit", 1.0, r"自慰|手淫|做爱|口交|肛交|性交|呻吟|爱抚|射了|射精|从后面再来|腿张开|张开(?:双)?腿|裸照|全裸|黄片|色情片|a片|乳房|奶子|下体|阴(?:道|茎|部)|(?:达到|到了|一起|同时|来了)高潮|高潮了|都硬了|露(?:点|出)胸|多露|脱光|脱得精光|舔(?:她|他|遍)|骑在(?:他|她)身上|做愛|強姦|强奸|轮奸|肉棒|内射|裸聊|约炮|打飞机|骚逼|操(?:她|他|我)"),
    Rule("explicit", 1.0, rf"{_B}follan?{_E}|{_B}follar{_E}|{_B}se masturban?{_E}|{_B}baisent nus|{_B}baiser nus|{_B}se masturbent?{_E}|занима[а-я]+ сексом|мастурбир|трахаю?т"),
    _zh("explicit", 1.0, r"セックス|オナニー|喘(?:ぐ|ぎ)|フェラ|中出し"),
    # quoted and reported wording counts as wording: it makes an insult an address to somebody
    Rule("reported", 0.3, rf"{_B}(?:yelled|shouted|said|wrote|whispers?|screamed|writes){_E}", carries=False),
    _zh("reported", 0.3, r"[说骂喊写叫][道:]?[:,]?[“\"]|反馈原文", False),
    # uses without offence, what is denied, and notes about such content
    Rule("neutral", -1.0, rf"{_B}(?:idiot|dumb|cretin) board|{_B}idiot[ -]?proof|{_B}kill (?:the|that|all|this) (?:the )?(?:background|noise|music|lights?|sound|audio|mic|hum|process|switch|engine|shot|scene)|{_B}naked eye|{_B}barbie|{_B}breast ?stroke|{_B}chicken breasts?|{_B}climax of the|{_B}spank the rug|{_B}strip the paint|{_B}same old jerk|{_B}jerk (?:chicken|sauce|seasoning|motion|spice)|{_B}cum laude|{_B}pussy ?willow|{_B}drop dead (?:gorgeous|date)|{_B}scum (?:line|layer)|{_B}pond scum|{_B}swine (?:flu|fever)|{_B}prick(?:s|ed)? (?:his|her|my|your|the|a) (?:finger|thumb|ears|balloon)"),
    Rule("neutral", -1.0, rf"(?:^|[,;:\"“”(] ?|{_B}(?:and|but|because|that) )(?:(?:the|this|that|these|those|your|our|my|whole|entire|final|last|first|second|third|all|of) )*{_THING} (?:is|are|was|were|looks?|sounds?|feels?)(?: like)? (?:(?:a|such|just|complete|total|utter|absolute|real|fucking|pure) )*(?:piece of )?(?:shit|crap|garbage|trash){_E}"),
    Rule("negation", -1.0, rf"{_B}(?:are|is|was|were|am|'m|'re|'s|’m|’re|’s)(?:n't|n’t| not| never| by no means)(?! (?:just|only|merely|simply|even|really|an? ))(?: [a-z]+){{0,2}}? {_INS}|{_B}(?:are|is|was|were|am|'m|'re|'s|’m|’re|’s)(?:n't|n’t| not| never| by no means) (?:really )?(?:an?|the|such an?|some) (?:[a-z]+ ){{0,2}}?{_INS}|{_B}(?:are|is|'re)(?:n't| not) (?:stupid|dumb|ugly|worthless|pathetic|garbage|trash)"),
    Rule("negation", -1.0, rf"{_B}(?:no eres|no es|no soy|no son|n'es pas|n'est pas|не|kein|keine) (?:un |une |una |des )?{_INS}"),
    Rule("denial", -2.0, rf"{_B}(?:nobody|no one|noone) (?:ever )?(?:said|says|called|calls|thinks|meant){_E}|{_B}(?:(?:i|we|he|she|they|it)(?: am| are| is| was| were| did| do| does| have| has| had| would|'m|'re|'s|'d|'ve|’m|’re)?(?: not|n't|n’t| never))(?: actually| really| ever| even)? (?:saying|said|say|calling|called|call|suggesting|implying|imply|claiming|claimed|mean|meant){_E}"),
    Rule("negation", -1.0, rf"{_B}(?:would|will|could|does|do|did|must|can)(?:n't|n’t| not| never) (?:(?:ever|want|to|really|going|try|dare|let|anyone) ){{0,3}}(?:kill|hurt|rape|slap|punch|stab|beat|shoot|strangle|choke|hang|murder|burn) (?:you|him|her|them|anyone|anybody|yourself){_E}|{_B}never (?:want(?:ed)? to |meant to |going to |tried to |try to )?(?:kill|hurt|rape|slap|punch|stab|beat|shoot|strangle|choke|murder) (?:you|him|her|them|anyone){_E}|{_B}no ?(?:body|one) (?:should|deserves to) [a-z ]{{0,12}}?(?:die|suffer|be (?:killed|beaten|raped|shot|hurt|called [a-z ]+))"),
    _zh("negation", -1.0, r"(?<![是还就])(?:不是|并非|不算|没人骂|没说|没有说|没骂|从没说|不该骂|别骂|不要骂)[^,，。]{0,6}?(?:" + _ZH + r")(?![^。]{0,3}(?:是什么|吗|嘛))|(?:" + _ZH + r")(?:じゃない|ではない|でない)(?!か)"),
    _zh("neutral", -1.0, r"白痴板|垃圾(?:分类|桶|车|堆|袋|场|站|箱)|废物利用|傻瓜(?:相机|式)|神经病学|鸡胸|热狗|死机|裸眼|肉色|性别|性格|性能|高潮(?:迭起|部分|段落|戏|来得)|(?:剧情|音乐|故事|情节|最后的?)高潮|(?:镜头|画面|视频|片段?|台词|音乐|字幕|特效|结果|内容|作品|素材|音效|配音)[^。,，\n人你您他她者]{0,4}是垃圾"),
    Rule("rule", -2.0, rf"{_B}(?:no|without|avoid|never any|must not|may not|do not (?:show|use)|free of) (?:any )?(?:nudity|insults?|violence|slurs?|porn\w*|sex|profanity|hate|abuse|naked|explicit)|{_B}(?:slurs?|insults?|abuse|profanity|comments?){_E}[^.\n]{{0,40}}{_B}(?:removed|deleted|filtered|blocked|hidden|flagged){_E}|{_B}moderation note"),
    _zh("rule", -2.0, r"(?:不得|禁止|不要|不能|避免|严禁|不允许)(?:出现|有|使用|含有)?[^。\n]{0,12}(?:裸露|辱骂|歧视|色情|暴力|脏话|低俗)|(?:辱骂|脏话|色情|歧视)[^。\n]{0,16}(?:删除|屏蔽|过滤|移除|清理)|审核说明"),
)


# ---- what a pattern needs ------------------------------------------------------------------------------------------
#: words as common as these tell nothing
_COMMON = frozenset(
    map(
        squeeze,
        "you u ya your he she they him her them all every those these most the this that it is are was were be must 's 're ’s ’re an a i we no on in of only what such like look looks sound sounds nothing but "
        "say says said saying wrote writes call calls called shot shoot has have had not never men people so just really should would will did does do".split(),
    )
)
_MOST = 4_000


def _finite(items) -> set[str] | None:
    """All strings of a part of a pattern, where they are few; assertions add nothing."""
    out = {""}
    for kind, arg in items:
        if kind is C.LITERAL:
            more = {chr(arg)}
        elif kind is C.IN and len(arg) <= 24 and all(k is C.LITERAL for k, _ in arg):
            more = {chr(a) for _, a in arg}
        elif kind is C.SUBPATTERN:
            more = _finite(arg[3])
        elif kind is C.BRANCH:
            parts = [_finite(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            more = _finite(arg[2])
            more = more | {""} if more is not None and arg[0] == 0 else more
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            more = {""}
        else:
            return None
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _rarity(found: set[str]) -> float:
    return min((sum(1.5 if c > "\u2e80" else 1.0 for w in re.split(r"[\s:,\"“'‘]+", s) if w not in _COMMON for c in w) for s in found), default=0.0)


def _needed(items) -> set[str] | None:
    best: set[str] | None = None

    def consider(found: set[str] | None) -> None:
        nonlocal best
        if found and "" not in found and (best is None or (_rarity(found), -len(found)) > (_rarity(best), -len(best))):
            best = found

    run = {""}
    for kind, arg in items:
        optional = kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0
        exact = None if optional else _finite([(kind, arg)])
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a in run for b in exact}
            continue
        consider(run)
        run = {""}
        if exact is not None:
            run = exact
        elif kind is C.SUBPATTERN:
            consider(_needed(arg[3]))
        elif kind is C.BRANCH:
            parts = [_needed(b) for b in arg[1]]
            consider(None if None in parts else set().union(*parts))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and not optional:
            consider(_needed(arg[2]))
    consider(run)
    return best


@lru_cache(None)
def needed(pattern: str) -> frozenset[str]:
    """Strings of which every match of the pattern holds one: derived from the pattern, the rarer part of it first."""
    found = _needed(_parser.parse(pattern))
    if not found:
        raise ValueError(f"nothing is needed for {pattern!r}")
    # a string that holds another one of them adds nothing
    return frozenset(s for s in found if not any(o != s and o in s for o in found))


_SPLIT = re.compile(r"[\n。！？!?;；]+|\.(?=\s|\"|”|$)|\\n")

#: what a ban goes on to behind a comma: a further item of its list, not a sentence about somebody
_ITEM = re.compile(r"\s*(?:(?:and|or|nor|no|not|without|any|including|such as)\b|[或和及、不禁]|以及|也不|严禁|避免|包括|(?:[a-z'\-]+ ?){1,3}$)")
_SOMEBODY = re.compile(rf"\b(?:i|he|she|they|we|it|this|that)\b|[你您妳他她我]|{_B}(?:{_SPOKEN_TO}|him|her|them){_E}")
_COMMA = re.compile("[,，]")
_BUT = re.compile(r"[,，;]|\bbut\b|\byet\b")
#: governs all that follows in its clause
_NOTE = re.compile("moderation note|审核说明")


def _ban_end(text: str, end: int) -> int:
    """Where the list that a ban at text[..end] governs ends."""
    comma = _COMMA.search(text, end)
    while comma:
        following = _COMMA.search(text, comma.end())
        part = text[comma.end() : following.start() if following else len(text)]
        if not _ITEM.match(part) or _SOMEBODY.search(part):
            return comma.start()
        comma = following
    return len(text)


class _Literals:
    """Whether a text holds one of many literals, for alphabets of thousands of letters: each literal is looked for only
    if the text has its letter that is none of the most usual ones and that the fewest literals have."""

    # Fixed value: the most usual Han letters, digits and marks.
    USUAL = frozenset("的一是不了人我在有他这中大来上个们到说时要就出会可也你对生能而子那得于着下自之年过后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日")


    def __init__(self, literals: set[str]):
        common: dict[str, int] = {}
        for a in literals:
            for c in set(a):
                common[c] = common.get(c, 0) + 1
        self.by: dict[str, list[str]] = {}
        for a in literals:
            self.by.setdefault(min(a, key=lambda c: (c in self.USUAL or not c.isalpha(), common[c], c)), []).append(a)

    def __call__(self, text: str) -> bool:
        return any(a in text for c in self.by.keys() & set(text) for a in self.by[c])


class Grammar:
    """The composed transducers; `score(text)` is the weight of the heaviest clause."""

    VIEW_OF = {"folded": undisguised, "han": closed_up}
    VIEWS = tuple(VIEW_OF)

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.index = {v: self._automaton([i for i, r in enumerate(rules) if r.view == v]) for v in self.VIEWS}
        carry = {v: [i for i, r in enumerate(rules) if r.view == v and r.weight > 0 and r.carries] for v in self.VIEWS}
        folded = self._automaton(carry["folded"])
        han = _Literals({a for i in carry["han"] for a in needed(rules[i].source)}.union(_han_closed(_HAN_CLEAR)))
        self.trigger = {"folded": lambda t: next(folded.iter(t), None) is not None, "han": han}

    def _automaton(self, chosen):
        import ahocorasick

        by: dict[str, set[int]] = {}
        for i in chosen:
            for a in needed(self.rules[i].source):
                by.setdefault(a, set()).add(i)
        found = ahocorasick.Automaton()
        for a, ids in by.items():
            found.add_word(a, ids)
        found.make_automaton()
        return found

    def views(self, text: str) -> dict[str, str]:
        return {v: f(text) for v, f in self.VIEW_OF.items()}

    def active(self, text: str, views: dict[str, str]) -> list[str]:
        """The views in which something can carry a clause."""
        return [v for v, t in views.items() if self.trigger[v](t) or v == "han" and _MASKED_HAN.search(text)]

    def triggered(self, text: str, views: dict[str, str]) -> bool:
        return bool(self.active(text, views))

    def clauses(self, plain: str) -> list[str]:
        return [c for c in _SPLIT.split(plain) if c and c.strip()]

    def candidates(self, views: dict[str, str]) -> list[Rule]:
        """Patterns that can hold in the views."""
        found: set[int] = set()
        for v, t in views.items():
            for _, ids in self.index[v].iter(t):
                found |= ids
        return [self.rules[i] for i in sorted(found)]

    def tags(self, clause: str, active: list[str] | None = None) -> list[tuple[str, float, str]]:
        """Weighted tags of one clause; `active` are the views in which its text can hold what carries."""
        if active is not None and len(active) == 1:
            view = active[0]
            if not self.triggered(clause, {view: self.VIEW_OF[view](clause)}):
                return []
        views = self.views(clause)
        if not self.triggered(clause, views):
            return []
        rules = self.candidates(views)
        out = []
        for view in self.VIEWS:
            views[view], found = self.cancelled(views[view], [r for r in rules if r.weight < 0 and r.view == view])
            out += found
        for r in rules:
            if r.weight >= 0 and (m := r.regex.search(views[r.view])):
                out.append((r.tag, r.weight, m[0]))
        kinds = {t for t, _, _ in out}
        if kinds & {"address", "tone"} and "insult" not in kinds and (m := _ZH_MASKED.search(clause) or _ZH_MASKED.search(views["han"])):
            out.append(("insult", 0.6, m[0]))
        return out

    def cancelled(self, text: str, rules: list[Rule]) -> tuple[str, list[tuple[str, float, str]]]:
        """text with what neutral uses and negations span and what denials, notes and bans govern blanked: no other tag is
        found in there."""
        spans, out = [], []
        for r in rules:
            for m in r.regex.finditer(text):
                end = m.end()
                if r.tag == "rule":
                    end = len(text) if _NOTE.search(m[0]) else _ban_end(text, end)
                elif r.tag == "denial":
                    stop = _BUT.search(text, end)
                    end = stop.start() if stop else len(text)
                spans.append((m.start(), end))
                out.append((r.tag, r.weight, m[0]))
        for a, b in spans:
            text = text[:a] + "\0" * (b - a) + text[b:]
        return text, out

    def accept(self, tags: list[tuple[str, float, str]]) -> float:
        """Weight of a clause: what stands together counts together. Negations, neutral uses and rules have cancelled the
        tags in their reach already and take nothing from the others."""
        w: dict[str, float] = {}
        for tag, weight, _ in tags:
            if weight >= 0:
                w[tag] = min(w.get(tag, 0.0) + weight, 1.6)
        insult = w.get("insult", 0.0) + w.get("address", 0.0)
        if "insult" in w:
            insult += w.get("reported", 0.0)
        if insult:
            insult += w.get("tone", 0.0)
        harm = w.get("harm", 0.0) + (w.get("person", 0.0) if "harm" in w else 0.0)
        sexual = w.get("explicit", 0.0) + w.get("nude", 0.0)
        return round(max(insult, harm, w.get("dehumanise", 0.0), w.get("slur", 0.0), sexual), 6)

    def plain(self, text: str) -> str:
        return text.lower() if text.isascii() else own_alphabet(widths(text)).lower()

    def score(self, text: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        plain = self.plain(text)
        if "!" in plain:  # one that stands for a letter must not end it either
            plain = _BANG.sub(_banged, plain)
        if "." in plain:  # a full stop put inside a word must not end its clause
            plain = re.sub(r"(?<=[^\W\d_])\.(?=[^\W\d_])", "", plain)
        # a written \\n ends a clause, so the word behind it begins there
        whole = plain.replace("\\n", "\n")
        active = self.active(whole, self.views(whole))
        if not active:
            return 0.0
        return max((self.accept(self.tags(c, active)) for c in dict.fromkeys(self.clauses(plain))), default=0.0)


@lru_cache(1)
def grammar() -> Grammar:
    return Grammar()


def offence_score(texts: pd.Series) -> pd.Series:
    g = grammar()
    known = {t: g.score(t) for t in dict.fromkeys(texts)}
    return pd.Series([known[t] for t in texts], dtype="float64")


def score_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """df with offence_score DOUBLE, at least 0: the weight of the worst clause; null, empty and blank texts score 0,
    long texts are scored whole, clause by clause, repeated rows alike; a column of that name is replaced."""
    # not deterministic: else a filter on the score, and the scoring with it, would be moved below a repartition
    score = F.pandas_udf(offence_score, T.DoubleType()).asNondeterministic()
    return df.withColumn("offence_score", score(F.col(text)))


def source_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, offensive documents and their rate by source, null sources as one."""
    hit = F.col("offence_score") >= threshold
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if(hit).alias("offensive"), F.avg(hit.cast("double")).alias("rate"))
