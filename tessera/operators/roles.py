"""Who is to say what in a prompt: declared roles with their other names and images, and the lines given to them.

Only lines that the text itself gives to a role are taken; a quotation without one is no line. A prompt is read once into
declarations (a role, an image number, the form they stand in); names and images are folds over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, functions as F

# ---- Fixed values: forms, word lists and windows of the annotation format -------------------------------------------
_NAME = r"[\w㐀-鿿·]{1,24}"
QUOTED = re.compile(r"[\"“]([^\"”\n]{1,240})[\"”]")
UNQUOTED = re.compile(r"(?:说(?:道|到)?|问(?:道)?|回答|喊(?:道)?|低声说|大声说|急喊|高喊|大喊)\s*[：:]\s*([^\n]{1,240})")
MENTION = re.compile(rf"@({_NAME})")
IMAGE_IS_ROLE = re.compile(rf"@(?:图片|图)\s*(\d+)\s*(?:为|是|=)\s*({_NAME})")
ROLE_WITH_IMAGE = re.compile(r"([㐀-鿿A-Za-z·]{2,12})\s*(?:【\s*)?(?:图片|图)\s*(\d+)\s*】?")
SAYS = re.compile(r"([㐀-鿿A-Za-z][\w㐀-鿿·]{0,15})(?:\s*[（(][^）)]{0,30}[）)])?\s*(?:说(?:道)?|问(?:道)?|回答|喊(?:道)?|低声说|大声说)?\s*[：:]\s*$")
SAYS_ENDINGS = ("低声说", "大声说", "说道", "喊道", "回答", "说", "问")
CUE = re.compile(r"(厉声喝道|大声喝道|高声喝斥|颤着声问|厉声大喝|厉声道|低声道|说道|说到|问道|急喊|高喊|喊道|大喊|说|问|喊)\s*[：:]\s*$")
CALLS = ("急喊", "高喊")
MANNERS = ("厉声道", "低声道", "急喊", "高喊", "喊道", "大喊", "画外传来薛琴急促高喊")
ACTION = ("主体动作:", "主体动作：")
RANGE = re.compile(r"(\d+(?:\.\d+)?)\s*(?:s|秒)?\s*[-~至]\s*(\d+(?:\.\d+)?)\s*(?:s|秒)")
DIALOGUE = ("dialogue", "台词", "对白", "说：", "说道：", "说:")
CLOSED = ("dialogue：无", "dialogue:无", "台词：无", "台词:无", "对白：无", "对白:无", "不得有其他台词", "不要有其他台词", "无其他台词")
OPEN = ("自由发挥", "可自行发挥", "可即兴", "例如", "等台词")
TABLE = re.compile(r"视频角色对照表\s*[:：](.*?)(?=\n\s*视频(?:场景|角色|道具)对照表|\Z)", re.DOTALL)
TABLE_ROLE = re.compile(rf"(?:^|[；;，,])\s*({_NAME})\s*=")
TABLE_IMAGE = re.compile(rf"(?:^|[；;，,])\s*({_NAME})\s*=\s*【?\s*图\s*(\d+)\s*】?")
STATE = re.compile(rf"(?:【|[；;])\s*({_NAME}?)处于")
NO_CHARACTER = ("产品", "场景", "道具", "物品", "参考", "背景", "镜头", "画面", "位置")
FUNCTION_HEAD = re.compile("^(?:跟|和|与|及|由|为|是)")
FUNCTION_TAIL = re.compile("(?:始终|一直|仍然|依旧|正在)$")
IMAGE_NAME = re.compile(r"(?:图片|图)\d+")
CLAUSE_ENDS = "。！？；;，,\n"
MENTION_BEFORE, MENTION_AFTER, ROLE_WINDOW, ACTION_WINDOW, TIME_WINDOW = 80, 40, 220, 260, 900

_TURN = "struct<turn:int,role:string,rule:string,dialogue:string,start:int,end:int,start_sec:double,end_sec:double,images:array<int>>"
PLAN = f"scope string, roles array<string>, turns array<{_TURN}>"


def whole_role(phrase: str, known: list[str]) -> str:
    """The longest known role inside a phrase, or the phrase without function words at its ends."""
    bare = FUNCTION_TAIL.sub("", FUNCTION_HEAD.sub("", phrase.strip()))
    return max((k for k in known if k and k in bare), key=len, default=bare)


class Cast:
    """The roles that one prompt declares."""

    def __init__(self, text: str):
        self.text = text

    def declarations(self) -> Iterator[tuple[str, int | None, str]]:
        """(role or phrase, image number or None, form) in order of the forms' weight."""
        yield from ((m[2], int(m[1]), "assigned") for m in IMAGE_IS_ROLE.finditer(self.text))
        for m in MENTION.finditer(self.text):
            near = self.text[max(0, m.start() - MENTION_BEFORE) : m.end() + MENTION_AFTER].casefold()
            if not IMAGE_NAME.fullmatch(m[1]) and any(d in near for d in DIALOGUE):
                yield m[1], None, "mentioned"
        for table in TABLE.finditer(self.text):
            yield from ((m[1], None, "listed") for m in TABLE_ROLE.finditer(table[1]))
            yield from ((m[1], int(m[2]), "listed") for m in TABLE_IMAGE.finditer(table[1]))
        yield from ((m[1], None, "state") for m in STATE.finditer(self.text))
        yield from ((m[1], int(m[2]), "inline") for m in ROLE_WITH_IMAGE.finditer(self.text))

    @cached_property
    def names(self) -> dict[str, str]:
        """Every name of a role, images among them -> the role; the first declaration of a name holds."""
        found: dict[str, str] = {}
        for role, image, form in self.declarations():
            if form in ("state", "inline"):
                role = whole_role(role, list(dict.fromkeys(found.values())))
            if form == "inline" and (not role or any(w in role for w in NO_CHARACTER)):
                continue
            for name in (role,) if image is None else (role, f"图片{image}", f"图{image}"):
                found.setdefault(name, role)
        return found

    @cached_property
    def images(self) -> dict[str, list[int]]:
        """Images of each role in order, each once; mentions and states have none."""
        found: dict[str, list[int]] = {}
        for role, image, form in self.declarations():
            if image is None:
                continue
            if form == "inline":
                role = whole_role(role, list(found))
                if not role or any(w in role for w in NO_CHARACTER):
                    continue
            if image not in found.setdefault(role, []):
                found[role].append(image)
        return found

    # ---- who speaks before a place: rules in order, the first that finds somebody

    def speaker(self, at: int) -> tuple[str, str] | None:
        """(role, rule) of the line at a place, or None."""
        for rule in (self._mentioned, self._subject, self._named):
            hit = rule(at)
            if hit is not None:
                return hit if hit[0] else None
        return None

    def _mentioned(self, at: int) -> tuple[str, str] | None:
        before = self.text[max(0, at - ROLE_WINDOW) : at]
        people = [m for m in MENTION.findall(before) if not IMAGE_NAME.fullmatch(m)]
        return (people[-1], "mention") if people and any(d in before.casefold() for d in DIALOGUE) else None

    def _subject(self, at: int) -> tuple[str, str] | None:
        """The subject of the sentence that ends in a word of speech."""
        before = self.text[max(0, at - ACTION_WINDOW) : at]
        cue = CUE.search(before) if before.rstrip().endswith((":", "：")) else None
        if cue is None:
            return None
        places = sorted((before.rfind(name), role) for name, role in self.names.items() if name in before)
        if not places:
            return None
        action = max(before.rfind(a) for a in ACTION)
        acting = [p for p in places if p[0] > action >= 0]
        if acting:
            return (acting[-1] if cue[1] in CALLS else acting[0])[1], "subject"
        clause = max(before.rfind(c, 0, cue.start()) for c in CLAUSE_ENDS)
        # who is spoken to stands behind who speaks, so the first of the clause speaks
        inside = [p for p in places if p[0] > clause]
        return (inside[0] if inside else places[-1])[1], "subject"

    def _named(self, at: int) -> tuple[str, str] | None:
        """A name before a colon; where roles are declared it must be one of them."""
        before = self.text[max(0, at - ROLE_WINDOW) : at]
        said = SAYS.search(before) if before.rstrip().endswith((":", "：")) else None
        if said is None:
            return None
        ending = next((e for e in SAYS_ENDINGS if said[1].endswith(e) and len(said[1]) > len(e)), "")
        phrase = said[1].removesuffix(ending)
        if phrase in MANNERS:
            return None
        known = min(((phrase.find(n), -len(n), role) for n, role in self.names.items() if n in phrase), default=None)
        if known:
            return known[2], "known"
        return None if self.names else (phrase, "named")

    def lines(self) -> Iterator[tuple]:
        """The turns of the plan."""
        quoted = list(QUOTED.finditer(self.text))
        inside = lambda p: any(q.start() <= p < q.end() for q in quoted)
        loose = [m for m in UNQUOTED.finditer(self.text) if not inside(m.start(1)) and not m[1].lstrip().startswith(('"', "“"))]
        taken: set[tuple] = set()
        for m in sorted([*quoted, *loose], key=lambda m: m.start(1)):
            said = self.speaker(m.start() if m.re is QUOTED else m.start(1))
            words = m[1].strip().strip('"“”')
            # prose after a word of speech counts only for a declared role
            if said is None or not words or (m.re is UNQUOTED and said[0] not in self.names.values()) or (said[0], *m.span(1)) in taken:
                continue
            taken.add((said[0], *m.span(1)))
            times = RANGE.findall(self.text[max(0, m.start(1) - TIME_WINDOW) : m.start(1)])
            a, b = map(float, times[-1]) if times else (0.0, 0.0)
            yield (len(taken), *said, words, *m.span(1), a if b > a else None, b if b > a else None, self.images.get(said[0]))

    def scope(self, turns: int) -> str:
        plain = self.text.casefold().replace(" ", "")
        if not turns:
            return "none"
        shut = any(c in plain for c in CLOSED) or ("镜号" in self.text and ("dialogue" in plain or "台词" in self.text))
        return "closed" if shut and not any(o in plain for o in OPEN) else "partial"


def cast_plan(text: Column) -> Column:
    """STRUCT(scope, roles, turns): the lines that a prompt gives to its roles. scope is 'none' without lines, 'closed'
    where other speech is ruled out and nothing leaves room for it, else 'partial'. Each turn has its role, the rule
    that found it, the words, where they stand (from 0), the last stated time range before them if it has a length, and
    the images of the role (NULL where none is declared). NULL and empty texts have no turns; very long texts are read
    whole, lines and windows have the fixed lengths of the format."""
    fields = ("turn", "role", "rule", "dialogue", "start", "end", "start_sec", "end_sec", "images")

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            cast = Cast(t or "")
            turns = list(cast.lines())
            out.append((cast.scope(len(turns)), list(dict.fromkeys(x[1] for x in turns)), [dict(zip(fields, x)) for x in turns]))
        return pd.DataFrame(out, columns=["scope", "roles", "turns"])

    return F.pandas_udf(run, PLAN)(text)


def stands_there(text: Column, turn: Column) -> Column:
    """Whether the words of a turn stand in the text at the place that is stated: for plans that were kept and come
    back."""
    there = F.substring(text, turn["start"] + 1, turn["end"] - turn["start"])
    return F.regexp_replace(there, '^[\\s"“”]+|[\\s"“”]+$', "") == turn["dialogue"]
