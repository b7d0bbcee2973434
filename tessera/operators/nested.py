"""Deeply nested records as typed flat tables with parent links.

A deterministic bottom-up tree automaton reads every cell. Its states are the kinds of leaves, of holders (an array, one
object, a JSON string of either) and of objects: an object's state is its variant, made of its level, its known roles
with the kinds of their values, and the state of the holder of the next level. What a node yields is read off its state
alone: a state that holds nothing ends the descent, a state that holds one object or an array of objects passes them on.
Each accepted object is routed by its state to the typed subtype table of its variant's level; all tables keep the
common supertype key (record and four positions), and each but the first the key of its parent.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.strictjson import BAD, clean, fenced_blocks, gold_array, loads

LEVELS = ("issue", "evidence", "obs", "alt")
#: names of the field that holds the next level
CHILD = {"issue": ("证据", "evidence"), "evidence": ("观测", "observations"), "obs": ("候选", "alternatives")}
NEXT = dict(zip(LEVELS, LEVELS[1:]))

#: typed columns of the subtype tables: column -> (names of the field, type)
SUBTYPES = {
    "issue": {
        "localizable": (("可定位性", "localizable"), "string"),
        "confidence": (("置信度", "confidence"), "string"),
        "description": (("问题说明", "description"), "string"),
        "issue_type": (("问题类型", "issue_type"), "string"),
        "time_range": (("时间区间", "time_range"), "string"),
        "keyframe_sec": (("关键帧秒", "keyframe_sec"), "string"),
        "bbox": (("BBox", "bbox"), "string"),
    },
    "evidence": {"tool": (("工具", "tool"), "string"), "status": (("状态", "status"), "string"), "limits": (("限制", "limits"), "string")},
    "obs": {"at_sec": (("秒", "t"), "double"), "content": (("内容", "value"), "string"), "bbox": (("bbox",), "string")},
    "alt": {"text": (("文本", "text"), "string"), "score": (("得分", "score"), "double")},
}
POSITIONS = [f"{x}_pos" for x in LEVELS]
_KNOWN = {level: frozenset(n for names, _ in roles.values() for n in names) | frozenset(CHILD.get(level, ())) for level, roles in SUBTYPES.items()}

#: what a state holds
NOTHING, ONE, MANY = range(3)


class Tree(NamedTuple):
    """An object in the run of the automaton: its state and the objects of the next level that its holder passes on."""

    state: int
    obj: dict
    below: list[Tree]


class ShapeAutomaton:
    """The transition table and its states.

    A transition is (symbol, states below) -> state. Symbols are the kinds of leaves, `array`, `text` (a JSON string
    that holds JSON), `wrap`, and for objects the level with its roles; states below a node are those of its holder or, for
    an array, the set of what its elements are. The table is closed over the symbols met so far: a transition is
    worked out once and looked up from then on.
    """

    LEAVES = ("null", "bool", "num", "str", "absent")

    def __init__(self) -> None:
        self.table: dict[tuple, int] = {}
        self.name: list[str] = []
        self.holds: list[int] = []
        #: level of an object's state, None for other states
        self.route: list[str | None] = []
        for leaf in self.LEAVES:
            self.table[leaf, ()] = self._state(leaf, NOTHING, None)

    def _state(self, name: str, holds: int, route: str | None) -> int:
        self.name.append(name)
        self.holds.append(holds)
        self.route.append(route)
        return len(self.name) - 1

    def step(self, symbol: Any, below: tuple = ()) -> int:
        found = self.table.get((symbol, below))
        if found is None:
            found = self.table[symbol, below] = self._transition(symbol, below)
        return found

    def _transition(self, symbol: Any, below: tuple) -> int:
        if symbol == "array":
            (kinds,) = below
            return self._named("list" if kinds == {ONE} else "mixed" if ONE in kinds else "empty" if not kinds else "others", MANY if ONE in kinds else NOTHING, None)
        if symbol == "text":
            (q,) = below
            return self._named(f"text:{self.holder(q)}", self.holds[q], None) if self.holds[q] != NOTHING else self.table["str", ()]
        if symbol == "wrap":
            inner, beside = below
            return self._named(f"{'beside' if beside else 'wrapped'}:{self.name[inner]}", ONE, self.route[inner])
        level, roles, others = symbol
        parts = [f"{r}:{k}" for r, k in roles] + ([f"{NEXT[level]}:{self.holder(below[0])}"] if level in NEXT else [])
        return self._named(f"{level}({','.join(parts)}{'+' if others else ''})", ONE, level)

    def _named(self, name: str, holds: int, route: str | None) -> int:
        """One state a name: transitions that lead to the same name lead to the same state."""
        return self.name.index(name) if name in self.name else self._state(name, holds, route)

    def holder(self, q: int) -> str:
        return "one" if self.route[q] is not None else self.name[q]

    # ---- runs: from the leaves up, each node's state from those below it

    def leaf(self, value: Any) -> int:
        kind = "null" if value is None else "bool" if isinstance(value, bool) else "num" if isinstance(value, (int, float, Decimal)) else "str"
        return self.table[kind, ()]

    def holding(self, value: Any, level: str, unwrap: bool = False) -> tuple[int, list[Tree]]:
        """State of a holder of `level`, and the objects that its state passes on."""
        if isinstance(value, str):
            inner = loads(value)
            if isinstance(inner, (list, dict)):
                q, trees = self.holding(inner, level, unwrap)
                return self.step("text", (q,)), trees if self.holds[q] != NOTHING else []
            return self.table["str", ()], []
        if isinstance(value, dict):
            tree = self.object(value, level, unwrap)
            return tree.state, [tree]
        if isinstance(value, list):
            trees = [self.object(x, level, unwrap) for x in value if isinstance(x, dict)]
            kinds = {self.holds[t.state] for t in trees} | ({NOTHING} if len(trees) < len(value) else set())
            q = self.step("array", (frozenset(kinds),))
            return q, trees if self.holds[q] == MANY else []
        return self.leaf(value), []

    def object(self, obj: dict, level: str, unwrap: bool = False) -> Tree:
        if unwrap and "issue" in obj:
            q, inner = self.holding(obj["issue"], level)
            if self.holds[q] != NOTHING:
                return self._wrapped(obj, inner[0], level)
        roles = []
        for role, (names, _) in SUBTYPES[level].items():
            for n in names:
                if n in obj:
                    v = obj[n]
                    roles.append((role, "obj" if isinstance(v, dict) else "list" if isinstance(v, list) else self.name[self.leaf(v)]))
                    break
        q, below = self.holding(_child(obj, level), NEXT[level]) if level in NEXT else (self.table["absent", ()], [])
        others = not _KNOWN[level].issuperset(obj)
        return Tree(self.step((level, tuple(roles), others), (q,)), obj, below)

    def _wrapped(self, outer: dict, inner: Tree, level: str) -> Tree:
        """An issue wrapped as `issue`: what it holds is in it, in `provenance` beside it, or in the wrapping."""
        if _child(inner.obj, level) is not None:
            return Tree(self.step("wrap", (inner.state, False)), inner.obj, inner.below)
        q, beside = self.holding(outer.get("provenance"), level)
        source = beside[0] if self.holds[q] != NOTHING and _child(beside[0].obj, level) is not None else None
        below = source.below if source else self.holding(_child(outer, level), NEXT[level])[1]
        return Tree(self.step("wrap", (inner.state, source is not None)), inner.obj, below)

    def run(self, kind: str, text: Any) -> list[Tree]:
        """The accepted issues of a cell."""
        q, trees = self.holding(gold_array(text) if kind == "gold" else prediction_value(text), "issue", True)
        return trees if self.holds[q] != NOTHING else []

    def routed(self, trees: list[Tree]) -> Iterator[tuple[str, int, tuple[int, ...], dict]]:
        """(table, state, key, object) of every accepted object, parents first."""
        level = [(t, (k,)) for k, t in enumerate(trees, 1)]
        while level:
            for t, key in level:
                yield self.route[t.state], t.state, key, t.obj
            level = [(b, (*key, k)) for t, key in level for k, b in enumerate(t.below, 1)]


def _child(obj: dict, level: str) -> Any:
    """The value of the next level under its first name that is present and not null."""
    for name in CHILD.get(level, ()):
        if obj.get(name) is not None:
            return obj[name]
    return None


def prediction_value(text: Any) -> Any:
    """Where the issues of a prediction stand: JSON as it is, in one fence, in JSON strings of any number, or under
    `issues`; None where nothing parses."""
    while isinstance(text, str):
        value = loads(text)
        if value is BAD:
            whole = text.strip()
            blocks = fenced_blocks(whole) if whole.startswith("```") and whole.endswith("```") else []
            if len(blocks) != 1:
                return None
            text = blocks[0]
        elif isinstance(value, str):
            text = value
        else:
            return value["issues"] if isinstance(value, dict) and "issues" in value else value
    return None


def _text(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    if isinstance(value, Decimal):
        value = str(value)
    if not isinstance(value, str):
        try:
            value = json.dumps(value, ensure_ascii=False, default=str, separators=(",", ":"))
        except RecursionError:
            value = None
    return clean(value) if value else value


def _field(obj: dict, names: Iterable[str]) -> str | None:
    return next((_text(obj[n]) for n in names if obj.get(n) is not None), None)


def _struct(level: str, typed: bool) -> str:
    columns = ["variant string", *[f"{p} int" for p in POSITIONS], *([f"{c} string" for c in SUBTYPES[level]] if typed else [])]
    return f"array<struct<{','.join(c.replace(' ', ':') for c in columns)}>>"


def nested_tables(df: DataFrame, kind: str, key: str, cell: str, typed: bool = True) -> DataFrame:
    """One row a record: record_kind, record_id, and for each of LEVELS an array of that subtype's objects (variant, the
    four positions, and with `typed` the subtype's fields as text), as the automaton routed them.

    Positions count from 1 in their parent and are 0 below the object's own level. Null, empty and unparseable cells
    have empty arrays; repeated records yield equal rows (callers that count use distinct keys); cells of any length
    and depth are parsed whole; a field nested too deep to be printed is NULL; halves of characters become U+FFFD.
    Rows without a key have no row here. Other columns of df, whatever their names, are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ShapeAutomaton()
        for batch in batches:
            ids, cells = batch.column(0), batch.column(1).to_pylist()
            offsets = {x: [0] for x in LEVELS}
            data: dict[str, list[list]] = {x: [[] for _ in range(5 + (len(SUBTYPES[x]) if typed else 0))] for x in LEVELS}
            for text in cells:
                for level, state, at, obj in auto.routed(auto.run(kind, text)):
                    cols = data[level]
                    cols[0].append(auto.name[state])
                    for c, p in zip(cols[1:5], (*at, 0, 0, 0)):
                        c.append(p)
                    if typed:
                        for c, (names, _) in zip(cols[5:], SUBTYPES[level].values()):
                            c.append(_field(obj, names))
                for level in LEVELS:
                    offsets[level].append(len(data[level][0]))
            out = [ids]
            for level in LEVELS:
                names = ["variant", *POSITIONS, *(SUBTYPES[level] if typed else ())]
                types = [pa.string(), *[pa.int32()] * 4, *[pa.string()] * (len(names) - 5)]
                struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(data[level], types)], names=names)
                out.append(pa.ListArray.from_arrays(pa.array(offsets[level], pa.int32()), struct))
            yield pa.RecordBatch.from_arrays(out, names=["record_id", *LEVELS])

    rows = df.where(F.col(cell).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("record_id"), F.col(cell).alias("_cell"))
    tables = rows.mapInArrow(run, "record_id bigint, " + ", ".join(f"{x} {_struct(x, typed)}" for x in LEVELS))
    return tables.select(F.lit(kind).alias("record_kind"), "record_id", *LEVELS)


def supertype_keys(nested: DataFrame) -> DataFrame:
    """The supertype table: the distinct common keys of all four subtype tables."""
    keys = [F.transform(F.col(level), lambda x: F.struct(*[x[p].alias(p) for p in POSITIONS])) for level in LEVELS]
    return nested.select("record_kind", "record_id", F.explode(F.concat(*keys)).alias("_k")).select("record_kind", "record_id", *[F.col(f"_k.{p}").alias(p) for p in POSITIONS]).distinct()


def subtype_table(nested: DataFrame, level: str, variant: str | None = None) -> DataFrame:
    """The typed table of one level, or of one of its variants, with key and parent link."""
    rows = nested.select("record_kind", "record_id", F.explode(level).alias("_o"))
    if variant is not None:
        rows = rows.where(F.col("_o.variant") == variant)
    typed = [F.col("_o")[c].try_cast(t).alias(c) if t != "string" else F.col("_o")[c].alias(c) for c, (_, t) in SUBTYPES[level].items()]
    depth = LEVELS.index(level)
    parent = F.struct(*[(F.lit(0) if i >= depth else F.col("_o")[p]).alias(p) for i, p in enumerate(POSITIONS)]) if depth else F.lit(None).cast("struct<" + ",".join(f"{p}:int" for p in POSITIONS) + ">")
    return rows.select("record_kind", "record_id", *[F.col("_o")[p].alias(p) for p in POSITIONS], parent.alias("parent"), F.col("_o.variant").alias("variant"), *typed)


def variant_counts(nested: DataFrame) -> DataFrame:
    """Number of objects of each variant, by subtype table."""
    shapes = [F.transform(F.col(level), lambda x, level=level: F.struct(F.lit(level).alias("level"), x["variant"].alias("variant"))) for level in LEVELS]
    rows = nested.select("record_kind", F.explode(F.concat(*shapes)).alias("_v"))
    return rows.groupBy("record_kind", F.col("_v.level").alias("level"), F.col("_v.variant").alias("variant")).agg(F.count(F.lit(1)).alias("objects"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
