"""Strict JSON (RFC 8259) and fenced blocks, for use inside Arrow functions."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

BAD = object()
# Fixed value: how a fenced block opens.
_OPEN = re.compile(r"```(?:json)?[ \t]*\r?\n", re.IGNORECASE)
#: integers of more digits are kept as decimals: the interpreter refuses to read them as int
_INT_DIGITS = 4_000
_LONE = re.compile("[\ud800-\udfff]")
_PART = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?[0-9][0-9.eE+\-]*|true|false|null)|(\Z))', re.DOTALL)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _integer(digits: str) -> int | Decimal:
    return int(digits) if len(digits) <= _INT_DIGITS else Decimal(digits)


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer)


def _stacked(text: str) -> Any:
    """The value of a text nested deeper than the recursive decoder goes: containers on a stack, scalars by the
    decoder."""
    stack: list[Any] = []
    keys: list[str | None] = []
    at, want, done = 0, "value", None
    while True:
        m = _PART.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at = m.end()
        mark, string, scalar, end = m.groups()
        if end is not None:
            if want != "end":
                raise ValueError("JSON ends early")
            return done
        if mark in ("[", "{"):
            if want not in ("value", "value or ]"):
                raise ValueError("a container is out of place")
            stack.append([] if mark == "[" else {})
            keys.append(None)
            want = "value or ]" if mark == "[" else "key or }"
            continue
        if mark in ("]", "}"):
            kind = list if mark == "]" else dict
            if not stack or type(stack[-1]) is not kind or want not in ("comma", "value or ]" if mark == "]" else "key or }"):
                raise ValueError("a bracket is out of place")
            value = stack.pop()
            keys.pop()
        elif mark == ",":
            if want != "comma":
                raise ValueError("a comma is out of place")
            want = "value" if type(stack[-1]) is list else "key"
            continue
        elif mark == ":":
            if want != "colon":
                raise ValueError("a colon is out of place")
            want = "value"
            continue
        elif string is not None and want in ("key", "key or }"):
            keys[-1] = _DECODER.decode(string)
            want = "colon"
            continue
        elif want in ("value", "value or ]"):
            value = _DECODER.decode(string if string is not None else scalar)
        else:
            raise ValueError("a value is out of place")
        if not stack:
            done, want = value, "end"
        else:
            if type(stack[-1]) is list:
                stack[-1].append(value)
            else:
                stack[-1][keys[-1]] = value
            want = "comma"


def loads(text: Any) -> Any:
    """The value of a strict JSON text of any depth, or BAD; blanks of JSON around it do not matter."""
    if not isinstance(text, str):
        return BAD
    try:
        return _DECODER.decode(text)
    except ValueError:
        return BAD
    except RecursionError:
        try:
            return _stacked(text)
        except ValueError:
            return BAD


def clean(text: str) -> str:
    """text with halves of characters, for which an escape may stand and which no column can hold, replaced."""
    return _LONE.sub("\ufffd", text) if _LONE.search(text) else text


def fenced_blocks(text: str) -> list[str]:
    """Contents of fenced blocks in order: three backquotes, optionally json, a line end, up to the next backquotes."""
    out, at = [], 0
    while m := _OPEN.search(text, at):
        end = text.find("```", m.end())
        if end < 0:
            break
        out.append(text[m.end() : end])
        at = end + 3
    return out


def is_object_array(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, dict) for x in value)


def gold_array(text: Any) -> list | None:
    """The last fenced block that is a JSON array of objects only, or None."""
    if not isinstance(text, str) or "```" not in text:
        return None
    for block in reversed(fenced_blocks(text)):
        if "[" in block and is_object_array(value := loads(block)):
            return value
    return None
