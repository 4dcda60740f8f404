"""What a JSON answer, whole or cut off anywhere, says about its data.

A push-down automaton reads tokens once, left to right, with a frame per open container.  Where the
text ends, frames close from the inside out: what was not complete does not count, except that an
envelope of data counts with its complete elements, and that a failure member that was cut makes the
sample unreadable, since it could have said anything.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.access import DESCRIPTION, ENVELOPE, FAILURE
from lodestack.scratch import ship

#: Members whose text is searched for access wordings. Fixed values.
SPOKEN = ("error", "errors", "message", "detail", "status")
#: Open containers, at most, in a sample that was cut. A fixed value.
DEPTH = 64
KIND = "readable boolean, failed boolean, bare boolean, data boolean, said string"
UNREADABLE = (False, False, False, False, None)

GAP = re.compile(r"[ \t\r\n]*")
CHARS = r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*'
TOKEN = re.compile(rf'(?P<mark>[\[\]{{}},:])|(?P<string>"{CHARS}")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<name>true|false|null)')
#: What the cut may leave of a token: a string, a number that may go on, a name.
CUT_STRING = re.compile(rf'"{CHARS}(?:\\(?:u[0-9a-fA-F]{{0,3}})?)?\Z')
CUT_OTHER = re.compile(r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?|-|tr?u?|fa?l?s?|nu?l?)\Z")


class Frame:
    """An open container: members with (kind, filled, text), or the number of elements; what comes next."""

    __slots__ = ("members", "count", "key", "next", "start")

    def __init__(self, is_object: bool, start: int):
        self.members = {} if is_object else None
        self.count, self.key, self.next, self.start = 0, None, "first", start

    def filled(self) -> bool:
        return bool(self.members) if self.members is not None else self.count > 0

    def add(self, value: tuple) -> None:
        if self.members is None:
            self.count += 1
        else:
            self.members[self.key] = value
        self.key, self.next = None, "comma"

    def cut(self, value: tuple | None) -> bool:
        """Close at the end of the text, with ``value`` unfinished inside; False if that leaves no evidence."""
        if self.members is None or self.next not in ("colon", "value"):
            return True
        if self.key in FAILURE:
            return False
        if self.key in ENVELOPE:
            self.members[self.key] = value or ("name", False, "null")
        elif self.next == "value":
            self.members.pop(self.key, None)
        return True


def scan(text: str, truncated: bool) -> tuple | Frame | None:
    """The outermost value: a frame, a scalar (kind, filled, text), or None if the text is not JSON (as far as it goes)."""
    frames: list[Frame] = []
    outer: tuple | Frame | None = None
    at, end = GAP.match(text, 1 if text.startswith("﻿") else 0).end(), len(text)
    while at < end:
        if outer is not None:
            return None  # something follows the value
        frame = frames[-1] if frames else None
        expects = frame.next if frame else "value"
        is_key = frame is not None and frame.members is not None and expects in ("first", "key")
        if truncated and (CUT_OTHER.match(text, at) if not is_key else False) and expects in ("first", "value"):
            at = end
            break
        m = TOKEN.match(text, at)
        if not m:
            if truncated and text[at] == '"' and (is_key or expects in ("first", "value")) and CUT_STRING.match(text, at):
                at = end
                break
            return None
        kind, token, start = m.lastgroup, m.group(), at
        at = GAP.match(text, m.end()).end()
        if kind == "mark" and token in ",:":
            if frame is None or expects != {",": "comma", ":": "colon"}[token]:
                return None
            frame.next = "value" if token == ":" or frame.members is None else "key"
        elif kind == "mark" and token in "]}":
            if frame is None or (token == "}") != (frame.members is not None) or expects not in ("first", "comma"):
                return None
            frames.pop()
            value = ("object" if token == "}" else "array", frame.filled(), text[frame.start : m.end()])
            if frames:
                frames[-1].add(value)
            else:
                outer = frame
        elif is_key:
            if kind != "string":
                return None
            frame.key, frame.next = json.loads(token), "colon"
        elif expects not in ("first", "value"):
            return None
        elif kind == "mark":
            if truncated and len(frames) > DEPTH:
                return None
            if frame is not None:
                frame.next = "value"
            frames.append(Frame(token == "{", start))
        else:
            filled = {"string": token != '""', "number": kind == "number" and any(c in "123456789" for c in re.split("[eE]", token)[0]), "name": token == "true"}[kind]
            if frames:
                frame.add((kind, filled, token))
            else:
                outer = (kind, filled, token)
    if outer is not None:
        return outer
    if not truncated:
        return None
    value = None
    while frames:
        frame = frames.pop()
        if not frame.cut(value):
            return None
        value = ("object" if frame.members is not None else "array", frame.filled(), "")
        outer = frame
    return outer if outer is not None else ("name", False, "null")


def evidence(text: str | None, truncated: bool | None) -> tuple:
    """(readable, failed, bare, data, said): whether the text is JSON, reports a failure, has only members
    that report, carries data; and its reporting members as text."""
    found = scan(text, bool(truncated)) if text is not None else None
    if found is None:
        return UNREADABLE
    if isinstance(found, tuple):
        return True, False, False, False, None
    if found.members is None:
        return True, False, False, found.count > 0, None
    m = found.members
    kind, _, status = m.get("status", ("", False, ""))
    failed = any(m[k][1] for k in ("error", "errors") if k in m) or m.get("success", ("", False, ""))[2] == "false"
    failed = failed or (kind == "string" and json.loads(status).lower() in ("error", "failed", "failure"))
    said = ", ".join(f'"{k}": {v[2]}' for k, v in m.items() if k in SPOKEN)
    envelope = next((m[k] for k in ENVELOPE if k in m), None)
    data = envelope[0] in ("object", "array") and envelope[1] if envelope else any(k not in FAILURE and k not in DESCRIPTION for k in m)
    return True, failed, set(m) <= set(SPOKEN), data, said


def json_says(body: Column, truncated: Column) -> Column:
    """Struct (readable, failed, bare, data, said) of a body; null bodies are unreadable."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf(KIND)
    def read(bodies: pd.Series, cut: pd.Series) -> pd.DataFrame:
        rows = [evidence(b, c) for b, c in zip(bodies, cut, strict=True)]
        return pd.DataFrame(rows, columns=["readable", "failed", "bare", "data", "said"])

    return read(body, F.coalesce(truncated, F.lit(False)))
