"""Exact JSON text: parsing, canonical form, value kinds; plain functions and Arrow functions.

JSON numbers here are Python's (1 is not 1.0, integers have any size, NaN is accepted), which
no SQL type can hold, so values travel as canonical text with a kind letter beside it.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType

#: Kind letters by type, which for parsed JSON is one of these exactly.
KINDS = {str: "s", bool: "b", int: "i", float: "f", type(None): "n", dict: "o", list: "a"}


def canonical(value: object) -> str:
    """Keys sorted by code point, no spaces, characters kept."""
    if type(value) is str:
        return quoted(value)
    return _CANONICAL(value)


def minified(value: object) -> str:
    """No spaces; members in the order of the document."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def pretty(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode  # made once, not for each value
#: Opening brackets of a text that is surely not too deep.
SHALLOW = 400

#: A string as JSON, characters kept.
quoted = json.encoder.encode_basestring


def kind(value: object) -> str:
    return KINDS[type(value)]


def parse(text: str | None) -> tuple[object, str | None]:
    """(value, None), or (None, reason) for a text that is no document."""
    if text is None:
        return None, "missing"
    try:
        value = json.loads(text)
        if "\\u" in text or text.count("{") + text.count("[") > SHALLOW:  # else there is nothing that could not be written again
            canonical(value).encode()
        else:
            text.encode()
    except UnicodeEncodeError:
        return None, "lone_surrogate"
    except RecursionError:
        return None, "too_deep"
    except ValueError as e:
        return None, f"malformed: {e}"[:200]
    return (None, "top_level_string") if isinstance(value, str) else (value, None)


class _Stream:
    """JSON values one after the other from a file of any length; what is behind is forgotten."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.decode = file, size, codecs.getincrementaldecoder("utf-8")().decode
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> None:
        raw = self.file.read(max(self.size, len(self.text) - self.at))  # twice as much each time: a long value is tried few times
        self.ended = not raw
        self.text, self.at = self.text[self.at :] + self.decode(raw, self.ended), 0

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def expect(self, marks: str) -> str:
        mark = self.peek()
        if not mark or mark not in marks:
            raise ValueError(f"expected one of {marks}, found {mark!r}")
        self.at += 1
        return mark

    def value(self) -> object:
        self.peek()
        while True:
            try:
                value, end = _DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    self.at = end
                    return value
            except ValueError:
                if self.ended:
                    raise
            self.more()


_SPACE, _DECODER = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()


def members(file: BinaryIO, lists: frozenset[str], size: int = 1 << 20) -> Iterator[tuple[str, int | None, object]]:
    """(name, None, value) of each member of the one object in a file; of lists named in ``lists``, (name, i, value) of each element."""
    stream = _Stream(file, size)
    stream.expect("{")
    mark = stream.expect("}") if stream.peek() == "}" else ","
    while mark == ",":
        name = stream.value()
        stream.expect(":")
        if name in lists and stream.peek() == "[":
            stream.expect("[")
            inner, i = stream.expect("]") if stream.peek() == "]" else ",", 0
            while inner == ",":
                yield name, i, stream.value()
                inner, i = stream.expect(",]"), i + 1
        else:
            yield name, None, stream.value()
        mark = stream.expect(",}")
    if stream.peek():
        raise ValueError("more than one value")


def _mapped(texts: pa.Array, f, kind_: pa.DataType) -> pa.Array:
    out = []
    for x in texts.to_pylist():
        value, reason = parse(x)
        out.append(None if reason else f(value))
    return pa.array(out, kind_)


@arrow_udf(StringType())
def prov_canonical(texts: pa.Array) -> pa.Array:
    """Canonical text of a document; null where it is none."""
    return _mapped(texts, canonical, pa.string())


@arrow_udf(LongType())
def prov_minified_len(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a document without white space; null where it is none."""
    return _mapped(texts, lambda v: len(minified(v).encode()), pa.int64())
