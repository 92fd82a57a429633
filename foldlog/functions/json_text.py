"""JSON text of any nesting: canonical form, volatile values, unsafe keys. Arrow batches, one small walk a value."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlog.functions.hashing import FNV_OFFSET, FNV_PRIME, MASK, VOLATILE, fnv1a

# Limits and placeholders that results depend on, and keys that must not stand in an artifact.
DEEPEST, LONGEST = 8, 1024
NOT_FINITE = {"nan": "[NON_FINITE_NUMBER_NAN]", "inf": "[NON_FINITE_NUMBER_INFINITY]", "-inf": "[NON_FINITE_NUMBER_NEGATIVE_INFINITY]"}
TOO_DEEP = "[MAX_DEPTH_EXCEEDED]"
LONG = "[TRUNCATED_STRING_HASH_{}_LENGTH_{}]"
UNSAFE = ["rawFileContents", "fileData", "rawPayload", "compactPayload"]
UNSAFE_INSIDE = ["content", "body"]
CONTAINERS = ["metadata", "compactPayload", "replaySnapshots", "compressionSignalMappings"]
#: A mark, a text or a word of JSON behind white space; what stands behind a key.
PIECE = re.compile(r'[ \t\n\r]*([{}\[\],]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)[ \t\n\r]*', re.S)
COLON = re.compile(r"[ \t\n\r]*:")


def short_hash(text: str) -> str:
    """FNV-1a of the UTF-16 code units, eight hexadecimal digits."""
    h, units = FNV_OFFSET, text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = ((h ^ (units[k] | units[k + 1] << 8)) * FNV_PRIME) & MASK
    return f"{h:08x}"


def scalar(value: object, digits: int | None, bounded: bool) -> str:
    """Numbers rounded to `digits` (half to even), what is not finite named, long texts replaced by their hash and length."""
    if isinstance(value, float):
        if not math.isfinite(value):
            value = NOT_FINITE[str(value)]
        elif digits is not None:
            value = round(value, digits)
        elif value.is_integer() and abs(value) < 1e21:
            value = int(value)
    if isinstance(value, str) and bounded and (n := len(value.encode("utf-16-le", "surrogatepass")) // 2) > LONGEST:
        value = LONG.format(short_hash(value), n)
    return json.dumps(value, ensure_ascii=False)


def written(value: object, volatile: bool, digits: int | None, bounded: bool) -> str:
    """Canonical text of a value. The walk keeps its own stack, so it goes to any depth; a depth below 0 marks text that is ready."""
    out, todo = [], [(value, 0)]
    while todo:
        x, depth = todo.pop()
        if depth < 0:
            out.append(x)
        elif bounded and depth > DEEPEST:
            out.append(json.dumps(TOO_DEEP))
        elif isinstance(x, dict):
            todo.append(("}", -1))
            first = min(x, default=None)
            for k in sorted(x, reverse=True):
                todo.append((VOLATILE[k] if volatile and k in VOLATILE else x[k], depth + 1))
                todo.append((("," if k != first else "") + json.dumps(k, ensure_ascii=False) + ":", -1))
            todo.append(("{", -1))
        elif isinstance(x, list):
            todo.append(("]", -1))
            for i in range(len(x) - 1, -1, -1):
                todo.append((x[i], depth + 1))
                if i:
                    todo.append((",", -1))
            todo.append(("[", -1))
        else:
            out.append(scalar(x, digits, bounded))
    return "".join(out)


def unsafe_path(value: object) -> str | None:
    """The first path to a key that must not be there; contents and bodies only within payload containers. Any depth."""
    todo = [(value, "", None)]
    while todo:
        x, path, key = todo.pop()
        if key is not None and (key in UNSAFE or (key in UNSAFE_INSIDE and any(c in path for c in CONTAINERS))):
            return path
        if isinstance(x, dict):
            todo.extend((v, f"{path}.{k}" if path else k, k) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            todo.extend((x[i], f"{path}[{i}]", None) for i in range(len(x) - 1, -1, -1))
    return None


def read(text: str) -> object:
    """The value of a JSON text; texts nested too deeply for the library are read with a stack. ValueError for what is no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack, keys, at = [root], [None], 0
    expect = "value"  # value, first (a value or the end of a list), key, name (a key or the end of a map), next
    while at < len(text):
        m = PIECE.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at, piece = m.end(), m[1]
        top = stack[-1]
        if piece in ("}", "]"):
            if len(stack) == 1 or isinstance(top, dict) != (piece == "}") or expect not in ("next", "first", "name"):
                raise ValueError("no JSON")
            stack.pop(), keys.pop()
            expect = "next"
        elif piece == ",":
            if expect != "next" or len(stack) == 1:
                raise ValueError("no JSON")
            expect = "key" if isinstance(top, dict) else "value"
        elif expect in ("key", "name"):
            if not piece.endswith('"') or (colon := COLON.match(text, at)) is None:
                raise ValueError("no JSON")
            keys[-1], at, expect = json.loads(piece), colon.end(), "value"
        elif expect in ("value", "first"):
            value = {} if piece == "{" else [] if piece == "[" else json.loads(piece)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            expect = "next"
            if piece in "{[":
                stack.append(value)
                keys.append(None)
                expect = "name" if piece == "{" else "first"
        else:
            raise ValueError("no JSON")
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("no JSON")
    return root[0]


PLAIN = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def plain(text: str, bounded: bool) -> bool:
    """Whether a text nests too little, and its strings are too short, for any limit to matter.

    A character is two code units at most, one in ASCII, and an escape is longer than what it stands for. Without a backslash a
    string is what stands between two quotes.
    """
    short = LONGEST if text.isascii() else LONGEST // 2
    return text.count("{") + text.count("[") <= DEEPEST and (not bounded or len(text) <= short or ("\\" not in text and max(map(len, text.split('"'))) <= short))


def canonical_text(volatile: bool, digits: int | None, bounded: bool) -> Callable[[str], str]:
    """Canonical form of JSON texts. Most are plain() and are read and written by the library alone, which gives written()'s text; ValueError for what is no JSON."""

    def number(x: str) -> object:
        value = float(x)
        return value if digits is None and math.isfinite(value) and not value.is_integer() else json.loads(scalar(value, digits, bounded))

    def steady(x: dict) -> dict:
        for k in VOLATILE.keys() & x.keys():
            x[k] = VOLATILE[k]
        return x

    decode = json.JSONDecoder(object_hook=steady if volatile else None, parse_float=number, parse_constant=number).decode
    return lambda text: PLAIN(decode(text)) if plain(text, bounded) else written(read(text), volatile, digits, bounded)


def _by_value(text: Column, f: Callable[[object], str | None]) -> Column:
    return _by_text(text, lambda: lambda x: f(read(x)))


def _by_text(text: Column, make: Callable[[], Callable[[str], str | None]]) -> Column:
    """make: makes the function of a text, in the worker."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else f(x)
            except ValueError:
                return None

        f = make()
        for b in batches:
            yield pd.Series([one(x) for x in b], dtype=object)

    return apply(text)


def canonical_json(text: Column, volatile: bool = False, digits: int | None = None) -> Column:
    """JSON text with sorted keys and no blanks; with `volatile` values that change from run to run are replaced.

    Null for null and for what is no JSON. NaN and infinities have names. With `digits` numbers are rounded and
    everything stays; else what is deeper than DEEPEST and texts longer than LONGEST are replaced by marks. Texts of any depth are read.
    """
    return _by_text(text, lambda: canonical_text(volatile, digits, digits is None))


def stable_hash(canonical: Column) -> Column:
    """`fnv1a:` and the hash of a canonical text."""
    return F.concat(F.lit("fnv1a:"), fnv1a(canonical))


def first_unsafe_path(text: Column) -> Column:
    """Where a key stands that would bring raw contents into an artifact; null where none does."""
    return _by_value(text, unsafe_path)


def string_array(text: Column, key: str) -> Column:
    """The array under a top-level key if all its entries are strings, else an empty one."""
    found = F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>")
    raw = F.try_parse_json(F.get_json_object(text, f"$.{key}"))
    strings = F.schema_of_variant(raw) == "ARRAY<STRING>"
    return F.when(F.coalesce(strings, F.lit(False)), found).otherwise(F.array().cast("array<string>"))
