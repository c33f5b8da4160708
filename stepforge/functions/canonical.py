"""Canonical JSON, leaf paths and commitments: byte-exact text work that built-in functions can't express.

Canonical text has no white space; object keys come as array indices by number, then the rest by UTF-16 code unit;
numbers are the shortest text of the binary64 value; lone surrogates stay escapes. Payloads stay JSON text in Spark,
where a decoded lone surrogate couldn't be stored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
UNSAFE = re.compile('["\\\\\x00-\x1f\ud800-\udfff]')
INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
FIELDS = {"input": "input", "output": "output", "dataPayload": "data_payload"}


def number_text(x: float) -> str:
    """The shortest decimal text of a binary64, laid out as ECMAScript does; null where it isn't finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    if x.is_integer() and abs(x) < 1 << 53:
        return str(int(x))
    sign, parts, power = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, parts))
    point = len(digits) + power
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        out = f"{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + out if sign else out


def string_text(x: str) -> str:
    return '"' + UNSAFE.sub(lambda m: ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", x) + '"'


def key_order(key: str) -> tuple:
    if INDEX.fullmatch(key) and int(key) < 2**32 - 1:
        return 0, int(key), b""
    return 1, 0, key.encode("utf-16-be", "surrogatepass")


def canonical_text(value: object) -> str:
    """The canonical text of a parsed value; it goes down by a stack of its own, so that depth has no limit here."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, Raw):
            out.append(x)
        elif x is None or isinstance(x, bool):
            out.append({None: "null", True: "true", False: "false"}[x])
        elif isinstance(x, str):
            out.append(string_text(x))
        elif isinstance(x, (int, float)):
            out.append(number_text(as_double(x)))
        elif isinstance(x, dict):
            parts: list = [Raw("{")]
            for i, k in enumerate(sorted(x, key=key_order)):
                parts += [Raw(("," if i else "") + string_text(k) + ":"), x[k]]
            todo += reversed([*parts, Raw("}")])
        else:
            parts = [Raw("[")]
            for i, item in enumerate(x):
                parts += [Raw(","), item] if i else [item]
            todo += reversed([*parts, Raw("]")])
    return "".join(out)


class Raw(str):
    """Text that is output already."""


def as_double(x: int | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def refuse(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def parsed(text: str) -> object:
    """A value from JSON text; of repeated keys the last counts. NaN and Infinity are errors, as any bad text is."""
    return json.loads(text, parse_constant=refuse, parse_int=lambda s: as_double(int(s)) if len(s) < 400 else float(s))


def canonicalize(text: str | None) -> str | None:
    """Canonical text of JSON text; None for absent, unreadable or too deeply nested text (about ten thousand levels)."""
    if text is None:
        return None
    return REMEMBERED[text] if len(text) <= SHORT else any_canonical(text)


def any_canonical(text: str) -> str | None:
    try:
        return canonical_text(parsed(text))
    except (ValueError, RecursionError):
        return None


#: Characters of a text whose canonical one is remembered: the payloads of a table's steps share many, and one step's input is asked for twice.
SHORT = 200


class Remembered(dict):
    """Texts with their canonical ones, some thousand at a time; what is sent to an executor goes without them."""

    def __reduce__(self):
        return Remembered, ()

    def __missing__(self, text: str) -> str | None:
        if len(self) >= 1 << 14:
            self.clear()
        self[text] = out = any_canonical(text)
        return out


REMEMBERED = Remembered()


@F.pandas_udf(T.StringType())
def canonical_batch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in texts:
        yield x.map(canonicalize, na_action="ignore")


def canonical(text: Column) -> Column:
    """canonicalize() of a column. Plain strings, null, booleans and short whole numbers are their own canonical text."""
    simple = r'\A(?:null|true|false|0|-?[1-9][0-9]{0,14}|"[\x20\x21\x23-\x5b\x5d-\x7e]*")\z'
    return F.when(text.rlike(simple), text).otherwise(canonical_batch(F.when(~text.rlike(simple), text)))


#: What a text that stands in quotes as it is doesn't hold, and printable ASCII that does.
ESCAPED, SAFE = r'["\\\x00-\x1f]', r'\A[\x20\x21\x23-\x5b\x5d-\x7e]*\z'


def plain_string(x: Column) -> Column:
    """string_text() of a column by built-in functions; null where a character needs an escape."""
    return F.when(~x.rlike(ESCAPED), F.concat(F.lit('"'), x, F.lit('"')))


def plain_number(x: Column) -> Column:
    """number_text() of doubles by built-in functions: whole numbers, and those that six places give exactly; null for others.

    Decimals of up to 15 digits are different doubles, so that one which reads as the same double is the shortest text.
    """
    short = x.try_cast("decimal(15,6)")
    whole = (x == F.floor(x)) & (F.abs(x) < 2**53)
    return F.when(whole, F.when(whole, x).cast("long").cast("string")).when(short.cast("double") == x, F.regexp_replace(short.cast("string"), "0+$", ""))


def plain_json(text: Column) -> Column:
    """canonicalize() of a column by built-in functions: plain scalars and flat objects of short whole numbers and strings without escapes; null for others.

    A variant holds its members in the canonical order but for keys that are array indices, and its only closing brace ends the text.
    """
    simple = r'\A(?:null|true|false|0|-?[1-9][0-9]{0,14}|"[\x20\x21\x23-\x5b\x5d-\x7e]*")\z'
    flat = text.rlike(r"\A\{[^{}\[\]\\\x00-\x1f]*\}\z") & ~text.rlike(r'[0-9][.eE]|[0-9]{16}|-0|NaN|Infinity|"[0-9]+" *:')
    return F.when(text.rlike(simple), text).when(flat, F.to_json(F.try_parse_json(F.when(flat, text))))


# ---- leaves and paths -------------------------------------------------------------------------------------------


def escaped(key: str) -> str:
    return re.sub(r"([\\.\[])", r"\\\1", key)


def leaves(value: object, base: str = "", version: int = 2) -> Iterator[tuple[str, object]]:
    """(path, leaf) in document order; empty containers are leaves. Version 2 escapes `\\`, `.` and `[` in keys."""
    todo: list[tuple[str, object]] = [(base, value)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, list) and x:
            todo += [(f"{path}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
        elif isinstance(x, dict) and x:
            keys = sorted(x, key=lambda k: (0, int(k)) if INDEX.fullmatch(k) and int(k) < 2**32 - 1 else (1, 0))
            todo += [((f"{path}." if path else "") + (escaped(k) if version == 2 else k), x[k]) for k in reversed(keys)]
        else:
            yield path, x


TOKEN = re.compile(r"\\(?P<quoted>.)|(?P<dot>\.)|\[(?P<digits>\d+)\]|(?P<plain>.)", re.S)
PART = re.compile(r"([^\[\]]*)((?:\[\d+\])*)", re.S)


def tokens(path: str, version: int = 2) -> list[str]:
    """The keys and indices of a path. Version 1 can't tell a dot in a key from one between keys."""
    out: list[str] = []
    if version == 1:
        for part in path.split("."):
            m = PART.fullmatch(part)
            out += [*([m[1]] if m[1] else []), *re.findall(r"\d+", m[2])] if m else [part]
        return out
    held: list[str] | None = []
    for m in TOKEN.finditer(path):
        if m["digits"] is not None:
            out += [*(["".join(held)] if held is not None else []), m["digits"]]
            held = None
        elif m["dot"]:
            if held is not None:
                out.append("".join(held))
            held = []
        else:
            held = [*(held or []), m["quoted"] or m["plain"]]
    return out if held is None else [*out, "".join(held)]


def split_path(path: str, version: int = 2) -> tuple[str, list[str]]:
    """(payload field, tokens within it)"""
    if version == 2:
        first, *rest = tokens(path, 2)
        return first, rest
    field = re.split(r"[.\[]", path, maxsplit=1)[0]
    rest = path[len(field) :].removeprefix(".")
    return field, tokens(rest, 1) if rest else []


ABSENT = object()


def value_at(root: object, path: list[str]) -> object:
    for token in path:
        if isinstance(root, dict):
            root = root.get(token, ABSENT)
        elif isinstance(root, list):
            root = root[int(token)] if INDEX.fullmatch(token) and int(token) < len(root) else ABSENT
        else:
            return ABSENT
    return root


def replaced(root: object, path: list[str], value: object) -> object:
    """root with a value put at a path whose containers exist; root itself otherwise."""
    if not path:
        return value
    holder = value_at(root, path[:-1])
    if isinstance(holder, dict):
        holder[path[-1]] = value
    elif isinstance(holder, list) and INDEX.fullmatch(path[-1]) and int(path[-1]) < len(holder):
        holder[int(path[-1])] = value
    return root


def commitment(salt: str, canonical_leaf: str) -> str:
    return hashlib.sha256((salt + canonical_leaf).encode("utf-8", "surrogatepass")).hexdigest()


LEAVES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "legacy_path", "value")]))


def leaf_list(text: str, field: str) -> list[dict] | None:
    """The leaves of a payload's JSON text; None if it can't be read."""
    try:
        value = parsed(text)
    except (ValueError, RecursionError):
        return None
    return [{"path": p, "legacy_path": q, "value": canonical_text(x)} for (p, x), (q, _) in zip(leaves(value, field, 2), leaves(value, field, 1), strict=True)]


def leaves_udf(field: str, version: int = 2):
    """A column function: JSON text to its leaves, as (path under version 2, path under version 1, canonical value)."""

    @F.pandas_udf(LEAVES)
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda x: leaf_list(x, field), na_action="ignore")

    return walk


def all_leaves(payloads: dict[str, str]) -> Column:
    """The leaves of several payloads (column: field) in a row; one function for all, since each takes a Python process a task. Unreadable ones have none."""

    @F.pandas_udf(LEAVES)
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            rows = zip(*[x[c] for c in payloads], strict=True)
            yield pd.Series([[leaf for field, text in zip(payloads.values(), row, strict=True) if isinstance(text, str) for leaf in leaf_list(text, field) or ()] for row in rows], dtype=object)

    return walk(F.struct(*payloads))
