"""ABI values of arrays and tuples, for which no column expression can be fixed in advance; plain values stay in the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_WORD = 32


def is_nested(kind: str) -> bool:
    return "[" in kind or "(" in kind


def parts(kind: str) -> list[str]:
    """Component types of a tuple type."""
    out, depth, now = [], 0, ""
    for c in kind[1:-1]:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def _element(kind: str) -> tuple[str, int | None] | None:
    """Element type and length (None where it varies) of an array type."""
    m = re.fullmatch(r"(.+)\[(\d*)\]", kind)
    return (m[1], int(m[2]) if m[2] else None) if m else None


def _dynamic(kind: str) -> bool:
    if array := _element(kind):
        return array[1] is None or _dynamic(array[0])
    return any(map(_dynamic, parts(kind))) if kind.startswith("(") else kind in ("string", "bytes")


def _size(kind: str) -> int:
    """Bytes in the head."""
    if _dynamic(kind):
        return _WORD
    if array := _element(kind):
        return array[1] * _size(array[0])
    return sum(map(_size, parts(kind))) if kind.startswith("(") else _WORD


def _number(data: bytes, at: int) -> int:
    if at < 0 or at + _WORD > len(data):
        raise ValueError("beyond the end")
    return int.from_bytes(data[at : at + _WORD], "big")


def _row(kinds: list[str], data: bytes, base: int) -> list:
    out, at = [], base
    for kind in kinds:
        out.append(_value(kind, data, base + _number(data, at) if _dynamic(kind) else at))
        at += _size(kind)
    return out


def _value(kind: str, data: bytes, at: int):
    if array := _element(kind):
        of, n = array
        if n is None:
            n, at = _number(data, at), at + _WORD
        if n > len(data) or n * _size(of) > len(data) - at:
            raise ValueError("beyond the end")
        return _row([of] * n, data, at)
    if kind.startswith("("):
        return _row(parts(kind), data, at)
    n = _number(data, at)
    if kind in ("string", "bytes"):
        if n > len(data):
            raise ValueError("beyond the end")
        padded = data[at + _WORD : at + _WORD + -(-n // _WORD) * _WORD]
        raw = padded[:n]
        if len(padded) < -(-n // _WORD) * _WORD or any(padded[n:]):
            raise ValueError("beyond the end, or padded with other bytes than zeros")
        return raw.decode() if kind == "string" else "0x" + raw.hex()
    if kind == "address":
        if n >> 160:
            raise ValueError("not an address")
        return f"0x{n:040x}"
    if kind == "bool":
        return {0: False, 1: True}[n]
    if m := re.fullmatch(r"(u?)int(\d*)", kind):
        bits = int(m[2] or 256)
        value = n if m[1] or n < 1 << 255 else n - (1 << 256)
        if not (0 <= value < 1 << bits if m[1] else -(1 << bits - 1) <= value < 1 << bits - 1):
            raise ValueError("out of range")
        return value
    if m := re.fullmatch(r"bytes(\d+)", kind):
        if any(data[at + int(m[1]) : at + _WORD]):
            raise ValueError("padded with other bytes than zeros")
        return "0x" + data[at : at + int(m[1])].hex()
    raise ValueError(kind)


def _text(kind: str, value) -> str:
    if is_nested(kind):
        return json.dumps(value, separators=(",", ":"))
    return str(value).lower() if kind == "bool" else str(value)


def values(kinds: list[str], body: str) -> list[str] | None:
    """Values of ABI data as text, nested ones as JSON; None where the data doesn't fit the types."""
    try:
        return [_text(k, v) for k, v in zip(kinds, _row(kinds, bytes.fromhex(body), 0), strict=True)]
    except (ValueError, KeyError, RecursionError):
        return None


@F.pandas_udf(ArrayType(StringType()))
def nested_values(kinds: pd.Series, body: pd.Series) -> pd.Series:
    """``values`` of each row; null where the body is null, which is how rows without nested types are passed over."""
    return pd.Series([None if b is None else values(list(k), b) for k, b in zip(kinds, body, strict=True)])
