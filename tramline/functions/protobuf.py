"""The wire format of realtime feeds: reading (and, for tests, writing) the fields that transit messages use.

Field numbers are those of the public GTFS Realtime specification. Unknown fields are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

Value = int | bytes


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int, Value]]:
    """(number, wire type, value) of each field, in order; raises ValueError where the bytes are no message."""
    at, end = 0, len(data)
    while at < end:
        try:
            key, at = varint(data, at)
            number, kind = key >> 3, key & 7
            if kind == 0:
                value, at = varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
                value, at = data[at : at + size], at + size
            elif kind == 2:
                size, at = varint(data, at)
                value, at = data[at : at + size], at + size
            else:
                raise ValueError(f"wire type {kind}")
        except IndexError:
            raise ValueError("cut short") from None
        if at > end or not number:
            raise ValueError("cut short")
        yield number, kind, value


def message(data: bytes) -> dict[int, list[Value]]:
    out: dict[int, list[Value]] = {}
    for number, _, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def signed(value: int | None) -> int | None:
    return value if value is None or value < 1 << 63 else value - (1 << 64)


def text(found: dict[int, list[Value]], number: int) -> str | None:
    value = found.get(number)
    return value[-1].decode("utf-8", "replace") if value and isinstance(value[-1], bytes) else None


def number(found: dict[int, list[Value]], key: int) -> int | None:
    value = found.get(key)
    return signed(value[-1]) if value and isinstance(value[-1], int) else None


def real(found: dict[int, list[Value]], key: int) -> float | None:
    value = found.get(key)
    return struct.unpack("<f", value[-1])[0] if value and isinstance(value[-1], bytes) and len(value[-1]) == 4 else None


def inner(found: dict[int, list[Value]], key: int) -> dict[int, list[Value]]:
    value = found.get(key)
    return message(value[-1]) if value and isinstance(value[-1], bytes) else {}


def header_timestamp(data: bytes) -> int | None:
    """The header's time, without looking at the entities; null if there is none or the bytes are no feed. [F8]"""
    try:
        for key, _, value in fields(data):
            if key == 1 and isinstance(value, bytes):
                return number(message(value), 3)
    except ValueError:
        pass
    return None


def packed(*parts: tuple[int, object]) -> bytes:
    """A message of (number, value): whole numbers, floats, texts, bytes (also nested messages); nulls are left out."""

    def whole(value: int) -> bytes:
        value &= (1 << 64) - 1
        out = bytearray()
        while value > 0x7F:
            out.append(value & 0x7F | 0x80)
            value >>= 7
        return bytes([*out, value])

    out = b""
    for key, value in parts:
        if value is None:
            continue
        if isinstance(value, float):
            out += whole(key << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += whole(key << 3) + whole(value)
        else:
            body = value.encode() if isinstance(value, str) else value
            out += whole(key << 3 | 2) + whole(len(body)) + body
    return out
