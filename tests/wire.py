"""The wire formats once more, byte by byte: brute force for the tests."""

from __future__ import annotations

import struct

WRAP = 1 << 64


class Broken(Exception):
    pass


def put(n: int) -> bytes:
    folded = 2 * n if n >= 0 else -2 * n - 1
    out = []
    while True:
        folded, low = divmod(folded, 128)
        if not folded:
            return bytes([*out, low])
        out.append(low + 128)


def take(payload: bytes, at: int) -> tuple[int, int]:
    folded = 0
    for group in range(10):
        if at + group >= len(payload):
            raise Broken("truncated")
        byte = payload[at + group]
        if group == 9 and byte > 1:  # beyond 64 bits
            break
        folded += (byte % 128) * 128**group
        if byte < 128:
            folded %= WRAP
            number = folded // 2 if folded % 2 == 0 else -(folded // 2) - 1
            return number, at + group + 1
    raise Broken("varint_too_long")


def put_list(numbers, blocks=None) -> bytes:
    """``blocks``: sizes of the blocks; a negative size writes the byte size."""
    sizes = blocks if blocks is not None else ([len(numbers)] if numbers else [])
    out, rest = b"", list(numbers)
    for size in sizes:
        items = b"".join(put(n) for n in rest[: abs(size)])
        rest = rest[abs(size) :]
        out += put(size) + (put(len(items)) if size < 0 else b"") + items
    assert not rest
    return out + put(0)


def take_list(payload: bytes) -> list[int]:
    numbers, at = [], 0
    while True:
        count, at = take(payload, at)
        if count == 0:
            return numbers
        if count < 0:
            _, at = take(payload, at)
        for _ in range(abs(count)):
            n, at = take(payload, at)
            numbers.append(n)


def list_or_reason(payload: bytes):
    try:
        return take_list(payload), None
    except Broken as problem:
        return None, str(problem)


def put_message(message_id: int, event_time: float, content: str) -> bytes:
    text = content.encode()
    return put(message_id) + struct.pack("<d", event_time) + put(len(text)) + text


def message_or_reason(payload: bytes):
    try:
        message_id, at = take(payload, 0)
        if at + 8 > len(payload):
            raise Broken("truncated")
        (event_time,) = struct.unpack("<d", payload[at : at + 8])
        length, at = take(payload, at + 8)
        if length < 0:
            raise Broken("negative_length")
        if at + length > len(payload):
            raise Broken("truncated")
        return (message_id, event_time, payload[at : at + length].decode()), None
    except Broken as problem:
        return None, str(problem)
    except UnicodeDecodeError:
        return None, "invalid_utf8"
