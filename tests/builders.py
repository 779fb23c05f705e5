"""Byte builders for test files."""

from __future__ import annotations

import struct

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 11: 4, 12: 8}


def tiff(directories: list[list[tuple]], order: str = "<", tail: bytes = b"") -> bytes:
    """A classic TIFF of chained directories; an entry is (tag, type, count, value), the value an int or bytes."""
    out, at, places = bytearray(8), 8, []
    for entries in directories:
        places.append(at)
        body, extra = b"", b""
        data_at = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            size = SIZES[kind] * count
            if isinstance(value, int):
                field = struct.pack(order + "H", value) + b"\0\0" if kind == 3 else struct.pack(order + "I", value)
            elif size <= 4:
                field = value.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", data_at + len(extra))
                extra += value
            body += struct.pack(order + "HHI", tag, kind, count) + field
        block = struct.pack(order + "H", len(entries)) + body
        out += block + b"\0\0\0\0" + extra
        at = len(out)
    for k, place in enumerate(places):
        n = struct.unpack_from(order + "H", out, place)[0]
        struct.pack_into(order + "I", out, place + 2 + 12 * n, places[k + 1] if k + 1 < len(places) else 0)
    out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, places[0] if places else 0)
    return bytes(out) + tail


def text(tag: int, value: str, kind: int = 2) -> tuple:
    raw = value.encode("latin-1") + b"\0"
    return tag, kind, len(raw), raw


def element(group: int, number: int, vr: str, value: bytes) -> bytes:
    value += (b"\0" if vr in ("UI", "OB") else b" ") * (len(value) % 2)
    head = struct.pack("<HH", group, number) + vr.encode()
    return head + (b"\0\0" + struct.pack("<I", len(value)) if vr in ("SQ", "OB", "UN") else struct.pack("<H", len(value))) + value


def item(content: bytes) -> bytes:
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(content)) + content


def dicom(*elements: bytes) -> bytes:
    meta = element(2, 0x10, "UI", b"1.2.840.10008.1.2.1")
    return b"\0" * 128 + b"DICM" + meta + b"".join(elements)
