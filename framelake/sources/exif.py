"""The camera's serial number out of a JPEG's EXIF block."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BodySerialNumber, and the pointer from the first directory to the EXIF one.
SERIAL, EXIF_POINTER = 0xA431, 0x8769
_ASCII, _BYTE, _UNDEFINED = 2, 1, 7


def serial_bytes(jpeg: bytes | None) -> bytes | None:
    """The value of the serial number's tag, the EXIF directory's before that of any other; None without one. Broken files
    give None."""
    if not jpeg or jpeg[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
            return _from_tiff(jpeg[at + 10 : at + 2 + size])
        at += 2 + size
    return None


def _from_tiff(t: bytes) -> bytes | None:
    if t[:2] not in (b"II", b"MM"):
        return None
    e = "<" if t[:2] == b"II" else ">"
    found: dict[int, bytes] = {}
    todo, seen = [(struct.unpack_from(e + "I", t, 4)[0], 1)], set()
    while todo:
        at, rank = todo.pop(0)
        if at in seen or at + 2 > len(t) or not at:
            continue
        seen.add(at)
        n = struct.unpack_from(e + "H", t, at)[0]
        for k in range(n):
            p = at + 2 + 12 * k
            if p + 12 > len(t):
                break
            tag, kind, count = struct.unpack_from(e + "HHI", t, p)
            if tag == EXIF_POINTER:
                todo.append((struct.unpack_from(e + "I", t, p + 8)[0], 0))
            elif tag == SERIAL and kind in (_ASCII, _BYTE, _UNDEFINED):
                start = p + 8 if count <= 4 else struct.unpack_from(e + "I", t, p + 8)[0]
                value = t[start : start + count]
                found.setdefault(rank, (value.split(b"\0")[0] if kind == _ASCII else value).replace(b"\0", b""))
        after = at + 2 + 12 * n
        if after + 4 <= len(t):
            todo.append((struct.unpack_from(e + "I", t, after)[0], 1))
    return found[min(found)] if found else None


def serial(jpeg: Column) -> Column:
    @F.pandas_udf("string")
    def read(s):
        return s.map(lambda b: (lambda v: v.decode("utf-8", "replace") if v is not None else None)(serial_bytes(b)))

    return read(jpeg)
