"""Image sizes from file headers, by reads of a few bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable

#: Bytes of the first read; enough for all formats but JPEG files with large blocks before the frame.
FIRST = 64


def size_of(read_at: Callable[[int, int], bytes], length: int) -> tuple[tuple[int, int] | None, int]:
    """Width and height as the header of a PNG, BMP, GIF or JPEG file has them, or None, and the bytes read. read_at takes number and place."""
    head = read_at(min(FIRST, length), 0)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24]), len(head)
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return (w, abs(h)), len(head)
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10]), len(head)
    if head[:2] != b"\xff\xd8":
        return None, len(head)
    at, read = 2, len(head)
    while at + 9 <= length:
        if at + 9 <= len(head):
            block = head[at : at + 9]
        else:
            block = read_at(9, at)
            read += len(block)
        if len(block) < 9 or block[0] != 0xFF:
            return None, read
        kind = block[1]
        if kind == 0xFF:  # a filling byte before the marker
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD9:  # a marker without a block
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame: its size is in it
            h, w = struct.unpack(">HH", block[5:9])
            return (w, h), read
        else:
            at += 2 + struct.unpack(">H", block[2:4])[0]
    return None, read
