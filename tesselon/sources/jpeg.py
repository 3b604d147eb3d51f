"""Baseline JPEG of colour images in numpy: full colour resolution, Huffman codes fitted to the image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Quantisation of brightness and of colour at quality 50, row by row.
BRIGHT = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
COLOUR = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 " + "99 " * 32
#: Brightness and two colour differences of red, green, blue.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

#: Places of a block from the lowest to the highest frequency: along diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
COSINES = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def quantisers(quality: int) -> list[np.ndarray]:
    """Both tables at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t.split(), int) * scale + 50) // 100, 1, 255) for t in (BRIGHT, COLOUR)]


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths up to 16 bits; no code is all ones, as an unused symbol takes that one."""
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
        heap.append((0, -1, (-1,)))  # the unused symbol: it is among the longest
        heapq.heapify(heap)
        depth = dict.fromkeys([*counts, -1], 0)
        k = len(heap)
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                depth[s] += 1
            heapq.heappush(heap, (n + m, k, a + b))
            k += 1
        if max(depth.values()) <= 16:
            return {s: n for s, n in depth.items() if s >= 0}
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as a file holds it."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, value, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        value <<= lengths[s] - last
        code[s], size[s], last = value, lengths[s], lengths[s]
        value += 1
    return code, size, bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)


def _magnitude(x: np.ndarray) -> np.ndarray:
    """Bits that a coefficient's size takes."""
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one component's blocks (in zigzag order): block, order in it, symbol, number of extra bits, extra bits."""
    n = len(blocks)
    dc = np.diff(blocks[:, 0], prepend=0)
    rows = [(np.arange(n), np.zeros(n, int), _magnitude(dc), dc)]
    at, place = np.nonzero(blocks[:, 1:])
    value = blocks[:, 1:][at, place]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    run = place - np.where(first, -1, np.concatenate([[0], place[:-1]]) if len(at) else 0) - 1
    size = _magnitude(value)
    rows.append((at, (place + 1) * 4 + 3, (run % 16) << 4 | size, value))
    for k in range(1, 4):  # sixteen zeros at a time
        long = run >= 16 * k
        rows.append((at[long], (place[long] + 1) * 4 + k - 1, np.full(long.sum(), 0xF0), np.zeros(long.sum(), int)))
    last = np.zeros(n, int)
    np.maximum.at(last, at, place + 1)
    short = np.flatnonzero(last < 63)
    rows.append((short, np.full(len(short), 1000), np.zeros(len(short), int), np.zeros(len(short), int)))
    block, order, symbol, value = (np.concatenate([r[i] for r in rows]) for i in range(4))
    bits = np.where(order == 0, symbol, symbol & 15)
    return block, order, symbol, bits, np.where(value < 0, value + (1 << bits) - 1, value)


def encode(img: np.ndarray, quality: int = 93) -> bytes:
    """A JPEG file of an image (height, width, 3) of bytes in BGR order."""
    h, w = img.shape[:2]
    padded = np.pad(img[..., ::-1], [(0, -h % 8), (0, -w % 8), (0, 0)], mode="edge").astype(float)
    ycc = padded @ TO_YCC.T - [128, 0, 0]
    tables, parts = quantisers(quality), []
    for c in range(3):
        x = ycc[..., c].reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        freq = (COSINES @ x @ COSINES.T).reshape(-1, 64)
        parts.append(_symbols(np.rint(freq / tables[c > 0]).astype(int)[:, ZIGZAG]))
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [_segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].astype(np.uint8))) for k, t in enumerate(tables)]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    found: dict[tuple[int, int], tuple] = {}
    for kind in (0, 1):  # steady parts, others
        for k in (0, 1):
            seen = np.concatenate([p[2][(p[1] == 0) == (kind == 0)] for c, p in enumerate(parts) if (c > 0) == k])
            symbols, n = np.unique(seen, return_counts=True)
            found[kind, k] = codes(code_lengths(dict(zip(symbols.tolist(), n.tolist(), strict=True)) or {0: 1}))
            out.append(_segment(0xC4, bytes([kind << 4 | k]) + found[kind, k][2]))
    out.append(_segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    rows = []
    for c, (block, order, symbol, bits, extra) in enumerate(parts):
        steady = order == 0
        k = int(c > 0)
        code = np.where(steady, found[0, k][0][symbol], found[1, k][0][symbol])
        size = np.where(steady, found[0, k][1][symbol], found[1, k][1][symbol])
        rows.append((block * 3 + c, order, code << bits | extra, size + bits))
    block, order, value, size = (np.concatenate([r[i] for r in rows]) for i in range(4))
    right = np.lexsort((order, block))
    out.append(_packed(value[right], size[right]).replace(b"\xff", b"\xff\0"))
    return b"".join([*out, b"\xff\xd9"])


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Values of so many bits one after another, filled up with ones."""
    ends = np.cumsum(size)
    which = np.repeat(np.arange(len(size)), size)
    shift = ends[which] - 1 - np.arange(len(which))
    bits = (value[which] >> shift & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _segment(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
