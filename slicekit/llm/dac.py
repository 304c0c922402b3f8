"""Directly addressable codes: ids split into chunks of a fixed number of bits,
one level per chunk, with a continuation bitmap and a rank directory per level.

Token ``i`` is read by following it through the levels -- its place on the next
level is the rank of its continuation bit -- so nothing before it is decoded.

Layout (little endian): magic ``DAC1``, chunk bits (u8), levels (u8); then for
each level its number of chunks (u64), the chunks (u8 each), and, on all but the
last level, the bitmap (one bit a chunk, most significant bit first) and the
rank directory (u32: set bits before each block of 512).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BITS = 8
BLOCK = 512  # bits a rank block; a multiple of 8


def encode(ids: np.ndarray) -> bytes:
    """The code of non-negative ids below 2**32; an empty sequence has one empty level."""
    rest = np.asarray(ids, np.uint32)
    levels: list[bytes] = []
    while True:
        more = rest >> BITS > 0
        head = struct.pack("<Q", len(rest)) + (rest & ((1 << BITS) - 1)).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(head)
            break
        bitmap = np.packbits(more)
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[:len(more)] = more
        per = padded.reshape(-1, BLOCK).sum(axis=1)
        levels.append(head + bitmap.tobytes() + (np.cumsum(per) - per).astype("<u4").tobytes())
        rest = rest[more] >> BITS
    return MAGIC + struct.pack("<BB", BITS, len(levels)) + b"".join(levels)


class Reader:
    """Random access to the ids of one code, without decoding what lies before them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.bits, n_levels = struct.unpack_from("<BB", data, 4)
        at, self.levels = 6, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = rank = None
            if k < n_levels - 1:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bitmap)
                rank = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
                at += 4 * len(rank)
            self.levels.append((chunks, bitmap, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, k: int, i: int) -> int:
        """Set bits before place ``i`` on level ``k``."""
        chunks, bitmap, rank = self.levels[k]
        if i >= len(chunks):
            return len(self.levels[k + 1][0])
        block = i // BLOCK
        before = np.unpackbits(bitmap[block * BLOCK // 8:i // 8 + 1])[:i - block * BLOCK]
        return int(rank[block]) + int(before.sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: on each level a contiguous run, found by rank."""
        out = self._level(0, start, stop)
        return out

    def _level(self, k: int, start: int, stop: int) -> np.ndarray:
        chunks, bitmap, _ = self.levels[k]
        out = chunks[start:stop].astype(np.uint32)
        if bitmap is None or stop <= start:
            return out
        more = np.unpackbits(bitmap[start // 8:(stop + 7) // 8])[start % 8:start % 8 + stop - start].astype(bool)
        if more.any():
            first = self._rank(k, start)
            out[more] |= self._level(k + 1, first, first + int(more.sum())) << np.uint32(self.bits)
        return out

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i // 8] >> (7 - i % 8) & 1:
                return value
            i, shift = self._rank(k, i), shift + self.bits
        return value
