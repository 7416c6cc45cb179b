"""Directly addressable codes: any id of a segment is read without decoding its neighbours.

An id is cut into chunks of 8, 8 and 16 bits, lowest first. Level k holds, in a row, the
k-th chunks of all ids that need one, a bitmap that says which of them go on, and a
directory with the number of set bits before every 512th. The place of an id on the next
level is the number of set bits before it, so one id costs one step per level.

A segment in bytes, little-endian: ``DAC1``, the number of levels (u32), then per level the
number of chunks (u64), the chunks, the bitmap and the directory (u32 each entry).
"""

from __future__ import annotations

import numpy as np

WIDTHS = (8, 8, 16)
BLOCK = 512
_TYPES = {8: np.dtype("u1"), 16: np.dtype("<u2")}


def pack(ids: np.ndarray) -> bytes:
    """A segment of ids below 2**32; also an empty one."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    for width in WIDTHS:
        above = rest >> np.uint32(width)
        more = above > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        before = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append((len(rest), rest.astype(_TYPES[width]), bits, before))
        rest = above[more]
        if not len(rest):
            break
    parts = [b"DAC1", len(levels).to_bytes(4, "little")]
    for size, *arrays in levels:
        parts.append(size.to_bytes(8, "little"))
        parts += [a.tobytes() for a in arrays]
    return b"".join(parts)


class Segment:
    """A view of a packed segment; nothing is decoded when it is opened."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for width in WIDTHS[:int.from_bytes(data[4:8], "little")]:
            size = int.from_bytes(data[at:at + 8], "little")
            chunks = np.frombuffer(data, _TYPES[width], size, at + 8)
            at += 8 + chunks.nbytes
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at)
            at += bits.nbytes
            before = np.frombuffer(data, "<u4", -(-size // BLOCK), at)
            at += before.nbytes
            self.levels.append((width, chunks, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][1])

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, place: int) -> int:
        if place >= 8 * len(bits):  # the end
            return int(before[-1]) + int(np.bitwise_count(bits[(len(before) - 1) * BLOCK // 8:]).sum()) if len(before) else 0
        block, full = place // BLOCK, place // 8
        count = int(before[block]) + int(np.bitwise_count(bits[block * BLOCK // 8:full]).sum())
        return count + (int(bits[full]) & ((1 << place % 8) - 1)).bit_count()

    def id_at(self, place: int) -> int:
        """One id: a chunk, a bit and a rank on each level."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        value = shift = 0
        for width, chunks, bits, before in self.levels:
            value |= int(chunks[place]) << shift
            shift += width
            if not int(bits[place // 8]) >> place % 8 & 1:
                break
            place = self._rank(bits, before, place)
        return value

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from ``first`` up to, not including, ``last``; only their chunks are touched."""
        last = len(self) if last is None else last
        slices = []
        for width, chunks, bits, before in self.levels:
            part = chunks[first:last].astype(np.uint32)
            more = np.unpackbits(bits[first // 8:-(-last // 8)], bitorder="little")[first % 8:first % 8 + last - first].astype(bool)
            slices.append((width, part, more))
            first = self._rank(bits, before, first) if last > first else 0
            last = first + int(more.sum())
        above = None
        for width, part, more in reversed(slices):
            if above is not None:
                part[more] |= above << np.uint32(width)
            above = part
        return above if above is not None else np.empty(0, np.uint32)
