"""The numpy side of seeded mapping: k-mer scan of Arrow batches, and extension of seed hits against a dictionary in arrays.

Sequences of a batch lie end to end in one buffer; hits are places in it. Nothing is done read by read: windows of all hits are gathered
at once, compared with the references that their seed leads to, and only what survives becomes rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
CODE[ord("U")] = CODE[ord("u")] = 3
UPPER = np.arange(256, dtype=np.uint8)
UPPER[97:123] -= 32
#: Bases that are scanned at once, pairs of hit and reference that are compared at once, and rows of one result.
SEGMENT, PAIRS, ROWS = 1 << 22, 1 << 18, 1 << 17
BIG = 1 << 10


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each begins (one more for the end); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def parts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the given places."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def seed_places(data: np.ndarray, begin: np.ndarray, flags: np.ndarray, k: int):
    """Of each segment: places, reads and codes of the k-mers whose flag is set; one with another letter than ACGTU, or over a read's end, has no code."""
    for s in range(0, max(0, len(data) - k + 1), SEGMENT):
        c = CODE[data[s : s + SEGMENT + k - 1]]
        n = len(c) - k + 1
        bad = np.concatenate(([0], np.cumsum(c == 255, dtype=np.int32)))
        codes = np.zeros(n, np.int32)
        for i in range(k):
            codes = codes << 2 | (c[i : i + n] & 3)
        at = np.flatnonzero(flags[codes] & (bad[k:] == bad[:-k]))
        codes, at = codes[at], at + s
        read = np.searchsorted(begin, at, "right") - 1
        inside = at + k <= begin[read + 1]
        yield at[inside], read[inside], codes[inside].astype(np.int64)


class Dictionary:
    """References under their seeds, in arrays that are small enough to be broadcast; with seed_mm 1 also under the seeds one substitution away."""

    def __init__(self, refs: pa.Table, k: int, seed_mm: int):
        self.k, self.refs = k, refs
        self.length = refs.column("ref_len").to_numpy().astype(np.int64)
        data, begin = flat(refs.column("ref").combine_chunks()) if refs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.lo, self.hi = (int(self.length.min()), int(self.length.max())) if len(self.length) else (0, k)
        self.bases = np.zeros((refs.num_rows, self.hi), np.uint8)
        inside = np.arange(self.hi) < self.length[:, None]
        self.bases[inside] = data
        code = np.zeros(refs.num_rows, np.int64)
        for i in range(k):
            code = code << 2 | CODE[self.bases[:, i]].astype(np.int64) if len(code) else code
        seeds, rows, order = [code], [np.arange(len(code))], [np.zeros(len(code), np.int64)]
        for p in range(k if seed_mm else 0):
            own = code >> 2 * (k - 1 - p) & 3
            for b in range(4):
                other = np.flatnonzero(own != b)
                seeds.append(code[other] + ((b - own[other]) << 2 * (k - 1 - p)))
                rows.append(other)
                # a read k-mer tries its own substitutions in order of place and base, and the base that it tries is the reference's
                order.append(p * 4 + own[other] + 1)
        seeds, rows, order = np.concatenate(seeds), np.concatenate(rows), np.concatenate(order)
        at = np.argsort(seeds, kind="stable")
        self.seeds, self.rows, self.order = seeds[at], rows[at], order[at]

    def flags(self) -> np.ndarray:
        out = np.zeros(4**self.k, bool)
        out[self.seeds] = True
        return out

    def pairs(self, at, read, codes):
        """Hits and entries of their seeds, PAIRS at a time: places, reads, rows of refs, order of attempts."""
        first, last = np.searchsorted(self.seeds, codes, "left"), np.searchsorted(self.seeds, codes, "right")
        total = np.cumsum(last - first)
        start = 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
            n = last[start:end] - first[start:end]
            entry = np.repeat(first[start:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.repeat(at[start:end], n), np.repeat(read[start:end], n), self.rows[entry], self.order[entry]
            start = end


def hamming(data: np.ndarray, at: np.ndarray, row: np.ndarray, bases: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places in which the windows at `at` differ from the references; windows are whole. U is no T beyond the seed, as any other letter."""
    out = np.zeros(len(at), np.int64)
    for i in range(bases.shape[1]):
        on = length[row] > i
        place = np.minimum(at + i, max(len(data) - 1, 0))
        out += on & (UPPER[data[place]] != bases[row, i])
    return out


def gapped(windows: np.ndarray, avail: np.ndarray, ref: np.ndarray, k: int, m: int, head: np.ndarray):
    """Best alignment of each reference (all of one length) to the beginning of its window, the first k bases without gaps and `head` errors there.

    windows: upper-case bases, at least length + m columns; avail: how many of them the read has. One banded table for all pairs: a cell holds
    edits * BIG + gaps. Returns which pairs are within m edits and, of those, edits, gaps, span and operations; of equal spans' keys (edits, gaps,
    distance of span and length) the shorter span; of paths the first in the order insertion, match, deletion at each step.
    """
    n, width = ref.shape[1] - k, 2 * m + 1  # width: diagonals j - i from -m to m
    none = np.int32((2 * m + 3) * BIG)
    tail, rest, room = windows[:, k:], ref[:, k:], avail - k

    def differ(i: int, j: int) -> np.ndarray:
        return np.where(tail[:, j] != rest[:, i], np.int32(BIG), np.int32(0))

    cost = np.full((len(ref), width), none, np.int32)
    for d in range(m, width):
        cost[:, d] = np.where(d - m <= room, (d - m) * (BIG + 1), none)
    for i in range(1, n + 1):
        new = np.full_like(cost, none)
        for d in range(width):
            j = i + d - m
            if j < 0:
                continue
            best = cost[:, d + 1] + (BIG + 1) if d + 1 < width else np.full(len(ref), none, np.int32)  # deletion
            if j >= 1:
                best = np.minimum(best, cost[:, d] + differ(i - 1, j - 1))
                if d:
                    best = np.minimum(best, new[:, d - 1] + (BIG + 1))  # insertion
            new[:, d] = np.where(j <= room, np.minimum(best, none), none)
        cost = new
    cost = cost + head[:, None] * np.int32(BIG)
    key = cost.astype(np.int64) * 1024 + np.abs(np.arange(width) - m) * 32 + np.arange(width)
    if n - m < 0:
        key[:, : m - n] = np.iinfo(np.int64).max
    d = key.argmin(1)
    total = cost[np.arange(len(ref)), d]
    keep = np.flatnonzero(total // BIG <= m)
    return keep, total[keep] // BIG, total[keep] % BIG, k + n + d[keep] - m, paths(tail[keep], rest[keep], n + d[keep] - m, k, m)


def paths(tail: np.ndarray, rest: np.ndarray, end: np.ndarray, k: int, m: int) -> list[str]:
    """Operations of the best alignments of the whole of rest to the first `end` bases of tail."""
    n, width, rows = rest.shape[1], 2 * m + 1, np.arange(len(rest))
    none = np.int32((2 * m + 3) * BIG)
    cost = np.full((n + 1, len(rest), width + 1), none, np.int32)  # to the end, by bases of rest and diagonal; the last column is beyond the band
    for i in range(n, -1, -1):
        for d in range(width - 1, -1, -1):
            j = i + d - m
            if j < 0:
                continue
            best = np.where((i == n) & (j == end), np.int32(0), none)
            if d + 1 < width:
                best = np.minimum(best, np.where(j < end, cost[i, :, d + 1] + (BIG + 1), none))
            if i < n:
                if j < tail.shape[1]:
                    best = np.minimum(best, np.where(j < end, cost[i + 1, :, d] + np.where(tail[:, j] != rest[:, i], BIG, 0), none))
                if d:
                    best = np.minimum(best, cost[i + 1, :, d - 1] + (BIG + 1))
            cost[i, :, d] = best
    i, j = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
    steps = []
    while True:
        open_ = (i < n) | (j < end)
        if not open_.any():
            break
        d = np.clip(j - i + m, 0, width - 1)
        now = cost[i, rows, d]
        insert = open_ & (j < end) & (d + 1 < width) & (now == cost[i, rows, np.minimum(d + 1, width)] + BIG + 1)
        ii = np.minimum(i, n - 1) if n else i
        same = tail[rows, np.minimum(j, tail.shape[1] - 1)] == rest[rows, ii] if n and tail.shape[1] else np.zeros(len(rest), bool)
        match = open_ & ~insert & (i < n) & (j < end) & (now == cost[np.minimum(i + 1, n), rows, d] + np.where(same, 0, BIG))
        steps.append(np.where(insert, b"I", np.where(match, b"M", np.where(open_, b"D", b""))))
        i, j = i + (open_ & ~insert), j + (insert | match)
    if not steps:
        return ["M" * k] * len(rest)
    return ["M" * k + b"".join(x).decode() for x in np.stack(steps, 1).tolist()]
