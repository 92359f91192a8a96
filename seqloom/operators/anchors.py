"""Anchor extraction: the part of a read between two known sequences, or beside one.

Exact places are looked for first, whatever errors are allowed; only a read without an exact window is searched with errors. The search with
errors is one edit-distance table a hit, filled a pattern row at a time over all read positions with numpy: a cell holds edits and start as one
number, so that a minimum keeps the earliest start among equal edits, and insertions along the read are a running minimum.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits of an anchor that count, in order of start; part of the semantics.
CAP = 8
BIG = 1 << 32
_TURN = str.maketrans("ACGT", "TGCA")


def turned(seq: str) -> str:
    return "".join(c if c in "ACGT" else "N" for c in seq.upper()).translate(_TURN)[::-1]


@dataclass(frozen=True)
class Anchors:
    a5: str = ""
    a3: str = ""
    max_error: int = 0
    min_len: int = 1
    max_len: int = 1 << 31

    def __post_init__(self):
        for name in ("a5", "a3"):
            s = getattr(self, name).upper().replace("U", "T")
            if len(s) > 63 or set(s) - set("ACGT"):
                raise ValueError("an anchor has at most 63 letters of ACGT")
            object.__setattr__(self, name, s)
        if not 0 <= self.max_error <= 5:
            raise ValueError("max_error must be from 0 to 5")

    @classmethod
    def parse(cls, text: str, **more) -> Anchors:
        """`A...B`, `A...` or `...B`."""
        parts = text.split("...")
        if len(parts) != 2 or not any(parts):
            raise ValueError("anchors must be A...B, A... or ...B")
        return cls(parts[0], parts[1], **more)


def exact_hits(text: str, pattern: str, start: int) -> list[tuple[int, int, int]]:
    out, at = [], text.find(pattern, start)
    while at != -1 and len(out) < CAP:
        out.append((at, at + len(pattern), 0))
        at = text.find(pattern, at + 1)
    return out


def table(text: np.ndarray, pattern: np.ndarray, keep_rows: bool = False):
    """Last row (or all rows) of edits * BIG + start over the ends 0..n."""
    n = len(text)
    key = np.arange(n + 1, dtype=np.int64)
    steps, rows = np.arange(n + 1, dtype=np.int64) * BIG, [key]
    for i, c in enumerate(pattern, 1):
        cell = np.empty(n + 1, np.int64)
        cell[0] = i * BIG
        cell[1:] = np.minimum(key[:-1] + (text != c) * BIG, key[1:] + BIG)
        key = np.minimum.accumulate(cell - steps) + steps
        rows.append(key)
    return rows if keep_rows else key


class Near:
    """The places of a pattern with errors, in order of start: the earliest start, then fewest errors, nearest length, first end; the next search
    begins one after it.

    A search that begins anywhere after one hit and up to the next gives that next hit, as what starts before it has too many errors. So one
    chain of searches over the text serves all searches, and each hit costs one table.
    """

    def __init__(self, text: str, pattern: str, max_error: int):
        self.letters, self.want = np.frombuffer(text.encode("ascii", "replace"), np.uint8), np.frombuffer(pattern.encode(), np.uint8)
        self.most, self.hits, self.at = min(max_error, len(pattern)), [], 0

    def _more(self) -> bool:
        if self.at >= len(self.letters):
            return False
        key = table(self.letters[self.at :], self.want)[1:]
        errors, begin = key >> 32, key & (BIG - 1)
        ends = np.flatnonzero(errors <= self.most)
        if not len(ends):
            self.at = len(self.letters)
            return False
        b, e = begin[ends], errors[ends]
        best = np.lexsort((ends, np.abs(ends + 1 - b - len(self.want)), e, b))[0]
        self.hits.append((self.at + int(b[best]), self.at + int(ends[best]) + 1, int(e[best])))
        self.at = self.hits[-1][0] + 1
        return True

    def after(self, start: int) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the first CAP hits of a search that begins at start."""
        out, i = [], bisect_left(self.hits, (start, -1, -1))
        while len(out) < CAP and start < len(self.letters) and (i < len(self.hits) or self._more()):
            if self.hits[i][0] >= start:
                out.append(self.hits[i])
            i += 1
        return out


def near_hits(text: str, pattern: str, max_error: int, start: int) -> list[tuple[int, int, int]]:
    return Near(text, pattern, max_error).after(start)


def windows(text: str, opt: Anchors, max_error: int | None, limits: tuple[int, int] | None = None):
    """Best (errors, first start, length, insert start, orientation, start hit, end hit); max_error None: exact."""
    lo, hi = limits or (opt.min_len, opt.max_len)
    chains: dict[str, Near] = {}

    def find(pattern: str, at: int) -> list[tuple[int, int, int]]:
        if max_error is None:
            return exact_hits(text, pattern, at)
        if pattern not in chains:
            chains[pattern] = Near(text, pattern, max_error)
        return chains[pattern].after(at)

    n, found = len(text), []
    if opt.a5 and opt.a3:
        for order, (a, b) in enumerate(((opt.a5, opt.a3), (turned(opt.a3), turned(opt.a5)))):
            best = None
            for s in find(a, 0):
                if s[1] >= n:
                    continue
                for e in find(b, s[1]):
                    if max(lo, 1) <= e[0] - s[1] <= hi:
                        c = (s[2] + e[2], s[0], e[0] - s[1], s[1], order, s, e)
                        best = c if best is None or c[:4] < best[:4] else best
                if best is not None and best[0] == 0 and best[1] == s[0]:
                    break
            found += [best] if best else []
    elif opt.a5:
        for s in find(opt.a5, 0):
            size = lo if lo == hi else n - s[1]
            if s[1] <= n and s[1] + size <= n and max(lo, 1) <= size <= hi:
                found.append((s[2], s[0], size, s[1], 0, s, None))
    elif opt.a3:
        for e in find(opt.a3, 0):
            size = lo if lo == hi else e[0]
            if size <= e[0] and max(lo, 1) <= size <= hi:
                found.append((e[2], e[0], size, e[0] - size if lo == hi else 0, 0, None, e))
    return min(found, key=lambda c: c[:5], default=None)


def extract(seq: str | None, opt: Anchors):
    """The window, exact before approximate; None if there is none."""
    text = (seq or "").upper()
    best = windows(text, opt, None)
    return best if best is not None or not opt.max_error else windows(text, opt, opt.max_error)


WINDOW = "orientation string, insert_start int, insert_len int, a5_start int, a5_end int, a5_errors int, a3_start int, a3_end int, a3_errors int"


def as_row(best) -> list:
    if best is None:
        return [None] * 9
    _, _, size, start, order, s, e = best
    first, last = ((s, e) if order == 0 else (e, s))
    return ["RC" if order else "FWD", start, size, *(first or (None,) * 3), *(last or (None,) * 3)]


def extracted(reads: DataFrame, opt: Anchors) -> DataFrame:
    """read_id, seq, qual and the window's columns; nulls without a window."""

    def run(batches):
        for batch in batches:
            rows = [as_row(extract(s, opt)) for s in batch.column("seq").to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int32()) for i in range(9)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *cols], names=[*batch.schema.names, *(x.split()[0] for x in WINDOW.split(", "))])

    base = reads.select("read_id", "seq", "qual")
    return base.mapInArrow(run, f"read_id long, seq string, qual string, {WINDOW}")


# ---- trimming


def cut(reads: DataFrame, opt: Anchors, check_rc: bool = False) -> DataFrame:
    """read_id, seq, qual, from_rc, and name if reads have it, of every read that has a window, trimmed to it; reads without a quality of their
    length are left out.

    With check_rc a read without a window is turned round and tried again.
    """
    named = ["name"] if "name" in reads.columns else []

    def run(batches):
        for batch in batches:
            out, kept = [], []
            for i, (seq, qual) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "qual")))):
                best, rc = extract(seq, opt), False
                if best is None and check_rc:
                    seq, qual, rc = turned(seq.upper().replace("U", "T")), qual[::-1], True
                    best = extract(seq, opt)
                if best is not None:
                    a, b = best[3], best[3] + best[2]
                    out.append((seq[a:b], qual[a:b], rc))
                    kept.append(i)
            cols = [pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.string(), pa.string(), pa.bool_()))]
            own = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("read_id", *named)]
            yield pa.RecordBatch.from_arrays([own[0], *cols, *own[1:]], names=["read_id", "seq", "qual", "from_rc", *named])

    good = reads.where(F.length("qual") == F.length("seq")).select(F.col("read_id").cast("long").alias("read_id"), "seq", "qual", *named)
    return good.mapInArrow(run, "read_id long, seq string, qual string, from_rc boolean" + ", name string" * bool(named))


def insert_counts(trimmed: DataFrame) -> DataFrame:
    """sequence, count; sort by count descending, then sequence."""
    return trimmed.groupBy(F.col("seq").alias("sequence")).agg(F.count(F.lit(1)).alias("count"))


def cut_stats(reads: DataFrame, trimmed: DataFrame) -> DataFrame:
    """One row: total, kept, discarded, kept_revcomp."""
    total = reads.agg(F.count(F.lit(1)).alias("total"))
    kept = trimmed.agg(F.count(F.lit(1)).alias("kept"), F.count_if("from_rc").alias("kept_revcomp"))
    return total.join(kept).select("total", "kept", (F.col("total") - F.col("kept")).alias("discarded"), "kept_revcomp")


# ---- tags


def anchor_md(read: str, anchor: str) -> str:
    """MD-like text of a global alignment: a match or substitution unless an insertion, then a deletion, is strictly better."""
    if read == anchor:
        return str(len(anchor))
    n, m = len(anchor), len(read)
    letters, steps = np.frombuffer(read.encode("ascii", "replace"), np.uint8), np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), np.int64)
    cost[0] = steps
    differ = np.frombuffer(anchor.encode("ascii", "replace"), np.uint8)[:, None] != letters
    for i in range(1, n + 1):
        cost[i, 0] = i
        cost[i, 1:] = np.minimum(cost[i - 1, :-1] + differ[i - 1], cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(cost[i] - steps) + steps  # insertions along the read
    i, j, ops = n, m, []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + differ[i - 1, j - 1]:
            o = 0
        elif j and (not i or cost[i, j] == cost[i, j - 1] + 1):
            o = 1
        else:
            o = 2
        ops.append("MID"[o])
        i, j = i - (o != 1), j - (o != 2)
    from seqloom.operators.indels import md_of

    return md_of("".join(reversed(ops)), read, anchor)


def za_tag(seq: str, best, opt: Anchors) -> str:
    """The ZA tag of a read with a window."""
    _, _, size, start, order, s, e = best
    first, last = ((s, e) if order == 0 else (e, s))
    out = [f"ZA:Z:ori={'RC' if order else 'FWD'}", f"ins={start + 1},{size}", _status(opt, first, last)]
    for name, hit, a in (("a5", first, opt.a5), ("a3", last, opt.a3)):
        if hit:
            out.append(_detail(name, seq, hit, turned(a) if order else a))
    return ";".join(out)


def _status(opt: Anchors, first, last, three: bool = True) -> str:
    """pass, fail or na of both anchors; three: the 3' anchor was looked for."""
    five = "pass" if first else "fail" if opt.a5 else "na"
    return f"ast=5:{five},3:{'pass' if last else 'fail' if opt.a3 and three else 'na'}"


def _detail(name: str, seq: str, hit, anchor: str) -> str:
    return f"{name}={hit[0] + 1}-{hit[1]},ed={hit[2]},md={anchor_md(seq[hit[0] : hit[1]].upper(), anchor)}"


def nearest(text: str, pattern: str) -> tuple[int, int, int] | None:
    """(start, end, errors) of the place most like the pattern: fewest errors, then earliest start, nearest length, first end."""
    if not text:
        return None
    key = table(np.frombuffer(text.encode("ascii", "replace"), np.uint8), np.frombuffer(pattern.encode(), np.uint8))[1:]
    ends = np.flatnonzero(key == key.min())  # edits and start are one number
    begin = int(key.min() & (BIG - 1))
    end = 1 + int(ends[np.argmin(np.abs(ends + 1 - begin - len(pattern)))])
    return begin, end, int(key.min() >> 32)


def _failed(name: str, text: str, anchor: str) -> list[str]:
    hit = nearest(text, anchor)
    return [] if hit is None else [f"{name}={hit[0] + 1}-{hit[1]},len={hit[1] - hit[0]},ed={hit[2]},md={anchor_md(text[hit[0] : hit[1]], anchor)}"]


def single_start(text: str, opt: Anchors):
    """(errors, start, length, orientation, hit) of a two-sided pair's first anchor alone: a5, or a3 turned round; exact before approximate."""
    for find in (lambda p: exact_hits(text, p, 0), lambda p: near_hits(text, p, opt.max_error, 0)):
        found = [(h[2], h[0], len(p), order, h) for order, p in enumerate((opt.a5, turned(opt.a3))) for h in find(p)]
        if found:
            return min(found)
    return None


def unmapped_tag(seq: str | None, opt: Anchors, expected: int) -> str:
    """The ZA tag of a read without a window: a two-sided pair of another length, one anchor alone, or the places most like the anchors."""
    text = (seq or "").upper()
    if not (opt.a5 and opt.a3):
        # one anchor; only it is looked for
        return ";".join(["ZA:Z:reason=anchor_not_found", _status(opt, None, None), *(_failed("a5f", text, opt.a5) if opt.a5 else _failed("a3f", text, opt.a3))])
    best = windows(text, opt, None, (1, 1 << 31)) or (windows(text, opt, opt.max_error, (1, 1 << 31)) if opt.max_error else None)
    if best is not None:
        why = "insert_len_lt" if best[2] < expected else "insert_len_gt" if best[2] > expected else "anchor_window_rejected"
        head, rest = za_tag(text, best, opt).split(";ast=")
        return f"{head};exp={expected};reason={why};ast={rest}"
    one = single_start(text, opt)
    if one is not None:
        order, hit = one[3], one[4]
        if order:
            parts = ["ZA:Z:ori=RC;partial=1", _status(opt, None, hit), _detail("a3rc", text, hit, turned(opt.a3)), *_failed("a5f", text, turned(opt.a5))]
        else:
            parts = ["ZA:Z:ori=FWD;partial=1", _status(opt, hit, None), _detail("a5", text, hit, opt.a5), *_failed("a3f", text, opt.a3)]
        return ";".join(parts)
    return ";".join(["ZA:Z:reason=anchor_not_found", _status(opt, None, None, three=False), *_failed("a5f", text, opt.a5)])


def tags(reads: DataFrame, opt: Anchors) -> DataFrame:
    """read_id, has_window, tag: the ZA tag of reads with a window and of the others."""

    def run(batches):
        for batch in batches:
            found, out = [], []
            for seq in batch.column("seq").to_pylist():
                best = extract(seq, opt)
                found.append(best is not None)
                out.append(za_tag(seq, best, opt) if best else unmapped_tag(seq, opt, opt.min_len))
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), pa.array(found), pa.array(out, pa.string())], names=["read_id", "has_window", "tag"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, has_window boolean, tag string")
