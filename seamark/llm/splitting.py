"""Splitting oversized bodies at natural boundaries (problem 6).

A sparse table over the strengths of a body's possible cuts answers range-maximum queries in constant time; each piece ends at the
strongest cut of its permissible window, the rightmost of equals, and the next piece steps back by the overlap. Where the window has only
white space or nothing, an edge, blank line or line end below it goes before a broken line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.session import cut

#: Strengths of cuts, strongest first: edge of a unit, after a blank line, after a line end, after other white space.
UNIT, BLANK, LINE, SPACE = 4, 3, 2, 1
#: The window reaches down to this share of the largest permissible piece.
LEAST = 0.5


class SparseTable:
    """Rightmost maximum of any range of an array in constant time after n log n preparation."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        # key orders by strength, then by place, so that a plain maximum breaks ties rightward
        self.rows = [strength.astype(np.int64) * (n + 1) + np.arange(n)]
        self.n = n
        k = 1
        while (2 << (k - 1)) <= n:
            half, prev = 1 << (k - 1), self.rows[-1]
            self.rows.append(np.maximum(prev[: n - (1 << k) + 1], prev[half : half + n - (1 << k) + 1]))
            k += 1

    def argmax(self, lo: int, hi: int) -> int:
        """Place of the rightmost maximum in [lo, hi)."""
        k = (hi - lo).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k)]) % (self.n + 1))


def boundaries(body: bytes, units: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and strengths of all natural cuts of a body, places rising."""
    a = np.frombuffer(body, np.uint8)
    n = len(a)
    strength = np.zeros(n + 1, np.int8)
    space = np.isin(a, (32, 9, 10, 13))
    strength[1:][space] = SPACE
    ends = np.flatnonzero(a == 10) + 1
    lone = np.flatnonzero((a[:-1] == 13) & (a[1:] != 10)) + 1 if n > 1 else np.array([], int)
    strength[ends] = LINE
    strength[lone] = LINE
    inside = np.flatnonzero((a[:-1] == 13) & (a[1:] == 10)) + 1 if n > 1 else np.array([], int)
    strength[inside] = 0  # a CR LF pair stays whole
    for m in re.finditer(rb"\n[ \t\r]*\n(?:[ \t\r]*\n)*", body):
        strength[m.end()] = BLANK
    for u in units:
        if 0 < u < n and (a[u] & 0xC0) != 0x80 and not (a[u - 1] == 13 and a[u] == 10):
            strength[u] = UNIT
    places = np.flatnonzero(strength[:n])
    return places, strength[places]


def _char_floor(body: bytes, at: int) -> int:
    while at > 0 and at < len(body) and body[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _char_ceil(body: bytes, at: int) -> int:
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_body(body: bytes, units: list[int], most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece; the [start, end) ranges tile the body."""
    n = len(body)
    if n <= most:
        return [(0, 0, n)]
    overlap = max(0, min(overlap, most - 4))
    places, strength = boundaries(body, units)
    table = SparseTable(strength) if len(places) else None
    out, start = [], 0
    while start < n:
        # a character boundary at or after start-overlap: as much as fits, never more
        back = _char_ceil(body, max(0, start - overlap)) if start else 0
        room = most - (start - back)
        if n - start <= room:
            out.append((back, start, n))
            break
        lo, hi = start + max(1, int(room * LEAST)), start + room
        i, j = int(np.searchsorted(places, lo, "left")), int(np.searchsorted(places, hi, "right"))
        best = table.argmax(i, j) if table is not None and i < j else None
        if table is not None and (best is None or strength[best] < LINE):
            first = int(np.searchsorted(places, start, "right"))
            low = table.argmax(first, i) if first < i else None
            if low is not None and strength[low] >= LINE:
                best = low
        if best is not None:
            cut = int(places[best])
        else:
            cut = _char_floor(body, hi)
            if cut > start + 1 and body[cut - 1] == 13 and body[cut : cut + 1] == b"\n":
                cut -= 1
            if cut <= start:
                cut = _char_ceil(body, start + 1)
        out.append((back, start, cut))
        start = cut
    return out


PIECES = "source_id long, piece_no int, start_byte long, end_byte long, overlap_bytes int, piece string"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source_id", pa.int64()), ("piece_no", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("overlap_bytes", pa.int32()), ("piece", pa.string())])
    for b in batches:
        rows = []
        for sid, text, most, over, units in zip(*(c.to_pylist() for c in b.columns)):
            body = text.encode()
            for k, (back, start, end) in enumerate(split_body(body, units or [], most, over), 1):
                rows.append((sid, k, start, end, start - back, body[back:end].decode()))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def split_oversized(sources: DataFrame, units: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of each body above the limit of its extension: ``source_id, piece_no, start_byte, end_byte, overlap_bytes, piece``.

    ``piece`` begins with the last ``overlap_bytes`` bytes of the piece before; the rest, [start_byte, end_byte), tiles the body. Cuts
    fall on edges of units that belong to this very body, blank lines, line ends or other white space; a line is broken only where the
    piece could hold no whole line, and a word only where its window has no white space either; characters and CR LF pairs stay whole. Bodies that are null, without a known extension or within the limit have no
    rows. A row delivered several times is one; null or out-of-range unit offsets are no edges. A limit is at least 8 bytes.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    lim = limits.select(F.lower("ext").alias("_ext"), "max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes")).filter(F.col("max_bytes") >= 8).dropDuplicates(["_ext"])
    s = sources.select("source_id", "source_hash", "body", ext.alias("_ext")).filter(F.col("body").isNotNull())
    # bodies are read once; those above their limit are written with what the join with their edges needs
    s = cut(s.join(lim, "_ext").filter(F.octet_length("body") > F.col("max_bytes")).dropDuplicates(["source_id"]))
    # at most one edge per byte of the body: the set is bounded by the text that carries it
    edges = units.filter(F.col("start_byte").isNotNull() & F.col("end_byte").isNotNull()).select("source_id", "source_hash", F.explode(F.array("start_byte", "end_byte")).alias("at"))
    edges = edges.join(s.select("source_id", "source_hash"), ["source_id", "source_hash"], "left_semi").groupBy("source_id").agg(F.collect_set("at").alias("edges"))
    return s.join(edges, "source_id", "left").select("source_id", "body", "max_bytes", "overlap_bytes", "edges").mapInArrow(_split, PIECES)
