"""Splitting oversized texts at natural boundaries by dynamic programming (p5).

Atoms are the runs of text between boundaries of a level: blank lines, sentence ends, white space, characters. A word over the
limit can be cut between any two of its characters, but not before a combining mark or inside a joined one.
Starting from paragraphs, only atoms that exceed the limit are refined by the next level. Over the resulting cut
positions a dynamic program minimises pieces + cut penalties + size imbalance + missing overlap, subject to the limit.
Each piece after the first begins up to ``overlap`` characters before its cut, at a boundary, so that it repeats the end
of the piece before; the repeated part shrinks where the limit needs it, and ``overlap_missing`` says by how much. A text's boundary
is the finest level of the cuts that the program made: cutting finer than needed never pays, and coarser cuts don't fit. Work per text is linear in its positions times
the positions within one limit, and no row is moved between partitions.

Defined results: null, empty and short texts give no pieces (they need none); a text over the limit that is white space only
gives one empty piece at 0 with boundary 'paragraph'; white space at a cut belongs to no piece;
offsets count Unicode code points from 0; equal texts under different ids are split alike; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "sentence", "word", "character")
#: Penalty of a cut by level, in units of one whole piece.
PENALTY = (0.0, 0.15, 0.6, 1.5)
#: Penalty of an overlap that is left out altogether: more than a further piece, so it is kept wherever a boundary allows it.
SHORTFALL = 3.0
_RUNS = re.compile(r"\s+")


def _atoms(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """Stretches between the boundaries of a level inside text[start:end], without white space at their ends."""
    if level == 3:
        cuts = [i for i in range(start + 1, end) if _may_cut(text, i)] if not text.isascii() else range(start + 1, end)
        return list(zip((start, *cuts), (*cuts, end), strict=True))
    out, at = [], start
    for m in _RUNS.finditer(text, start, end):
        a, b = m.span()
        cut = level == 2 or text.count("\n", a, b) > 1 or (level == 1 and a > 0 and text[a - 1] in ".!?")
        if cut or a == at:
            if a > at:
                out.append((at, a))
            at = b
    if at < end:
        tail = end
        while tail > at and text[tail - 1].isspace():
            tail -= 1
        if tail > at:
            out.append((at, tail))
    return out


def _may_cut(text: str, i: int) -> bool:
    """Whether the characters before and at i are separate: neither a mark that combines nor a joiner is between them."""
    return text[i - 1] != "\u200d" and text[i] != "\u200d" and not unicodedata.category(text[i]).startswith("M")


def refine(text: str, limit: int) -> list[tuple[int, int, int]]:
    """Atoms (start, end, level of the cut before it) that fit the limit."""
    atoms = [(a, b, 0) for a, b in _atoms(text, 0, len(text), 0)]
    for level in (1, 2, 3):
        if all(b - a <= limit for a, b, _ in atoms):
            break
        finer = []
        for a, b, lv in atoms:
            if b - a <= limit:
                finer.append((a, b, lv))
            else:
                finer += [(x, y, level if k else lv) for k, (x, y) in enumerate(_atoms(text, a, b, level))]
        atoms = finer
    # a character with more marks than the limit holds has to be cut all the same
    return [x for a, b, lv in atoms for x in ([(a, b, lv)] if b - a <= limit else [(i, i + 1, 3 if i > a else lv) for i in range(a, b)])]


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """Pieces (start, end, start of what is new) in order, and the index of the finest level cut at."""
    atoms = refine(text, limit)
    if not atoms:
        return [], 0
    start = np.array([a for a, _, _ in atoms])
    end = np.array([b for _, b, _ in atoms])
    level = np.array([lv for _, _, lv in atoms])
    pen = np.array(PENALTY)[level]
    pen[0] = 0.0
    n = len(atoms)
    span = int(end[-1] - start[0])
    pieces = max(1, -(-span // max(1, limit - overlap)))
    # what a piece costs follows from its size alone; the first one repeats nothing
    sizes = np.arange(limit + 1)
    first = 1.0 + ((sizes - span / pieces) / limit) ** 2
    later = first + SHORTFALL * np.minimum(1.0, np.maximum(0, sizes + overlap - limit) / max(1, overlap))
    begun = np.full(n + 1, np.inf)  # cost of all before an atom and of the cut before it
    back = np.zeros(n + 1, np.int64)
    begins, ends, low = start.tolist(), end.tolist(), 0
    for j in range(1, n + 1):
        stop = ends[j - 1]
        while stop - begins[low] > limit:
            low += 1
        c = begun[low:j] + later[stop - start[low:j]]
        if low == 0:
            c[0] = first[stop - begins[0]]
        k = int(c.argmin())
        back[j] = low + k
        begun[j] = c[k] + (pen[j] if j < n else 0.0)
    cuts, j = [], n
    while j > 0:
        cuts.append((int(back[j]), j))
        j = int(back[j])
    out = []
    for i, j in reversed(cuts):
        fresh, stop = int(start[i]), int(end[j - 1])
        room = min(overlap, limit - (stop - fresh))
        begin = _overlap_start(text, fresh, room, int(start[0])) if i and room > 0 else fresh
        out.append((begin, stop, fresh))
    return out, max(int(level[i]) if i else 0 for i, _ in cuts)


def _overlap_start(text: str, cut: int, room: int, first: int) -> int:
    """The earliest sentence, else word, else character at most ``room`` before the cut."""
    low = max(first, cut - room)
    if low >= cut:
        return cut
    # a window that opens exactly behind white space opens at a boundary
    begins = [m.end() for m in _RUNS.finditer(text, max(first, low - 1), cut) if low <= m.end() < cut]
    if low == first:
        begins.insert(0, low)
    return next((b for b in begins if b == first or text[max(0, b - 9) : b].rstrip()[-1:] in (".", "!", "?")), begins[0]) if begins else low


_OUT = "table_name string, row_id long, piece_no int, char_start int, char_end int, new_from int, boundary string, overlap_missing int, piece_text string, piece_metadata string"


def split_oversized(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """One row per piece of every text over ``limit``; narrow, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                pieces, worst = split_text(t, limit, overlap)
                for k, (a, z, fresh) in enumerate(pieces or [(0, 0, 0)]):
                    rows.append((table_name, i, k, a, z, fresh, LEVELS[worst], max(0, overlap - (fresh - a)) if k else 0, t[a:z] if with_text else None, json.dumps({"char_start": a, "char_end": z})))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["table_name", "row_id", "piece_no", "char_start", "char_end", "new_from", "boundary", "overlap_missing", "piece_text", "piece_metadata"],
            )

    long = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.length("t") > limit)
    return long.mapInArrow(run, _OUT)
