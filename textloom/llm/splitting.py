"""Cutting long texts into pieces under a size limit.

A text is taken apart into atoms that leave room for the overlap: its paragraphs, the sentences of a paragraph that is too
long, the words of such a sentence, slices of such a word. Adjacent atoms then merge bottom-up: a heap holds all neighbouring
pairs, the weakest boundary first (none, word, sentence, paragraph; then the smaller sum), and a pair merges while its size
and the overlap fit the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, weakest first.
NONE, WORD, SENTENCE, PARAGRAPH = range(4)
KINDS = ("none", "word", "sentence", "paragraph")
_LINE_BREAK = r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]\s*"
_BREAKS = {
    PARAGRAPH: re.compile(_LINE_BREAK),
    SENTENCE: re.compile(rf"(?<=[.!?])\s+|{_LINE_BREAK}"),
    WORD: re.compile(r"\s+"),
}
_WORD_START = re.compile(r"\s(?=\S)")
SCHEMA = "item_key string, piece int, start int, stop int, overlap int, boundary string, text string"


def _stretches(text: str, start: int, stop: int, kind: int) -> Iterator[tuple[int, int, int]]:
    """(start, end of the content, end with the white space after it); white space ahead belongs to the first stretch."""
    begin = start
    while begin < stop:
        at = begin
        while at < stop and text[at].isspace():
            at += 1
        hit = _BREAKS[kind].search(text, at, stop) if at < stop else None
        end, after = (hit.start(), hit.end()) if hit else (stop, stop)
        while end > at and text[end - 1].isspace():
            end -= 1
        yield begin, end, after
        begin = after


def take_apart(text: str, limit: int, room: int) -> tuple[list[tuple[int, int, int]], int]:
    """Atoms (start, stop, kind of the boundary after it) that tile the text, none longer than `room`, and the coarsest kind of
    which no trimmed stretch exceeds `limit`: the finest kind at which a stretch had to be cut for the limit's sake."""
    atoms: list[tuple[int, int, int]] = []
    needed = PARAGRAPH
    todo = [(0, len(text), PARAGRAPH, PARAGRAPH)]
    while todo:
        start, stop, kind, after = todo.pop()
        if stop - start <= room:
            atoms.append((start, stop, after))
        elif kind == NONE:
            atoms += [(at, min(at + room, stop), NONE if at + room < stop else after) for at in range(start, stop, room)]
        else:
            inner = []
            for a, end, b in _stretches(text, start, stop, kind):
                closing = after if b == stop else kind
                size = len(text[a:end].strip())
                if size > limit:
                    needed = min(needed, kind - 1)
                if size <= room < b - a:
                    lead = end - size
                    inner += [(x, y, NONE, NONE if y < b else closing) for x, y in ((a, lead), (lead, end), (end, b)) if x < y]
                else:
                    inner.append((a, b, kind - 1, closing))
            todo += reversed(inner)
    return atoms, needed


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """Pieces as (start, stop, overlap), and the kind of boundary that suffices for the text: text[start:stop] is new, the
    `overlap` characters before it are repeated from the piece before. The new parts put together are the text; new part and
    overlap together never exceed the limit. Every piece but the first repeats `overlap` characters, up to half of them
    fewer where that lets it begin with a word; all of the piece before if that has no more. '' gives no piece."""
    if not text:
        return [], PARAGRAPH
    room = limit - overlap
    atoms, kind = take_apart(text, limit, room)
    n = len(atoms)
    start, stop, after = [a for a, _, _ in atoms], [b for _, b, _ in atoms], [c for _, _, c in atoms]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(after[i], stop[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and stop[j] - start[i] == size) or size > (room if start[i] else limit):
            continue
        stop[i], after[i], right[i], alive[j] = stop[j], after[j], right[j], False
        if (k := right[i]) < n:
            left[k] = i
            heapq.heappush(heap, (after[i], stop[k] - start[i], i, k))
        if (k := left[i]) >= 0:
            heapq.heappush(heap, (after[k], stop[i] - start[k], k, i))
    pieces, size = [], 0
    for i in range(n):
        if not alive[i]:
            continue
        a, shared = start[i], min(overlap, size)
        if 1 < shared < size or shared == overlap < size:
            natural = _WORD_START.search(text, a - shared - 1, a - shared // 2)
            shared = a - natural.end() if natural else shared
        pieces.append((a, stop[i], shared))
        size = stop[i] - a + shared
    return pieces, kind


def split_items(items: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """Pieces of every text longer than `limit` code points: item_key, piece (from 0), start and stop of its new part, the
    length of the overlap ahead of it, the coarsest boundary that suffices for the whole item, and the piece's text.

    Null, empty and short texts give no rows; repeated keys are split each on their own. Narrow: no shuffle, and only long
    texts reach Python, a batch at a time.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("an overlap of at most half the limit is required")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, kind = split_text(whole, limit, overlap)
                rows += [(item, n, a, b, o, KINDS[kind], whole[a - o : b]) for n, (a, b, o) in enumerate(pieces)]
                held += len(whole)
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    long = items.select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("whole")).where(F.length("whole") > limit)
    return long.mapInArrow(cut, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["item_key", "piece", "start", "stop", "overlap", "boundary", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
