"""Passages of test items inside a corpus.

Windows of consecutive words, of items and documents alike, get a 64-bit SimHash over their words. An item has windows of two
sizes: every run of `part` words, for passages quoted in part, and windows of the item's own size, for the item as a whole.
(Sizes go up a ladder in steps of about an eighth; two windows of the largest size that fits cover an item from both ends.)

The 64 bits are cut into four blocks. Fingerprints within a radius r agree in some block but for r // 4 bits, so the items'
fingerprints are indexed by all block values that near; looking up a document's four blocks finds every fingerprint within
the radius. Runs of `part` words that are to be the same have the same fingerprint, one block of 64 bits. Candidates are
verified exactly, by the weighted Jaccard similarity of their word shingles.

A passage that shares no shingle with an item has similarity 0 to it. So only those stretches of a document get fingerprints
that are within a window's reach of a shingle of some item; nothing is lost by that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.plans.storage import broadcast_object, broadcast_value

HITS = "doc long, item long, doc_at int, item_at int, size int, distance int, similarity double, same boolean"
_ARROW = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("doc_at", pa.int32()), ("item_at", pa.int32()), ("size", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64()), ("same", pa.bool_())])
BLOCKS, BLOCK_BITS = 4, 16


def word_hashes(unique: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), np.uint64, len(unique))


def word_signs(hashes: np.ndarray) -> np.ndarray:
    """The bits of each word's hash as signs."""
    return (np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1) if len(hashes) else np.zeros((0, 64), np.int16)


def running_signs(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the words' signs from the first word on, modulo 2**16: the sum over a window of up to 32,767 words is the
    difference of two of them."""
    out = np.zeros((len(ids) + 1, 64), np.int16)
    np.cumsum(signs[ids], axis=0, dtype=np.int16, out=out[1:])
    return out


def fingerprints(running: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the `size` words from each position on; the last size - 1 positions have none."""
    if len(running) <= size:
        return np.zeros(0, np.uint64)
    return np.packbits((running[size:] - running[:-size]) > 0, axis=1).view(np.uint64).ravel()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for the `size` words from each position on."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Shingles:
    """The hashes of all shingles of the items, behind a table of bits that tells most others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.known = np.unique(hashes)
        self.shift = np.uint64(64 - max(16, int(8 * len(self.known)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.known >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[hashes >> self.shift])
        slot = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[slot] == hashes[at]]


def ladder(words_in_item: int, part: int) -> int:
    """The largest window size that fits an item: part, then each an eighth more."""
    size = part
    while (larger := size + max(1, size // 8)) <= words_in_item:
        size = larger
    return size


def shingles(w: list[str], size: int) -> Counter:
    """The multiset of word shingles; a text shorter than a shingle is one shingle."""
    return Counter(zip(*[w[k:] for k in range(size)], strict=False) if len(w) >= size else [tuple(w)])


def weighted_jaccard(x: Counter, y: Counter) -> float:
    both = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return both / (x.total() + y.total() - both)


class _Exact:
    """Windows by their whole fingerprint."""

    def __init__(self, prints: np.ndarray) -> None:
        self.order = np.argsort(prints, kind="stable").astype(np.int32)
        self.known, self.start, self.count = np.unique(prints[self.order], return_index=True, return_counts=True)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        at = np.flatnonzero(self.known[slot] == prints)
        position, window = _expand(at, self.start[slot[at]], self.count[slot[at]], self.order)
        return position, window, np.zeros(len(position), np.int64)


class _Blocks:
    """Windows by the blocks of their fingerprints, under every value within radius // BLOCKS bits of their own."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        flips = np.array([sum(1 << b for b in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), k)], np.uint32)
        self.tables = []
        for block in range(BLOCKS):
            own = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            keys = (own[:, None] ^ flips[None]).ravel()
            order = (np.argsort(keys, kind="stable") // max(1, len(flips))).astype(np.int32)
            count = np.bincount(keys, minlength=1 << BLOCK_BITS)
            self.tables.append((np.concatenate([[0], np.cumsum(count)]), order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, windows, distances) of all pairs within the radius; a pair may come once per block."""
        found = []
        for block, (start, order) in enumerate(self.tables):
            keys = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = start[keys + 1] - start[keys]
            at = np.flatnonzero(n)
            position, window = _expand(at, start[keys[at]], n[at], order)
            distance = np.bitwise_count(prints[position] ^ self.prints[window]).astype(np.int64)
            near = distance <= self.radius
            found.append((position[near], window[near], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _expand(at: np.ndarray, start: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    position = np.repeat(at, n)
    offset = np.arange(len(position)) - np.repeat(np.cumsum(n) - n, n)
    return position, order[np.repeat(start, n) + offset]


class ItemIndex:
    """The items' windows, by size. Work and memory are linear in the items' words; each word is hashed once."""

    def __init__(self, items: list[tuple[int, list[str]]], part: int, radius: int, shingle: int = 5) -> None:
        if not 0 < shingle <= part:
            raise ValueError("0 < shingle <= part is required")
        self.shingle, self.part, self.items = shingle, part, [(i, w) for i, w in items if len(w) >= part]
        vocabulary: dict[str, int] = {}
        coded = [np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int64, len(w)) for _, w in self.items]
        hashes = word_hashes(list(vocabulary))
        signs = word_signs(hashes)
        each = [shingle_hashes(hashes[ids], shingle) for ids in coded]
        self.shingles = _Shingles(np.concatenate(each)) if each else None
        prints: dict[int, list] = {}
        places: dict[int, list] = {}
        for k, ids in enumerate(coded):
            running, size = running_signs(ids, signs), ladder(len(ids), part)
            own = {size: sorted({0, len(ids) - size})} | {part: range(len(ids) - part + 1)}
            for n, starts in own.items():
                prints.setdefault(n, []).append(fingerprints(running, n)[list(starts)])
                places.setdefault(n, []).extend((k, s) for s in starts)
        self.sizes = {}
        for n in sorted(prints):
            joined = np.concatenate(prints[n])
            self.sizes[n] = (_Exact(joined) if n == part else _Blocks(joined, radius), np.array(places[n], np.int32))


def find_leaks(
    documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str,
    part: int = 12, radius: int = 7, shingle: int = 5, similarity: float = 0.8, words_at_once: int = 2_000_000,
) -> DataFrame:
    """Verified pairs of a document and an item: doc, item, the first words of the passage in both, its size in words, the
    Hamming distance of the windows, the passage's similarity, and whether all its words are the same in order.

    Rows of size `part` are runs of that many words; rows of a larger size are the whole item against as many words of the
    document, found through a window of the item's size within the radius. Null, empty and shorter texts have neither.
    Repeated rows of a document or item give repeated rows. The radius is guaranteed; that pairs of the given similarity lie
    within it is likely, not certain: for one changed word in 60 or two in 100, 997 to 999 of 1,000 do, and the run of 12
    words that any such pair keeps is found with certainty.

    Items are broadcast in blocks of at most `words_at_once` words, an item beyond that alone; every block meets every
    document. Documents are read once per block, without a shuffle, so neither a large source nor a very long text gathers
    in one task; a text is taken in stretches.
    """
    spark = documents.sparkSession
    listed = items.select(F.col(item).cast("long").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") >= part)
    total = listed.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // words_at_once))
    corpus = documents.select(F.col(doc).cast("long").alias("doc"), words(F.coalesce(text, F.lit(""))).alias("w"))
    found = None
    for k in range(n_blocks):
        block = listed.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k) if n_blocks > 1 else listed
        index = broadcast_object(spark, ItemIndex([(r.item, list(r.w)) for r in block.collect()], part, radius, shingle))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = broadcast_value(index)
            for batch in batches:
                yield from _scan(batch, known, similarity)

        hits = corpus.mapInArrow(scan, HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def _stretches(edges: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about `most`, along whole documents; a longer document is cut, its ranges overlap."""
    begin = 0
    for row in range(len(edges) - 1):
        if edges[row + 1] - begin > most and edges[row] > begin:
            yield int(begin), int(edges[row])
            begin = edges[row]
        while edges[row + 1] - begin > most + overlap:
            yield int(begin), int(begin + most + overlap)
            begin += most
    if len(edges) > 1 and edges[-1] > begin:
        yield int(begin), int(edges[-1])


def _near_items(ids: np.ndarray, hashes: np.ndarray, edges: np.ndarray, known: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """The words within a window's reach of a shingle of some item, as (positions, edges of their runs)."""
    hits = known.shingles.hits(shingle_hashes(hashes[ids], known.shingle))
    if not len(hits):
        return hits, np.zeros(1, np.int64)
    row, reach = np.searchsorted(edges, hits, "right") - 1, max(known.sizes)
    begin, end = np.maximum(hits - reach, edges[row]), np.minimum(hits + known.shingle + reach, edges[row + 1])
    first = np.concatenate([[True], begin[1:] > np.maximum.accumulate(end)[:-1]])
    low, high = begin[first], np.maximum.accumulate(end)[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
    runs = np.concatenate([[0], np.cumsum(high - low)])
    return np.arange(runs[-1]) + np.repeat(low - runs[:-1], high - low), runs


def _scan(batch: pa.RecordBatch, known: ItemIndex, similarity: float, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    if not known.items or not batch.num_rows:
        return
    lists = batch.column(1)
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes, ids = word_hashes(vocabulary), coded.indices.to_numpy(zero_copy_only=False)
    signs = word_signs(hashes)
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    docs, seen, memo, wanted = batch.column(0).to_numpy(), set(), {}, {}
    place, runs = _near_items(ids, hashes, edges, known)
    for begin, end in _stretches(runs, most, max(known.sizes)):
        rows, here = [], place[begin:end]
        running = running_signs(ids[here], signs)
        for size, (index, places) in known.sizes.items():
            position, window, distance = index.candidates(fingerprints(running, size))
            whole = here[np.minimum(position + size, len(here)) - 1] == here[position] + size - 1
            position, window, distance = here[position[whole]], window[whole], distance[whole]
            row = np.searchsorted(edges, position, "right") - 1
            inside = position + size <= edges[row + 1]
            for p, r, (k, s), d in zip(position[inside].tolist(), row[inside].tolist(), places[window[inside]].tolist(), distance[inside].tolist(), strict=True):
                item, own = known.items[k]
                at, first, length = (p, s, size) if size == known.part else (max(int(edges[r]), p - s), 0, len(own))
                if (at, k, first, length) in seen:
                    continue
                seen.add((at, k, first, length))
                mine = tuple(ids[at : min(at + length, int(edges[r + 1]))].tolist())
                if (mine, k, first, length) not in memo:
                    a, b = [vocabulary[i] for i in mine], own[first : first + length]
                    if (k, first, length) not in wanted:
                        wanted[k, first, length] = shingles(b, known.shingle)
                    memo[mine, k, first, length] = (1.0 if a == b else weighted_jaccard(wanted[k, first, length], shingles(a, known.shingle)), a == b)
                score, same = memo[mine, k, first, length]
                if score >= similarity:
                    rows.append((int(docs[r]), item, at - int(edges[r]), first, length, d, score, same))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
