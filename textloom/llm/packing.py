"""Filling containers of fixed capacity with items that aren't split.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each time into the fullest-to-empty
order's far end, the pattern with most room; whole runs of equal items move at once, so the work depends on the number of
distinct lengths (at most the capacity) and not on the number of items. The finished patterns say how many items of each
length go into which containers; items find their place by their rank among items of equal length.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.keyed import rank_within
from textloom.plans.storage import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts text ahead of merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, tokens) of each text by a byte-level BPE read from `vocabulary`. Null texts give null, empty ones 0."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([None if x is None else len(encoder.encode_ordinary(x)) for x in batch], dtype="Int32")

    return documents.select(F.col(key).alias("item"), count(F.col(text)).alias("tokens"))


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (number of containers, ((length, items of that length), ...) in order of placing)."""
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    room: list[int] = []

    def put(left: int, packs: int, pattern: tuple) -> None:
        if not open_packs[left]:
            heapq.heappush(room, -left)
        open_packs[left].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            left = -room[0] if room else -1
            if left < length:
                each = capacity // length
                if full := count // each:
                    put(capacity - each * length, full, ((length, each),))
                if rest := count % each:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            packs, pattern = open_packs[left].pop()
            if not open_packs[left]:
                heapq.heappop(room)
            taken = min(packs, count)
            if taken < packs:
                put(left, packs - taken, pattern)
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(left - length, taken, grown)
            count -= taken
    return sorted((packs, pattern) for groups in open_packs.values() for packs, pattern in groups)


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place items (item, tokens): container, slot (order within the container), item, part, tokens, fill (tokens in the
    container). Items of null or 0 tokens take no place. An item beyond the capacity is cut into full parts and a rest,
    which are placed like items; every other item is whole and has part 0. Repeated items are placed each.

    The driver sees the histogram, at most `capacity` rows. The patterns are as many as the histogram allows, whatever the
    number of items, so they are broadcast.
    """
    spark = items.sparkSession
    full = F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)
    parts = items.where("tokens > 0").select("item", "tokens", F.explode(full).alias("part"))
    parts = materialise(parts.select("item", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("length")))
    histogram = {n: c for n, c in parts.groupBy("length").count().collect()}
    used, container, places = defaultdict(int), 0, []
    for packs, pattern in pack_histogram(histogram, capacity):
        slot, fill = 0, sum(n * k for n, k in pattern)
        for length, each in pattern:
            places.append((length, used[length], used[length] + packs * each, each, container, slot, fill))
            used[length] += packs * each
            slot += each
        container += packs
    schema = "length int, low long, high long, each int, first long, slot0 int, fill int"
    placed = F.broadcast(spark.createDataFrame(pd.DataFrame(places, columns=[x.split()[0] for x in schema.split(", ")]), schema))
    ranked = rank_within(parts, "length", ["item", "part"], "rank")
    within = F.col("rank") - F.col("low")
    return ranked.join(placed, "length").where("rank >= low and rank < high").select(
        (F.col("first") + F.floor(within / F.col("each"))).alias("container"),
        (F.col("slot0") + within % F.col("each")).cast("int").alias("slot"),
        "item", "part", F.col("length").alias("tokens"), "fill",
    )
