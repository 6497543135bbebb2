"""Pairs of items that occur together more often than chance.

Basket collapsing: records with the same set of items become one basket with a weight, pairs are enumerated once per
distinct basket, and weights are summed. Before that, items that can't be in any result pair are taken out; this follows
from the two thresholds and changes no result. What is left is written as numbers before it is grouped, and the pairs of a
long basket are those of pairs of blocks of it, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.keyed import join_checked, join_groups
from textloom.plans.storage import materialise


def baskets(rows: DataFrame, list_name: str, items: Column) -> DataFrame:
    """(list_name, items) of each row: its distinct items, sorted; nulls and items without words are left out."""
    kept = F.array_sort(F.array_distinct(F.filter(items, lambda t: t.isNotNull() & (t != ""))))
    return rows.select(F.lit(list_name).alias("list_name"), F.coalesce(kept, F.array().cast("array<string>")).alias("items"))


def _with_codes(useful: DataFrame) -> DataFrame:
    """Number the rows of a materialised table without a gap; the driver sees one count per partition."""
    number = F.monotonically_increasing_id()
    placed = useful.select("*", F.shiftright(number, 33).cast("int").alias("_part"), number.bitwiseAND((1 << 33) - 1).alias("_at"))
    counts = {r._part: r.n for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) >= 1 << 31:
        raise ValueError("more than 2**31 items could be in a pair")
    offsets = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=0) + 1)])]).tolist()
    code = F.get(F.array(*[F.lit(o) for o in offsets]), F.col("_part")) + F.col("_at")
    return placed.withColumn("code", code.cast("int")).drop("_part", "_at")


#: Useful items are broadcast as a dictionary up to this number and this many bytes, and joined by a shuffle beyond.
MOST_ITEMS, MOST_BYTES = 500_000, 32 << 20


def _numbered(records: DataFrame, useful: DataFrame) -> DataFrame:
    """(list, codes): the sorted codes of each record's useful items, of records with two or more. `useful` has list, item and
    code. The items of a record are looked up where it lies; nothing is shuffled unless the dictionary is too large."""
    size = useful.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("item") + 8), F.lit(0)).alias("bytes")).first()
    if size.n > MOST_ITEMS or size.bytes > MOST_BYTES:
        each = records.withColumn("record", F.monotonically_increasing_id()).select("record", "list", F.explode("items").alias("item"))
        found = join_groups(each, useful, ["list", "item"]).groupBy("record").agg(F.array_sort(F.collect_list("code")).alias("codes"))
        return found.where("size(codes) > 1").select("codes")
    rows = useful.orderBy("code").toArrow()
    lists = {k: rows.filter(pc.equal(rows["list"], k)) for k in rows["list"].unique().to_pylist()}
    known = records.sparkSession.sparkContext.broadcast({k: (t["item"].combine_chunks(), t["code"].to_numpy().astype(np.int32)) for k, t in lists.items()})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, items = pc.index_in(batch.column(0), value_set=pa.array(list(known.value)).cast(batch.column(0).type)).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(1)
            record = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy(zero_copy_only=False))
            flat, codes = items.flatten(), np.full(len(record), -1, np.int32)
            for k, (words, numbers) in enumerate(known.value.values()):
                at = np.flatnonzero(own[record] == k)
                hit = pc.index_in(flat.take(pa.array(at)), value_set=words.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False)
                codes[at] = np.where(hit >= 0, numbers[hit], -1)
            record, codes = record[codes >= 0], codes[codes >= 0]
            order = np.lexsort((codes, record))
            length = np.bincount(record, minlength=len(items))
            many = length > 1
            kept = codes[order][many[record[order]]]
            edges = np.concatenate([[0], np.cumsum(length[many])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), pa.array(kept, pa.int32()))], ["codes"])

    if not known.value:
        return useful.select(F.array("code").alias("codes")).limit(0)
    return records.select("list", "items").mapInArrow(look_up, "codes array<int>")


def _pairs_of(baskets_: DataFrame, block: int) -> DataFrame:
    """(pair, weight) of baskets (codes, weight): both codes of a pair in one number. A basket longer than `block` is cut into
    blocks; the pairs within and between two of them are one row, and these rows are dealt out to the tasks evenly."""
    both = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    short, long = baskets_.where(F.size("codes") <= block), baskets_.where(F.size("codes") > block)
    left = short.select("weight", "codes", F.posexplode("codes").alias("at", "a"))
    inside = left.select("a", "weight", F.explode(F.slice("codes", F.col("at") + 2, F.greatest(F.size("codes"), F.lit(1)))).alias("b"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / block).cast("int")), lambda i: F.slice("codes", i * block + 1, block))
    rows = long.select("weight", cut.alias("blocks")).select("weight", F.posexplode("blocks").alias("i", "left"), "blocks")
    rows = rows.select("weight", "left", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("right"))
    dealt = rows.repartition(baskets_.sparkSession.sparkContext.defaultParallelism * 4)
    between = dealt.select("weight", "right", F.explode("left").alias("a")).select("a", "weight", F.explode(F.filter("right", lambda x: x > F.col("a"))).alias("b"))
    return inside.unionByName(between).select(both(F.col("a"), F.col("b")).alias("pair"), "weight")


def item_pairs(records: DataFrame, min_together: int = 6, min_lift: float = 4.0, block: int = 1000) -> DataFrame:
    """Pairs of different items of one list with item_a before item_b in byte order, together in at least `min_together`
    records, and with together * rows >= min_lift * records_a * records_b: list_name, item_a, item_b, together, records_a,
    records_b, list_rows, lift, conviction of a -> b (null where a never occurs without b).

    `records` is what `baskets` gives, one row per record; records without items count as rows. Exact: an item in fewer
    than `min_together` records, or in more than rows / min_lift (its lift with anything is lower), can't be in a result.
    Empty in, empty out. Records are read twice: to count items, then to number them. At most 2**31 items may qualify.
    """
    rows = records.groupBy("list_name").agg(F.count(F.lit(1)).alias("list_rows"))
    counts = records.select("list_name", F.explode("items").alias("item")).groupBy("list_name", "item").agg(F.count(F.lit(1)).alias("records"))
    useful = counts.where(F.col("records") >= min_together).join(F.broadcast(rows), "list_name").where(F.col("records") * F.lit(min_lift) <= F.col("list_rows"))
    useful = materialise(useful.select("list_name", "item", "records", "list_rows"))
    useful = _with_codes(useful)
    numbered = _numbered(records.select(F.col("list_name").alias("list"), "items"), useful.select(F.col("list_name").alias("list"), "item", "code"))
    again = numbered.groupBy("codes").agg(F.count(F.lit(1)).alias("weight"))
    counted = _pairs_of(again, block).groupBy("pair").agg(F.sum("weight").alias("together")).where(F.col("together") >= min_together)
    together = counted.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "together")
    names = useful.select("code", "list_name", "item", "records", "list_rows")
    side = lambda s: names.select(F.col("code").alias(s), F.col("item").alias(f"item_{s}"), F.col("records").alias(f"records_{s}"), *(["list_name", "list_rows"] if s == "a" else []))
    scored = join_checked(join_checked(together, side("a"), ["a"], MOST_ITEMS), side("b"), ["b"], MOST_ITEMS).where(
        F.col("together") * F.col("list_rows") >= F.lit(min_lift) * F.col("records_a") * F.col("records_b")
    )
    swap = F.col("item_a") > F.col("item_b")
    ordered = scored.select(
        "list_name", F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "together",
        F.when(swap, F.col("records_b")).otherwise(F.col("records_a")).alias("records_a"),
        F.when(swap, F.col("records_a")).otherwise(F.col("records_b")).alias("records_b"), "list_rows",
    )
    alone = F.col("records_a") - F.col("together")
    return ordered.select(
        "*",
        (F.col("together") * F.col("list_rows") / (F.col("records_a") * F.col("records_b"))).alias("lift"),
        F.when(alone > 0, F.col("records_a") * (F.col("list_rows") - F.col("records_b")) / (F.col("list_rows") * alone)).alias("conviction"),
    )
