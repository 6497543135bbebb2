"""How often each distinct term occurs, and in how many records.

Recursive radix spilling: terms are partitioned by leading bits of their hash. Where a partition holds more bytes than one
task should, it is split by further bits, again and again; each final partition goes to disk and is aggregated by DuckDB
in one task. Terms are combined before they leave a task, so a frequent term is one row per task however often it occurs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import materialise, shared_folder

COUNTS = "field_name string, term string, occurrences long, records long"
_SUM = "select field_name, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from t group by all"


def occurrences(rows: DataFrame, field_name: str, terms: Column) -> DataFrame:
    """(field_name, term, occurrences, records) of single records: one row per member of a record's `terms`, an array, in
    which nulls and terms without words are skipped. The first of equal terms counts for the record; that is marked within
    the sorted array, so a row's work and what it hands on are linear in its length, and nothing is shuffled."""
    kept = F.array_sort(F.filter(terms, lambda t: t.isNotNull() & (t != "")))
    first = lambda t, i: (i == 0) | (t != F.get("_terms", i - 1))
    marked = F.transform("_terms", lambda t, i: F.struct(t.alias("term"), F.lit(1).cast("long").alias("occurrences"), first(t, i).cast("long").alias("records")))
    return rows.select(kept.alias("_terms")).select(F.inline(marked)).select(F.lit(field_name).alias("field_name"), "term", "occurrences", "records")


def _aggregate(memory_mb: int, folder: str | None, final: bool):
    """A mapInArrow function: the rows of a partition summed by DuckDB, a batch of bounded bytes at a time.

    Ahead of the shuffle (not `final`) the sums so far are handed on whenever they fill their share of the memory, so that
    stage needs no disk. Behind it all of a partition's sums are held: the plan bounds its bytes, and DuckDB spills to
    `folder` where that is a path it can write.
    """
    share = memory_mb << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil

        import duckdb

        spill = os.path.join(folder, uuid.uuid4().hex) if folder and final else ""
        with duckdb.connect() as db:
            db.execute(f"set memory_limit='{memory_mb}MB'; set threads=1; set preserve_insertion_order=false; set temp_directory='{spill}'")
            db.execute("create table total (field_name varchar, term varchar, occurrences bigint, records bigint)")
            waiting, size, held = [], 0, 0

            def flush() -> int:
                t = pa.Table.from_batches(waiting)  # noqa: F841
                db.execute(f"insert into total {_SUM}")
                return db.execute("select coalesce(sum(strlen(term) + 32), 0) from total").fetchall()[0][0]

            def totals() -> Iterator[pa.RecordBatch]:
                yield from db.sql(_SUM.replace("from t", "from total")).to_arrow_reader(50_000)

            for batch in batches:
                waiting.append(batch)
                size += batch.nbytes
                if size >= share // 4:
                    held, waiting, size = flush(), [], 0
                    if held >= share:
                        if not final:
                            yield from totals()
                            db.execute("delete from total")
                        else:
                            db.execute(f"create table less as {_SUM.replace('from t', 'from total')}; drop table total; alter table less rename to total")
            if waiting:
                flush()
            yield from totals()
        if spill:
            shutil.rmtree(spill, ignore_errors=True)

    return run


def _local_path(folder: str) -> str | None:
    """The shared folder as a path DuckDB can write to; None on object stores, where the plan alone bounds the memory."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    return folder if folder.startswith("/") else None


def _radix_plan(counts: dict[int, int], bits: int, limit: int) -> dict[int, int]:
    """Prefix of `bits` bits -> partition number. A range of prefixes is halved until it holds at most `limit` bytes."""
    plan: dict[int, int] = {}
    todo, number = [(0, 1 << bits)], 0
    while todo:
        low, high = todo.pop()
        inside = sum(counts.get(p, 0) for p in range(low, high))
        if inside > limit and high - low > 1:
            todo += [((low + high) // 2, high), (low, (low + high) // 2)]
        else:
            plan |= {p: number for p in range(low, high)}
            number += 1
    return plan


def count_terms(single: DataFrame, partition_mb: int = 100, bits: int = 12, memory_mb: int = 400) -> DataFrame:
    """Totals (field_name, term, occurrences, records) of rows as `occurrences` gives them. Empty in, empty out.

    The rows of each input partition are combined first. The bytes per prefix of the hash (at most 2**bits numbers reach the
    driver, whatever the input) decide where to split; prefixes of more than `partition_mb` are split by the next bits in
    another round. What is left beyond that after all 64 bits is one term's rows, one per input partition.
    """
    spark = single.sparkSession
    folder, limit = _local_path(shared_folder(spark)), partition_mb << 20
    combined = materialise(single.mapInArrow(_aggregate(memory_mb, folder, False), COUNTS))
    run = _aggregate(memory_mb, folder, True)
    rest, done, shift = combined, None, 64 - bits
    while True:
        prefix = F.shiftrightunsigned(F.xxhash64("field_name", "term"), shift).bitwiseAND((1 << bits) - 1).cast("int")
        keyed = rest.withColumn("_prefix", prefix)
        sizes = {p: n for p, n in keyed.groupBy("_prefix").agg(F.sum(F.octet_length("term") + 32)).collect()}
        oversized = [p for p, n in sizes.items() if n > limit]
        deeper = bool(oversized) and shift >= bits
        here = keyed.where(~F.col("_prefix").isin(oversized)) if deeper else keyed
        within = {p: n for p, n in sizes.items() if not (deeper and p in oversized)}
        even = sum(within.values()) // (3 * spark.sparkContext.defaultParallelism)
        plan = _radix_plan(within, bits, min(limit, max(1 << 20, even)))
        number = F.element_at(F.array(*[F.lit(plan[p]) for p in range(1 << bits)]), F.col("_prefix") + 1)
        part = here.withColumn("_part", number).repartitionById(max(plan.values()) + 1, F.col("_part"))
        total = part.select("field_name", "term", "occurrences", "records").mapInArrow(run, COUNTS)
        done = total if done is None else done.unionByName(total)
        if not deeper:
            return done
        rest, shift = keyed.where(F.col("_prefix").isin(oversized)).drop("_prefix"), shift - bits


def mark_terms(totals: DataFrame, table_rows: DataFrame, rare_records: int = 2, common_share: float = 0.05) -> DataFrame:
    """Add `mark`: rare for terms in at most `rare_records` records, common for terms in more than `common_share` of the
    table's rows, else null. `table_rows` has one row per field: field_name, table_rows."""
    share = F.col("records") > F.lit(common_share) * F.col("table_rows")
    mark = F.when(F.col("records") <= rare_records, "rare").when(share, "common")
    return totals.join(F.broadcast(table_rows), "field_name").withColumn("mark", mark)
