"""Readers. CSV is read as strings by an explicit header, then cast where a value can be cast."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.rules import trimmed
from textloom.operators.context import parse_list

# Names that columns go by, first match wins.
TEXT_COLUMNS = ["text", "instance_text", "content", "document", "body"]
ID_COLUMNS = ["text_id", "id", "doc_id", "document_id"]


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may span lines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def pick_columns(columns: Sequence[str], text: str | None = None, key: str | None = None) -> tuple[str, str | None]:
    """Names of the text and id columns: as asked for, else the first known name. Raises if there is no text column, or no
    column of the name asked for as id."""
    if key is not None and key not in columns:
        raise ValueError(f"no column {key} in {list(columns)}")
    chosen = text if text in columns else next((c for c in TEXT_COLUMNS if c in columns), None)
    if chosen is None:
        raise ValueError(f"no text column in {list(columns)}")
    return chosen, key or next((c for c in ID_COLUMNS if c in columns), None)


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Add 1-based row numbers in file order as strings. The driver sees one count per partition; rows stay in the JVM."""
    number = F.monotonically_increasing_id()
    placed = rows.withColumns({"_part": F.shiftright(number, 33).cast("int"), "_at": number.bitwiseAND((1 << 33) - 1)})
    counts = {r["_part"]: r.n for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, ahead = [], 0
    for part in range(max(counts, default=0) + 1):
        offsets.append(ahead)
        ahead += counts.get(part, 0)
    start = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_part"))
    return placed.withColumn(name, (start + F.col("_at") + 1).cast("string")).drop("_part", "_at")


def texts(spark: SparkSession, path: str, text: str | None = None, key: str | None = None, group: str | None = None, limit: int | None = None) -> DataFrame:
    """text_id, text, group. Null texts are ''. Without an id column ids are 1-based row numbers in file order, by
    per-partition counts, so no single task numbers all rows."""
    rows = csv(spark, path)
    t, k = pick_columns(rows.columns, text, key)
    if k is None:
        rows = row_numbers(rows, "_row")
    out = rows.select(F.col(k or "_row").alias("text_id"), F.coalesce(F.col(t), F.lit("")).alias("text"), (F.col(group) if group in rows.columns else F.lit(None).cast("string")).alias("group"))
    return out.limit(limit) if limit else out


def _optional(rows: DataFrame, name: str, default: Column | None = None) -> Column:
    return F.col(name) if name in rows.columns else (default if default is not None else F.lit(None).cast("string"))


def _strings(cell: Column) -> Column:
    """A JSON array in a cell, else the cell as the only member."""
    parsed = F.from_json(cell, "array<string>")
    return F.when(trimmed(cell).startswith("["), parsed).otherwise(F.when(trimmed(cell) != "", F.array(cell)))


def relationships(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """One superset schema for plain, merged and causal files, told apart by their header. Rows with a blank source, target
    or type drop; a window number that isn't one is 0; is_causal is true, 1 or yes in any case."""
    raw = csv(spark, path)
    n = {c: c for c in ("source", "target", "type", "description", "text_id", "window_index")} | (names or {})
    truth = F.lower(trimmed(_optional(raw, "is_causal"))).isin("true", "1", "yes")
    rows = raw.select(
        *[trimmed(F.col(n[c])).alias(c) for c in ("source", "target", "type")],
        F.coalesce(_optional(raw, n["description"]), F.lit("")).alias("description"), _optional(raw, n["text_id"]).alias("text_id"),
        F.coalesce(_optional(raw, n["window_index"]).try_cast("int"), F.lit(0)).alias("window_index"),
        F.coalesce(_optional(raw, "count").try_cast("int"), F.lit(1)).alias("count"), _optional(raw, "confidence").try_cast("double").alias("confidence"),
        _strings(_optional(raw, "descriptions")).alias("descriptions"), _strings(_optional(raw, "text_ids")).alias("text_ids"),
        F.from_json(_optional(raw, "window_indices"), "array<int>").alias("window_indices"),
        *[_optional(raw, c).alias(c) for c in ("original_source", "original_target", "original_type", "polarity", "certainty", "explicit_vs_implicit", "reasoning")],
        (F.coalesce(truth, F.lit(False)) if "is_causal" in raw.columns else F.lit(None).cast("boolean")).alias("is_causal"),
    )
    kind = "causal" if "is_causal" in raw.columns else "merged" if {"original_source", "count"} & set(raw.columns) else "plain"
    return rows.where("source <> '' and target <> '' and type <> ''").withColumn("kind", F.lit(kind))


def entities(spark: SparkSession, path: str, entity: str = "entity", context: str | None = "context", text_id: str | None = "text_id", limit: int | None = None) -> DataFrame:
    raw = csv(spark, path)
    rows = raw.select(
        trimmed(F.col(entity)).alias("entity"), F.coalesce(_optional(raw, context or ""), F.lit("")).alias("context"), _optional(raw, text_id or "").alias("text_id"),
        _optional(raw, "window_index").try_cast("int").alias("window_index"), _optional(raw, "group").alias("group"),
    ).where("entity <> ''")
    return rows.limit(limit) if limit else rows


def entity_frequencies(spark: SparkSession, path: str, entity: str = "entity", frequency: str | None = None) -> DataFrame:
    """(label, count): summed frequencies, those that aren't whole numbers ignored; rows count 1 without a column."""
    raw = csv(spark, path)
    n = F.col(frequency).try_cast("int") if frequency else F.lit(1)
    rows = raw.select(trimmed(F.col(entity)).alias("label"), n.alias("n")).where("label <> ''")
    return rows.groupBy("label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def inline_groups(spark: SparkSession, spec: str) -> DataFrame:
    """(group, participant) from "a:p1,p2;b:p3"."""
    rows = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        name, found, members = part.partition(":")
        if not found:
            raise ValueError(f"no colon in group {part!r}")
        rows += [(name.strip(), m.strip()) for m in members.split(",") if m.strip()]
    return spark.createDataFrame(rows, "group string, participant string")


def group_file(spark: SparkSession, path: str) -> DataFrame:
    """(group, participant) from a JSON object of lists, or a CSV with participant_id, text_id or id and group."""
    if path.endswith(".json"):
        listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("group", "members"))
        return listed.select("group", F.explode("members").alias("participant"))
    raw = csv(spark, path)
    key = next(c for c in ("participant_id", "text_id", "id") if c in raw.columns)
    return raw.select("group", F.col(key).alias("participant")).where("group is not null and participant is not null")


def seed_entities(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, parse_list(F.col(column)))


def figurative_instances(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    kinds = {"window_index": "int", "confidence": "double", "context_dependent": "boolean", "start_char": "int", "end_char": "int", "support_count": "int"}
    typed = raw.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in raw.columns})
    return typed.withColumn("supporting_window_indices", F.from_json("supporting_window_indices", "array<int>")) if "supporting_window_indices" in raw.columns else typed


def conditions(spark: SparkSession, pattern: str, names: Sequence[str]) -> DataFrame:
    """Score files of all conditions, one directory each named value_value..: their columns and the condition's parts."""
    rows = csv(spark, pattern).withColumn("_parts", F.split(F.element_at(F.split(F.input_file_name(), "/"), -2), "_"))
    return rows.withColumns({n: F.get("_parts", F.lit(i)) for i, n in enumerate(names)}).drop("_parts")


def metadata(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
