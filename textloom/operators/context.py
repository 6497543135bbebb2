"""What an annotator is told besides the window: earlier summaries, carried entities, context sentences."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.rules import trimmed
from textloom.functions.windowing import sentences


def prior_summaries(rows: DataFrame, key: str, order: str, value: str, n: int = 5, include_current: bool = False, name: str = "prior") -> DataFrame:
    """Add the last n values of the same text as an array, oldest first, up to the row before or the row itself."""
    frame = (-(n - 1), 0) if include_current else (-n, -1)
    listed = F.collect_list(F.struct(order, value)).over(Window.partitionBy(key).orderBy(order).rowsBetween(*frame))
    return rows.withColumn(name, F.transform(listed, lambda x: x[value]))


def context_points(rows: DataFrame, key: str, order: str, points: str, each: int = 3, last: int = 10) -> DataFrame:
    """Add the last `last` points of earlier windows, at most `each` of a window."""
    before = F.collect_list(F.struct(F.col(order), F.slice(points, 1, each).alias("p"))).over(Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1))
    flat = F.flatten(F.transform(before, lambda x: x["p"]))
    return rows.withColumn("context_points", F.when(F.size(flat) > last, F.slice(flat, F.size(flat) - last + 1, last)).otherwise(flat))


def merge_entities(parts: list[list[str]]) -> list[str]:
    """Entities of all parts in order, each in its first spelling whatever the case; blank ones are left out."""
    seen: dict[str, str] = {}
    for part in parts:
        for e in part:
            if e and e.strip():
                seen.setdefault(e.strip().lower(), e.strip())
    return list(seen.values())


def carry_entities(rows: DataFrame, key: str, order: str, entities: str, n: int = 5) -> DataFrame:
    """Add `carried`: what earlier windows of the text hand on. A window's own and carried entities, merged, count as its
    entities for the next windows, so the carry is recursive: a text's windows run in order in one task."""
    schema = f"{rows.drop('carried').schema.simpleString()[7:-1]},carried:array<string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        held: list[list[str]] = []
        carried = []
        for own in pdf[entities]:
            before = merge_entities(held)
            carried.append(before)
            held = [*held, merge_entities([list(own) if own is not None else [], before])][-n:]
        return pdf.assign(carried=carried)

    return rows.groupBy(key).applyInPandas(run, schema.replace(":", " "))


def sentence_with(text: Column, entity: Column) -> Column:
    """The first sentence that contains the entity, whatever the case; else the whole text."""
    found = F.filter(sentences(text), lambda s: F.contains(F.lower(s), F.lower(entity)))
    return F.coalesce(F.get(found, F.lit(0)), text)


def entity_contexts(windows: DataFrame, mode: str = "window", max_length: int = 500, separator: str = " [...] ") -> DataFrame:
    """One row per text and entity (whatever its case): entity in its first spelling, context by mode. window: the first
    window; sentence: the sentence with it in the first window; combined: its distinct windows joined. Cut to max_length.
    windows: text_id, window_index, window_text, entities (array)."""
    each = windows.select("text_id", "window_index", "window_text", F.posexplode("entities").alias("at", "raw")).withColumn("entity", trimmed(F.col("raw"))).where("entity <> ''")
    place = F.struct("window_index", "at")
    grouped = each.groupBy("text_id", F.lower("entity").alias("key")).agg(
        F.min_by("entity", place).alias("entity"), F.min("window_index").alias("window_index"), F.min_by("window_text", place).alias("first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("window_index", "window_text"))), lambda x: x["window_text"])).alias("all"),
    )
    context = {"window": F.col("first"), "sentence": sentence_with(F.col("first"), F.col("entity")), "combined": F.array_join("all", separator)}[mode]
    cut = F.when(F.length(context) > max_length, F.concat(F.substring(context, 1, max_length - 3), F.lit("..."))).otherwise(context)
    return grouped.select("text_id", "entity", cut.alias("context"), "window_index")


def filter_by_nodes(contexts: DataFrame, nodes: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Contexts whose entity is a node of at least the frequency, found in the text or in no stated text. nodes: id, frequency,
    source_text_ids (array)."""
    kept = nodes.where(F.col("frequency") >= min_frequency)
    listed = kept.select(F.lower("id").alias("key"), "source_text_ids")
    inside = (F.size("source_text_ids") == 0) | F.col("source_text_ids").isNull() | F.array_contains("source_text_ids", F.col("text_id"))
    keyed = contexts.withColumn("key", F.lower("entity"))
    return keyed.join(listed, (keyed.key == listed.key) & inside, "left_semi").drop("key")


def resume(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no earlier run has finished."""
    return rows.join(done.select(*keys), keys, "left_anti")


def parse_list(raw: Column) -> Column:
    """array<string> from a JSON list, else a list with semicolons, else with commas; blanks dropped."""
    as_json = F.when(trimmed(raw).startswith("["), F.from_json(raw, "array<string>"))
    parts = F.when(raw.contains(";"), F.split(raw, ";")).otherwise(F.split(raw, ","))
    return F.filter(F.transform(F.coalesce(as_json, parts), trimmed), lambda x: x.isNotNull() & (x != ""))


