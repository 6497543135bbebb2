"""Sinks: CSV with JSON in cells, graphs, run metadata, resumable results."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column orders of the files other tools read.
RELATIONSHIP_COLUMNS = "text_id, window_index, source, target, type, description"
MERGED_COLUMNS = "source, target, type, original_source, original_target, original_type, description, count, confidence, window_indices, text_ids"
CAUSAL_COLUMNS = "source, target, type, description, is_causal, polarity, certainty, explicit_vs_implicit, reasoning"
VERIFIED_COLUMNS = "source, target, type, description, verified, verification_confidence, verification_note, text_id, window_index"
INSTANCE_COLUMNS = (
    "text_id, window_index, window_text, instance_text, type, confidence, explanation, context_dependent, start_char, end_char, "
    "alignment_status, support_count, supporting_window_indices"
)
NODE_COLUMNS = "id, label, frequency, text_count, degree, in_degree, out_degree, betweenness, pagerank, source_text_ids, raw_entities"
EDGE_COLUMNS = "id, source, target, type, weight, text_count, evidence, source_text_ids, is_causal, polarity, certainty, explicit_vs_implicit"


def flat(rows: DataFrame, columns: str | Sequence[str] | None = None, joined: dict[str, str] | None = None) -> DataFrame:
    """Columns in order, nested ones as JSON, those in `joined` as lists with that separator; missing ones null."""
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns or rows.columns)
    kinds = {f.name: f.dataType for f in rows.schema}

    def cell(name: str):
        if name not in kinds:
            return F.lit(None).cast("string")
        if joined and name in joined:
            return F.array_join(name, joined[name])
        return F.to_json(name) if isinstance(kinds[name], (T.ArrayType, T.MapType, T.StructType)) else F.col(name)

    return rows.select(*[cell(n).alias(n) for n in names])


def write_csv(rows: DataFrame, path: str, columns: str | Sequence[str] | None = None, joined: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    flat(rows, columns, joined).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def gexf(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> str:
    """A graph as GEXF text. A file for a desktop tool, so the graph is collected behind a check of its size."""
    parts = []
    for rows, what in ((nodes, "node"), (edges, "edge")):
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"at most {most} {what}s")
        for i, r in enumerate(found):
            if what == "node":
                parts.append(f"<node id={quoteattr(str(r.id))} label={quoteattr(str(r.label))}/>")
            else:
                parts.append(f'<edge id="{i}" source={quoteattr(str(r.source))} target={quoteattr(str(r.target))} weight="{r.weight}" label={quoteattr(str(r.type))}/>')
    text = "".join(parts)
    cut = text.find("<edge ") if "<edge " in text else len(text)
    return f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>{text[:cut]}</nodes><edges>{text[cut:]}</edges></graph></gexf>'


def run_metadata(folder: str, step: str, arguments: dict, statistics: dict, outputs: dict, started: float, extra: dict | None = None) -> str:
    """Write run_metadata.json of a step: what ran, with what, how long; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path, ended = os.path.join(folder, "run_metadata.json"), time.time()
    stamp = lambda t: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(t))
    body = {"step": step, "arguments": arguments, "statistics": statistics, "outputs": outputs, "start_time": stamp(started), "end_time": stamp(ended), "duration_seconds": round(ended - started, 2)} | (extra or {})
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, default=str)
    return path


def nested_folder(source: str, step: str, folder: str | None = None) -> str:
    """Where a step writes: the folder asked for, else a folder of the step inside the run_* folder its input lies in, else
    beside the input."""
    if folder:
        return folder
    at = os.path.dirname(os.path.abspath(source))
    while at != os.path.dirname(at):
        if os.path.basename(at).startswith("run_"):
            return os.path.join(at, step)
        at = os.path.dirname(at)
    return os.path.join(os.path.dirname(os.path.abspath(source)), step)


class Results:
    """Results that a later run takes up: appended in files, read back without broken lines, removed when done."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def load(self) -> DataFrame:
        """What earlier runs finished; lines that can't be read are skipped."""
        empty = self.spark.createDataFrame([], self.schema)
        try:
            found = self.spark.read.schema(self.schema).json(self.path, mode="DROPMALFORMED")
            return found.dropna(subset=self.keys).dropDuplicates(self.keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return empty
            raise

    def remaining(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.load().select(*self.keys), self.keys, "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.path)
