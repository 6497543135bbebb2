"""Sentence splitting and sliding windows over sentences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(value: Column) -> Column:
    """Remove white space at both ends, as Unicode has it and not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? followed by white space; pieces are stripped and blank ones dropped. Null gives null."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def windows(text: Column, units: Column, size: int, stride: int) -> Column:
    """array<string> of windows of `size` units, every `stride` units.

    A blank text has none; a text of at most `size` units is one window, unchanged. If the last regular window doesn't
    reach the end, the last `size` units form one more, unless it reads the same as the one before. Null gives none.
    """
    n = F.size(units)
    regular = F.transform(F.sequence(F.lit(0), n - size, F.lit(stride)), lambda i: F.array_join(F.slice(units, i + 1, size), " "))
    tail = F.array_join(F.slice(units, n - size + 1, size), " ")
    reached = (n - size) % stride == 0
    many = F.when(reached | (F.element_at(regular, -1) == tail), regular).otherwise(F.concat(regular, F.array(tail)))
    none = F.array().cast("array<string>")
    blank = text.isNull() | ~text.rlike(r"(?U)\S")
    return F.when(blank, none).when(n <= size, F.array(text)).otherwise(many)


def explode_windows(texts: DataFrame, key: str, text: str, size: int = 3, stride: int = 2) -> DataFrame:
    """(key, window_index, window_text) of every text; narrow. Texts without windows give no rows."""
    units = texts.select(F.col(key), F.col(text).alias("_text"), sentences(F.col(text)).alias("_units"))
    return units.select(key, F.posexplode(windows(F.col("_text"), F.col("_units"), size, stride)).alias("window_index", "window_text"))
