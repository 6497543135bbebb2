"""Records that differ only in how they are written.

A record is any value Spark can nest. Its digest is built bottom-up: leaves are written in one way and hashed (strings as their words, other
values exactly),
each inner node hashes its children's digests, sorted first where the order of the children carries no meaning (fields
of a struct, entries of a map, arrays declared as unordered). Equal records have equal root digests. As different ones
may too, groups are formed by the digest together with the whole canonical structure, which settles every collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import term
from textloom.operators.keyed import join_groups


def _leaf(value: Column, kind: T.DataType) -> Column:
    """A leaf in the one way its value is written. A string is its words; a value of another type is a mark of its kind and
    the value itself: 1.50 and 1.5 are one number, -1 and 1 aren't, and 15 isn't the string "15". Null is ''."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.coalesce(term(value), F.lit(""))
    if isinstance(kind, T.IntegralType):
        text = F.concat(F.lit("#"), value.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    elif isinstance(kind, T.FractionalType):
        text = F.concat(F.lit("#"), F.regexp_replace(F.when(value == 0, "0").otherwise(value.cast("string")), r"\.0$", ""))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit("@"), F.unix_micros(value).cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("!"), F.hex(value))
    else:
        text = F.concat(F.lit("@" if isinstance(kind, (T.DateType, T.TimestampNTZType)) else "?"), value.cast("string"))
    return F.coalesce(text, F.lit(""))


def merkle_digest(value: Column, kind: T.DataType, ordered_arrays: bool = True) -> Column:
    """64-bit root digest of a nested value. Null leaves count as leaves without words, null nodes as empty ones."""
    if isinstance(kind, T.StructType):
        children = [F.xxhash64(F.lit(f.name.lower()), merkle_digest(value[f.name], f.dataType, ordered_arrays)) for f in kind]
        return F.xxhash64(F.lit("struct"), F.array_sort(F.array(*children)))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.xxhash64(_leaf(e["key"], kind.keyType), merkle_digest(e["value"], kind.valueType, ordered_arrays)),
        )
        return F.xxhash64(F.lit("map"), F.array_sort(F.coalesce(entries, F.array().cast("array<bigint>"))))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: merkle_digest(x, kind.elementType, ordered_arrays))
        items = F.coalesce(items, F.array().cast("array<bigint>"))
        return F.xxhash64(F.lit("array"), items if ordered_arrays else F.array_sort(items))
    return F.xxhash64(_leaf(value, kind))


def canonical_form(value: Column, kind: T.DataType, ordered_arrays: bool = True) -> Column:
    """The structure the digest stands for, as a string: equal exactly where all normalised leaves and nodes are equal."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind, key=lambda f: f.name.lower())
        parts = [p for f in fields for p in (F.lit(f"{f.name.lower()}="), canonical_form(value[f.name], f.dataType, ordered_arrays), F.lit(";"))]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.concat(_leaf(e["key"], kind.keyType), F.lit("="), canonical_form(e["value"], kind.valueType, ordered_arrays)),
        )
        return F.concat(F.lit("{"), F.array_join(F.array_sort(F.coalesce(entries, F.array().cast("array<string>"))), ";"), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: canonical_form(x, kind.elementType, ordered_arrays))
        items = F.coalesce(items, F.array().cast("array<string>"))
        return F.concat(F.lit("["), F.array_join(items if ordered_arrays else F.array_sort(items), ";"), F.lit("]"))
    return _leaf(value, kind)


def fingerprint_records(records: DataFrame, id_col: str, fields: list[str], ordered_arrays: bool = True) -> DataFrame:
    """(record_id, digest, canonical) of every record; other columns are left behind before any shuffle."""
    record = F.struct(*fields)
    kind = T.StructType([records.schema[f] for f in fields])
    return records.select(
        F.col(id_col).alias("record_id"),
        merkle_digest(record, kind, ordered_arrays).alias("digest"),
        canonical_form(record, kind, ordered_arrays).alias("canonical"),
    )


def collapse(fingerprints: DataFrame) -> DataFrame:
    """One row per distinct record: (digest, canonical, keep_id, copies). Aggregated map-side, so one record that makes
    up a third of the input arrives as one row per task. Ties don't exist: the lowest id is kept; rows repeated under
    one id count as copies. An empty input gives an empty result."""
    return fingerprints.groupBy("digest", "canonical").agg(
        F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )


def copies_of(fingerprints: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of each record that isn't its group's lowest id. The join condition compares digest and whole
    structure; a hot group's rows are split over tasks."""
    groups = collapse(fingerprints).where("copies > 1").select("digest", "canonical", "keep_id")
    joined = join_groups(fingerprints, groups, ["digest", "canonical"])
    return joined.where("record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))
