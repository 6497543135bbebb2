"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.json_text import json_field, json_object, json_strings
from textloom.functions.text import has_words, term
from textloom.llm import contamination, cooccurrence, packing, splitting, term_frequency
from textloom.llm.formatting_duplicates import collapse, copies_of, fingerprint_records
from textloom.llm.subjects import subject_areas
from textloom.llm.survivors import Field, learn_precedences, survivors
from textloom.sources.tables import table

NAMES = ["source", "target", "type"]


def _relationship_records(spark: SparkSession, folder: str) -> DataFrame:
    loaded = table(spark, folder, "relationships").select("rel_id", *NAMES)
    entries = table(spark, folder, "relationship_raw").select("rel_id", json_object(F.col("payload")).alias("entries"))
    replies = entries.where("entries is not null").select("rel_id", *[json_field(F.col("entries"), n).alias(n) for n in NAMES])
    named = loaded.unionByName(replies)
    for n in NAMES:
        named = named.where(has_words(F.col(n)))
    return fingerprint_records(named, "rel_id", NAMES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies_of(_relationship_records(spark, folder))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    return collapse(_relationship_records(spark, folder)).select("keep_id", "copies")


STATUS = ["exact", "normalized_exact", "approximate", "ambiguous", "missing"]


def _instances(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").where("instance_text is not null and type is not null").select(
        "instance_id", "text_id", term(F.col("type")).alias("type_term"), term(F.col("instance_text")).alias("text_term"),
        "instance_text", "confidence", "support_count", "alignment_status", "detected_at",
    )
    return rows.withColumn("status", F.lower(F.trim("alignment_status")))


def _trust() -> list:
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    rank = F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(STATUS) + 1)
    usable = _usable_confidence()
    confidence = F.when(usable, -F.col("confidence")).otherwise(F.lit(1.0))
    latest = F.coalesce(-F.unix_micros("detected_at"), F.lit(2**63 - 1))
    return [rank, confidence, latest]


def _usable_confidence():
    return F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))


def _written(text):
    """How a text is written: its case, and whether more than words and single blanks make it up."""
    case = F.when(~text.rlike(r"\p{Lu}"), "lower").when(~text.rlike(r"\p{Ll}"), "upper").when(text.rlike(r"^\P{L}*\p{L}[^\p{Lu}]*$"), "first").otherwise("mixed")
    edges = F.when(text.rlike(r"^[\p{L}\p{Nd}]") & text.rlike(r"[\p{L}\p{Nd}]$"), "bare").otherwise("marked")
    inside = F.when(text.rlike(r"[\p{L}\p{Nd}](?: [^\p{L}\p{Nd}]|[^\p{L}\p{Nd} ])[^\p{L}\p{Nd}]*[\p{L}\p{Nd}]"), "spaced").otherwise("plain")
    return F.concat_ws(" ", case, edges, inside)


def _fields() -> list[Field]:
    return [
        Field("instance_text", F.col("instance_text"), F.col("instance_text").isNotNull(), _written(F.col("instance_text"))),
        Field("confidence", F.col("confidence"), _usable_confidence(), F.floor(F.col("confidence") * 10)),
        Field("support_count", F.col("support_count"), F.col("support_count") >= 1, F.least("support_count", F.lit(10))),
        Field("alignment_status", F.col("alignment_status"), F.col("status").isin(STATUS), F.col("status")),
    ]


GROUP = ["text_id", "type_term", "text_term"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stated order comes first and ends in the id, so it is total: currency would be left nothing to decide, and isn't
    reasoned about here but in p2_survivors."""
    best = survivors(_instances(spark, folder), GROUP, "instance_id", [*_trust(), F.col("instance_id")], _fields())
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.col(f"{f.name}_from").alias("instance_id")) for f in _fields()]))
    return best.select("group_id", each.alias("x")).select("group_id", "x.field_name", "x.instance_id").where("instance_id is not null")


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Whole survivors: where times are missing, each field has one of its topologically latest states."""
    rows = _instances(spark, folder)
    learned = learn_precedences(rows, GROUP, _fields(), "detected_at")
    best = survivors(rows, GROUP, "instance_id", _trust(), _fields(), "detected_at", learned, trust_first=False)
    return best.drop("type_term", "text_term").withColumn("alignment_status", F.lower(F.trim("alignment_status")))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    texts = splitting.split_items(table(spark, folder, "relationships_sample"), "id", "text")
    windows = splitting.split_items(table(spark, folder, "rel_windows"), "window_id", "window_text")
    return texts.withColumn("item_table", F.lit("relationships_sample")).unionByName(windows.withColumn("item_table", F.lit("rel_windows")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece = 0").select("item_table", "item_key", "boundary")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p3_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item add up to without their overlaps, and whether all keep the limit."""
    new = F.sum(F.length("text") - F.col("overlap")).alias("characters")
    return _pieces(spark, folder).groupBy("item_table", "item_key").agg(new, F.bool_and((F.length("text") <= 1200) & (F.col("overlap") <= 120)).alias("within"))


def _marked_terms(spark: SparkSession, folder: str) -> DataFrame:
    relations, detections = table(spark, folder, "relationships"), table(spark, folder, "entity_detections")
    single = term_frequency.occurrences(relations, "relationship_type", F.array(term(F.col("type")))).unionByName(
        term_frequency.occurrences(detections, "entity", F.transform("entities", term))
    )
    size = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit(name).alias("field_name"), "table_rows")
    rows = size(relations, "relationship_type").unionByName(size(detections, "entity"))
    return term_frequency.mark_terms(term_frequency.count_terms(single), rows)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked_terms(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _marked_terms(spark, folder).select("field_name", "term", "occurrences", "records", "mark")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    summary = table(spark, folder, "relationships_sample_relationships_summary")
    listed = cooccurrence.baskets(summary, "summary", F.transform(json_strings(F.col("entities_json")), term))
    detected = cooccurrence.baskets(table(spark, folder, "entity_detections"), "detection", F.transform("entities", term))
    return cooccurrence.item_pairs(listed.unionByName(detected))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("list_name", "item_a", "item_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("list_name", "item_a", "item_b", "together", "records_a", "records_b", F.round("lift", 6).alias("lift"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    counted = packing.token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(counted).withColumnRenamed("item", "doc_id")


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a place: all with a token, each once unless it is cut."""
    placed = p6_containers(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("places"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"))
    return placed.select("doc_id", ((F.col("places") == F.col("last") + 1) & ((F.col("places") == 1) | (F.col("tokens") > 2048))).alias("whole"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("same").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per document and item: the pairs of places from which 12 words are the same."""
    runs = _leaks(spark, folder).where("size = 12 and same")
    return runs.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("runs"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document and item: runs of 12 words that leaked as they are, and how similar the closest passage of the item's
    whole size is, if it is similar at all."""
    leaks = _leaks(spark, folder)
    return leaks.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.count_if((F.col("size") == 12) & F.col("same")).alias("same_runs"), F.round(F.max(F.when(F.col("size") > 12, F.col("similarity"))), 6).alias("whole"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    subjects = [r.subject for r in table(spark, folder, "subjects").select("subject").distinct().orderBy("subject").collect()]
    areas = subject_areas(
        table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "subject_labels"), table(spark, folder, "eval_items"), "text", subjects
    )
    return areas.withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the corpus is about each subject; a document of several counts for each of them."""
    areas = p8_found(spark, folder)
    documents = table(spark, folder, "documents").where(F.col("text").rlike(r"\S")).agg(F.count_distinct("doc_id").alias("documents"))
    counts = areas.groupBy("subject").agg(F.count(F.lit(1)).alias("about"))
    return counts.join(F.broadcast(documents)).select("subject", "about", (F.col("about") / F.col("documents")).alias("share"))


def queries() -> dict:
    found = [p1_found, p1_records, p2_found, p2_survivors, p3_found, p3_pieces, p3_lengths, p4_found, p4_terms, p5_found, p5_pairs, p6_containers, p6_documents, p7_found, p7_runs, p7_leaks, p8_found, p8_shares]
    return {f.__name__: f for f in found}
