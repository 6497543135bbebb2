"""Relationships: mapping to canonical names, merging, graphs of nodes and edges, causal and verification statistics.

A relationship row has source, target, type, description, text_id, window_index and `seq`, a total order of rows that stands
for "first seen". All groupings combine map-side; collected lists are bounded where the semantics bound them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.rules import trimmed
from textloom.operators.keyed import join_groups

CAUSAL = {"polarity": "neutral", "certainty": "possible", "explicit_vs_implicit": "implicit"}


def apply_mapping(rows: DataFrame, column: str, mapping: DataFrame, into: str | None = None) -> DataFrame:
    """Replace a label by its canonical form; labels the mapping (raw, canonical) lacks stay as they are."""
    known = mapping.select(F.col("raw").alias(column), F.col("canonical").alias("_canonical"))
    mapped = join_groups(rows, known, [column], "left")
    return mapped.withColumn(into or column, F.coalesce("_canonical", column)).drop("_canonical")


def label_counts(rows: DataFrame) -> DataFrame:
    """(kind, label, count): entities as source or target, and types."""
    label = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("label"))
    each = rows.select(F.inline(F.array(label("entity", "source"), label("entity", "target"), label("type", "type"))))
    return each.where("label is not null").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("count"))


def _first(value: Column, seq: str = "seq") -> Column:
    return F.min_by(value, F.col(seq))


def ordered_distinct(value: Column, seq: Column, most: int | None = None) -> Column:
    """Aggregate: distinct values in order of first appearance."""
    firsts = F.array_sort(F.collect_set(F.struct(seq.alias("seq"), value.alias("value"))))
    values = F.array_distinct(F.transform(firsts, lambda x: x["value"]))
    return F.slice(values, 1, most) if most else values


def merge(rows: DataFrame, entities: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Merge relationships alike in canonical source, type and target, whatever their case.

    Labels are those of the first row. Descriptions come in order of appearance, window numbers, texts and original labels
    sorted, without repetition and blanks; count is the number of rows; confidence is the least of the first row's cluster
    similarities (1 without clusters). `entities` and `types` are (raw, canonical, avg_similarity); a type overrides an
    entity of the same text in the lookup of similarities.
    """
    m = rows.select("seq", "text_id", "window_index", "description", F.col("source").alias("os"), F.col("target").alias("ot"), F.col("type").alias("oy"), "source", "target", "type")
    if entities is not None:
        m = apply_mapping(apply_mapping(m, "source", entities), "target", entities)
    if types is not None:
        m = apply_mapping(m, "type", types)
    similar = None
    for part in (types, entities):
        if part is not None:
            own = part.select("raw", F.col("avg_similarity").alias("similarity"))
            similar = own if similar is None else similar.unionByName(own.join(similar.select("raw"), "raw", "left_anti"))
    confidence = F.lit(1.0)
    if similar is not None:
        for side in ("os", "ot", "oy"):
            m = join_groups(m, similar.select(F.col("raw").alias(side), F.col("similarity").alias(f"sim_{side}")), [side], "left")
        confidence = F.least(*[F.coalesce(f"sim_{side}", F.lit(1.0)) for side in ("os", "ot", "oy")])
    key = [F.lower("source").alias("s"), F.lower("type").alias("y"), F.lower("target").alias("t")]
    said = m.where("description <> ''").groupBy(*key, "description").agg(F.min("seq").alias("seq"))
    listed = said.groupBy("s", "y", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"]).alias("descriptions"))
    grouped = m.withColumn("confidence", confidence).groupBy(*key).agg(
        _first(F.col("source")).alias("source"), _first(F.col("type")).alias("type"), _first(F.col("target")).alias("target"),
        F.array_join(F.array_sort(F.collect_set("os")), "; ").alias("original_source"),
        F.array_join(F.array_sort(F.collect_set("ot")), "; ").alias("original_target"),
        F.array_join(F.array_sort(F.collect_set("oy")), "; ").alias("original_type"),
        F.array_sort(F.collect_set("window_index")).alias("window_indices"),
        F.array_sort(F.collect_set(F.nullif("text_id", F.lit("")))).alias("text_ids"),
        F.count(F.lit(1)).alias("count"), F.round(_first(F.col("confidence")), 3).alias("confidence"), F.min("seq").alias("seq"),
    )
    whole = grouped.join(listed, ["s", "y", "t"], "left").withColumn("descriptions", F.coalesce("descriptions", F.array().cast("array<string>")))
    return whole.drop("s", "y", "t").withColumn("description", F.coalesce(F.get("descriptions", F.lit(0)), F.lit("")))


def graph_rows(rows: DataFrame) -> DataFrame:
    """Rows that make an edge: labels stripped, blank ones and self-loops (whatever the case) dropped."""
    s, t, y = (trimmed(F.col(c)) for c in ("source", "target", "type"))
    clean = rows.withColumns({"source": s, "target": t, "type": F.coalesce(y, F.lit(""))})
    ids = clean.withColumns({"source_id": F.lower("source"), "target_id": F.lower("target")})
    return ids.where("source <> '' and target <> '' and source_id <> target_id")


def nodes(rows: DataFrame) -> DataFrame:
    """id, label (first spelling), frequency, text_count, role (source, target, both) of each node. `rows` as graph_rows
    gives; an optional column `count` weighs a row."""
    weight = F.col("count") if "count" in rows.columns else F.lit(1)
    end = lambda side, order, as_source: F.struct(F.col(f"{side}_id").alias("id"), F.col(side).alias("label"), F.struct(F.col("seq"), F.lit(order).alias("end")).alias("place"), F.lit(as_source).alias("as_source"))
    ends = rows.select(F.explode(F.array(end("source", 0, True), end("target", 1, False))).alias("x"), weight.alias("w"), "text_id").select("x.*", "w", "text_id")
    role = F.when(F.bool_or("as_source") & F.bool_or(~F.col("as_source")), "both").when(F.bool_or("as_source"), "source").otherwise("target")
    return ends.groupBy("id").agg(
        F.min_by("label", "place").alias("label"), F.sum("w").alias("frequency"), F.count_distinct(F.nullif("text_id", F.lit(""))).alias("text_count"), role.alias("role"),
    )


def edges(rows: DataFrame) -> DataFrame:
    """source, target, type (first spelling), weight, text_count, and up to five distinct descriptions, first seen first."""
    weight = F.col("count") if "count" in rows.columns else F.lit(1)
    keyed = rows.withColumn("type_id", F.lower("type"))
    key = ["source_id", "target_id", "type_id"]
    described = keyed.where("description <> ''").groupBy(*key, "description").agg(F.min("seq").alias("at"))
    early = described.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("at", "description"))).where("n <= 5")
    evidence = early.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "description"))), lambda x: x["description"]).alias("evidence"))
    totals = keyed.groupBy(*key).agg(
        F.min_by("type", "seq").alias("type"), F.sum(weight).alias("weight"), F.count_distinct(F.nullif("text_id", F.lit(""))).alias("text_count"), F.min("seq").alias("seq"),
    )
    full = totals.join(evidence, key, "left")
    return full.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "weight", "text_count", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "seq")


def causal_majority(rows: DataFrame, attributes: Sequence[str] = tuple(CAUSAL)) -> DataFrame:
    """The most frequent value of each attribute per edge among causal rows; ties go to the value seen first."""
    key = ["source_id", "target_id", "type_id"]
    votes = rows.where("is_causal").withColumn("type_id", F.lower("type")).select(*key, "seq", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).alias("value")) for a in attributes])).alias("x"))
    counted = votes.select(*key, "seq", "x.*").where("value is not null").groupBy(*key, "name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = counted.groupBy(*key, "name").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    return best.groupBy(*key).pivot("name", list(attributes)).agg(F.first("value")).withColumn("is_causal", F.lit(True))


def labelled(node_rows: DataFrame, mode: str = "all") -> DataFrame:
    """(id, label) of the nodes a picture names: all, none, top:N by degree or pagerank:N; all for a mode it doesn't know. The
    lower id on ties."""
    if mode == "none":
        return node_rows.select("id", "label").limit(0)
    kind, _, count = mode.partition(":")
    measure = {"top": "degree", "pagerank": "pagerank"}.get(kind)
    if measure is None or not count.isdigit():
        return node_rows.select("id", "label")
    return node_rows.orderBy(F.desc(measure), "id").limit(int(count)).select("id", "label")


def filter_edges(edge_rows: DataFrame, min_weight: int = 1, types: Sequence[str] | None = None) -> DataFrame:
    kept = edge_rows.where(F.col("weight") >= min_weight)
    return kept.where(F.lower("type").isin([t.lower() for t in types])) if types else kept


def nodes_of(node_rows: DataFrame, edge_rows: DataFrame, isolated: bool = False) -> DataFrame:
    """Nodes that an edge touches; with `isolated` all of them."""
    if isolated:
        return node_rows
    touched = edge_rows.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return node_rows.join(touched, "id", "left_semi")


def scoped(rows: DataFrame, text_id: str | None = None) -> DataFrame:
    """Rows of one text, or of all texts each on its own when grouped by text_id besides."""
    return rows if text_id is None else rows.where(F.col("text_id") == text_id)


def valid_causal(rows: DataFrame) -> DataFrame:
    """Replies about causality made consistent: unknown values take defaults, rows that aren't causal lose all attributes."""
    allowed = {"polarity": ["positive", "negative", "neutral"], "certainty": ["certain", "probable", "possible"], "explicit_vs_implicit": ["explicit", "implicit"]}
    out = rows
    for name, values in allowed.items():
        low = F.lower(trimmed(F.col(name)))
        out = out.withColumn(name, F.when(F.col("is_causal"), F.when(low.isin(values), low).otherwise(CAUSAL[name])))
    return out


def causal_statistics(rows: DataFrame) -> DataFrame:
    """One row: total, causal, non_causal without errors, errors, non_causal_all (total - causal), causal_percentage (one
    decimal) and counts by polarity, unknown polarities as neutral. `rows`: is_causal, polarity, error."""
    causal = F.coalesce("is_causal", F.lit(False))
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    polarity = F.when(F.lower("polarity").isin("positive", "negative"), F.lower("polarity")).otherwise("neutral")
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(causal).alias("causal"), F.count_if(~causal & ~failed).alias("non_causal"), F.count_if(failed).alias("errors"),
        *[F.count_if(causal & (polarity == p)).alias(p) for p in ("positive", "negative", "neutral")],
    )
    share = F.when(F.col("total") > 0, F.round(100 * F.col("causal") / F.col("total"), 1)).otherwise(0.0)
    return counts.withColumns({"non_causal_all": F.col("total") - F.col("causal"), "causal_percentage": share})


def verification_statistics(rows: DataFrame) -> DataFrame:
    """One row: total, verified, rejected, rate (percent, one decimal), avg, min and max confidence (three decimals)."""
    c = F.col("verification_confidence")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"), F.round(F.avg(c), 3).alias("avg_confidence"), F.round(F.min(c), 3).alias("min_confidence"), F.round(F.max(c), 3).alias("max_confidence"))
    rate = F.when(F.col("total") > 0, F.round(100 * F.col("verified") / F.col("total"), 1)).otherwise(0.0)
    return counts.withColumns({"rejected": F.col("total") - F.col("verified"), "rate": rate})


def with_source_text(rows: DataFrame, windows: DataFrame, texts: DataFrame) -> DataFrame:
    """Add `source_text`: the row's window, else its whole text, else null. windows: (text_id, window_index, window_text);
    texts: (text_id, text); one row per key each."""
    by_window = join_groups(rows, windows.select("text_id", "window_index", "window_text"), ["text_id", "window_index"], "left")
    by_text = join_groups(by_window, texts.select("text_id", F.col("text").alias("_text")), ["text_id"], "left")
    return by_text.withColumn("source_text", F.coalesce(F.nullif("window_text", F.lit("")), F.nullif("_text", F.lit("")))).drop("window_text", "_text")


def last_per_key(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Lookup tables: the last row of each key wins."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x"))
    return best.select(*keys, "x.*")


def batches(rows: DataFrame, keys: Sequence[str], seq: str, size: int = 20) -> DataFrame:
    """Number the rows of each key and cut them into batches: column `batch`. For keys that hold very many rows the number
    runs within slices by hash (rank_within), so no task numbers them all."""
    from textloom.operators.keyed import rank_within

    keyed = rows.withColumn("_key", F.xxhash64(*keys))
    ranked = rank_within(keyed, "_key", [seq], "_n")
    return ranked.withColumn("batch", F.floor(F.col("_n") / size).cast("int")).drop("_key", "_n")


def verify_rows(rows: DataFrame, confidence_threshold: float = 0.5) -> DataFrame:
    """Judged rows (confidence, note, source_text) as verified or not; without a source text always not."""
    missing = F.col("source_text").isNull()
    confidence = F.when(missing, 0.0).otherwise(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumns({
        "verification_confidence": confidence,
        "verification_note": F.when(missing, "No source text available").otherwise(F.col("note")),
        "verified": ~missing & (confidence >= confidence_threshold),
    })
