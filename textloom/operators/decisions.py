"""Decisions and their factors: validity, deduplication, aggregation, tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.rules import is_decision, is_factor, strip_causes, trimmed

POLARITIES = ["supporting", "opposing", "neutral"]


def clean_decisions(rows: DataFrame, text: str = "decision") -> DataFrame:
    """Causal clauses stripped, invalid decisions dropped; original_decision keeps the text as extracted."""
    stripped = rows.withColumns({"original_decision": F.col(text), text: strip_causes(F.col(text))})
    return stripped.where(is_decision(F.col(text)))


def exact_unique(rows: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """The first row of texts equal but for case and outer blanks, per key."""
    first = rows.groupBy(*keys, F.lower(trimmed(F.col(text))).alias("_t")).agg(F.min_by(F.struct(*rows.columns), F.col(seq)).alias("x"))
    return first.select("x.*")


def clean_factors(rows: DataFrame) -> DataFrame:
    """Valid factors of their decisions; an unknown or missing polarity is neutral."""
    low = F.lower(trimmed(F.col("polarity")))
    return rows.where(is_factor(F.col("factor"), F.col("decision"))).withColumn("polarity", F.when(low.isin(POLARITIES), low).otherwise("neutral"))


def attach_factors(decisions: DataFrame, factors: DataFrame) -> DataFrame:
    """Factors of the decisions of the same text with the same words, whatever the case."""
    f = factors.withColumn("_k", F.lower(trimmed(F.col("decision_text")))).drop("decision_text")
    return decisions.withColumn("_k", F.lower(trimmed(F.col("decision")))).join(f, ["text_id", "_k"]).drop("_k")


def decision_rows(decisions: DataFrame, factors: DataFrame) -> DataFrame:
    """One row per decision: number of factors in all and by polarity. factors: text_id, decision, polarity."""
    counts = factors.groupBy("text_id", "decision").agg(F.count(F.lit(1)).alias("factor_count"), *[F.count_if(F.col("polarity") == p).alias(f"{p}_count") for p in POLARITIES])
    names = ["factor_count", *[f"{p}_count" for p in POLARITIES]]
    return decisions.join(counts, ["text_id", "decision"], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def totals(results: DataFrame, decisions: DataFrame, factors: DataFrame) -> DataFrame:
    """One row: texts, decisions, factors, and both per text (2 places); texts without decisions count, at least one."""
    r, d, f = (x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((results, "texts"), (decisions, "decisions"), (factors, "factors")))
    n = F.greatest("texts", F.lit(1))
    return r.join(d).join(f).withColumns({"decisions_per_text": F.round(F.col("decisions") / n, 2), "factors_per_decision": F.round(F.col("factors") / F.greatest("decisions", F.lit(1)), 2)})


def frequencies(rows: DataFrame, text: str) -> DataFrame:
    """(text, count, texts): by the exact text."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("text_id").alias("texts"))


def top(rows: DataFrame, by: str, name: str, n: int) -> DataFrame:
    """The n most frequent rows, names ascending on ties."""
    return rows.orderBy(F.desc(by), name).limit(n)


def polarity_table(factors: DataFrame, by: str = "decision") -> DataFrame:
    """One row per decision and a column per polarity."""
    return factors.groupBy(by).pivot("polarity", POLARITIES).agg(F.count(F.lit(1))).fillna(0, subset=POLARITIES)


def fallback_summary(windows: DataFrame, text: str = "window_text") -> DataFrame:
    """Summary and bullet points of windows without an annotator's: the text up to its first ". ", and its first three
    pieces of at most 80 characters."""
    pieces = F.split(F.col(text), r"\. ")
    bullets = F.filter(F.transform(F.slice(pieces, 1, 3), lambda x: F.substring(trimmed(x), 1, 80)), lambda x: x != "")
    return windows.withColumns({"summary": trimmed(F.get(pieces, F.lit(0))), "bullet_points": bullets})
