"""The pathways end to end: figurative, relationships, entity, decisions. Each step is a function from DataFrames to
DataFrames; a provider answers what rules can't. Filters stand ahead of the provider, as they aren't pushed through it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.rules import ENTITY_THRESHOLDS, threshold, trimmed
from textloom.functions.windowing import explode_windows
from textloom.operators import agreement as A
from textloom.operators import clustering as K
from textloom.operators import comparison as C
from textloom.operators import context as X
from textloom.operators import decisions as D
from textloom.operators import figurative as G
from textloom.operators import graphs as N
from textloom.operators import layouts as Y
from textloom.operators import providers as P
from textloom.operators import relationships as R
from textloom.operators import scores as S
from textloom.operators import similarity as M
from textloom.plans.storage import materialise


def windows_of(texts: DataFrame, size: int | None = 3, stride: int = 2) -> DataFrame:
    """text_id, window_index, window_text; size None: each non-blank text is one window."""
    if size is None:
        return texts.where(trimmed(F.col("text")) != "").select("text_id", F.lit(0).alias("window_index"), F.col("text").alias("window_text"))
    return explode_windows(texts, "text_id", "text", size, stride)


def summarised(windows: DataFrame, provider: P.Provider) -> DataFrame:
    """Add `summary`: the reply's points joined, else its summary, else the reply itself, else the window's first sentence."""
    replied = P.parse(P.annotate(windows, P.prompt("summary", F.col("window_text")), provider), "summary")
    points = F.when(F.size("parsed.summary_points") > 0, F.array_join("parsed.summary_points", "; "))
    fallback = F.get(F.split("window_text", r"\. "), F.lit(0))
    return replied.withColumn("summary", F.coalesce(points, F.col("parsed.summary"), F.nullif("reply", F.lit("")), fallback)).drop("reply", "error", "parsed", "parse_failed")


def resolved(texts: DataFrame, provider: P.Provider) -> DataFrame:
    """texts with pronouns replaced as the provider says."""
    asked = P.parse(P.annotate(texts, P.prompt("coreference", F.col("text")), provider), "coreference")
    new = F.coalesce(F.nullif(trimmed(F.col("parsed.resolved_text")), F.lit("")), F.col("text"))
    return asked.withColumn("text", new).drop("reply", "error", "parsed", "parse_failed")


def named_clusters(clusters: DataFrame, counts: DataFrame, provider: P.Provider, most: int = 10) -> DataFrame:
    """(raw, canonical, avg_similarity) with the label the provider gives each cluster, told its `most` most frequent labels;
    the most frequent one where no label comes back. Clusters of one label aren't asked."""
    ranked = clusters.join(counts.select("label", "count"), "label", "left").withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "label")))
    listed = ranked.where(F.col("_n") <= most).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_n", "label"))).alias("x"))
    told = listed.select("cluster", F.col("x.label").alias("labels"))
    asked = P.parse(P.annotate(told.where("size(labels) > 1"), P.prompt("name", F.array_join("labels", "\n")), provider), "name")
    names = asked.select("cluster", F.coalesce(F.nullif(trimmed(F.col("parsed.label")), F.lit("")), F.get("labels", F.lit(0))).alias("canonical"))
    names = names.unionByName(told.where("size(labels) = 1").select("cluster", F.get("labels", F.lit(0)).alias("canonical")))
    return clusters.join(names, "cluster").select(F.col("label").alias("raw"), "canonical", "avg_similarity")


@dataclass(frozen=True)
class Figurative:
    size: int = 3
    stride: int = 2
    threshold: float = 0.5
    context: int = 5
    types: Sequence[str] | None = None


def figurative_detect(texts: DataFrame, provider: P.Provider, config: Figurative = Figurative(), done: DataFrame | None = None) -> dict[str, DataFrame]:
    """windows, instances, summary. Each window is judged with the summaries of up to `context` earlier ones; instances are
    kept where the window is figurative at the threshold, aligned and merged over overlapping windows."""
    todo = X.resume(texts, done, ["text_id"]) if done is not None else texts
    told = X.prior_summaries(materialise(summarised(windows_of(todo, config.size, config.stride), provider)), "text_id", "window_index", "summary", config.context)
    judged = P.parse(P.annotate(told, P.prompt("figurative", F.col("window_text"), F.col("prior")), provider), "figurative")
    judged = materialise(judged.withColumns({"has_figurative": F.coalesce("parsed.has_figurative", F.lit(False)), "confidence": F.coalesce("parsed.confidence", F.lit(0.0))}))
    kept = judged.where(F.col("has_figurative") & (F.col("confidence") >= config.threshold))
    each = kept.select("text_id", "window_index", "window_text", F.inline("parsed.instances")).withColumnRenamed("text", "instance_text")
    instances = G.canonicalise(G.align(G.valid_instances(each, config.types)), config.size, config.stride)
    windows = judged.select("text_id", "window_index", "window_text", "has_figurative", "confidence", F.coalesce(F.size("parsed.instances"), F.lit(0)).alias("instances_count"), "summary", "error", "parse_failed")
    return {"windows": windows, "instances": instances, "summary": G.detection_summary(todo, instances)}


def figurative_map(instances: DataFrame, provider: P.Provider, level: str = "moderate") -> DataFrame:
    """Add source_domain, target_domain, domain_confidence, error. A reply may give a domain as a word or by levels."""
    asked = P.annotate(instances, P.prompt("domains", F.concat_ws("\n", "instance_text", "window_text")), provider)
    from textloom.functions.rules import object_text

    members = F.from_json(object_text(F.col("reply")), "map<string,string>")
    word = lambda k: F.try_element_at(members, F.lit(k))
    domain = lambda k: F.coalesce(F.get_json_object(word(k), f"$.{level}"), F.when(~word(k).startswith("{"), word(k)), F.lit(""))
    out = asked.withColumns({"source_domain": domain("source_domain"), "target_domain": domain("target_domain"), "domain_confidence": G.domain_confidence(word("confidence"))})
    return out.drop("reply")


def figurative_normalise(instances: DataFrame, given: str | float = "moderate", together: bool = False, method: str = "frequent") -> DataFrame:
    """(kind, raw, canonical, avg_similarity): domains of one kind, or of both together, clustered by similarity."""
    counts = materialise(G.domain_counts(instances))
    t, parts = threshold(given), []
    for kind in ["source", "target"] if not together else ["both"]:
        own = counts.where(F.col("kind") == kind) if not together else counts
        own = own.groupBy("label").agg(F.sum("count").alias("count"))
        pairs = materialise(M.similar_pairs(M.embed(own), t))
        parts.append(M.canonical(M.cluster(own, pairs, t), own, method, pairs, upper=True).withColumn("kind", F.lit(kind)))
    return parts[0] if together else parts[0].unionByName(parts[1])


def figurative_graph(instances: DataFrame, mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges of domains, named by the mapping where there is one."""
    rows = instances
    for kind in ("source", "target"):
        if mapping is not None:
            rows = R.apply_mapping(rows, f"{kind}_domain", mapping.where(F.col("kind").isin(kind, "both")).select("raw", "canonical"))
    return {"nodes": G.domain_nodes(rows), "edges": G.domain_edges(rows)}


def figurative_pipeline(instances: DataFrame, provider: P.Provider) -> dict[str, DataFrame]:
    mapped = materialise(figurative_map(instances, provider))
    mapping = materialise(figurative_normalise(mapped))
    return {"mapped": mapped, "mapping": mapping} | figurative_graph(mapped, mapping)


def relationships_detect(texts: DataFrame, provider: P.Provider, size: int = 3, stride: int = 2, carry: int = 5, two_pass: bool = True, coreference: bool = False) -> dict[str, DataFrame]:
    """windows, edges, summary. In two passes entities are found first and carried over windows, and relationships are asked
    for with them; in one, relationships alone are. With `coreference` a text is rewritten ahead of windowing; where no
    rewriting comes back it stays as it is."""
    if coreference:
        texts = materialise(resolved(texts, provider))
    windows = windows_of(texts, size, stride)
    context = F.array().cast("array<string>")
    if two_pass:
        found = P.parse(P.annotate(windows, P.prompt("entities", F.col("window_text")), provider), "entities")
        names = F.filter(F.transform(F.coalesce("parsed.entities", context), trimmed), lambda x: x != "")
        windows = X.carry_entities(found.select("text_id", "window_index", "window_text", names.alias("entities")), "text_id", "window_index", "entities", carry)
        context = F.concat("entities", "carried")
    asked = materialise(P.parse(P.annotate(windows, P.prompt("relationships", F.col("window_text"), context), provider), "relationships"))
    each = asked.select("text_id", "window_index", F.inline("parsed.relationships")).withColumns({c: trimmed(F.col(c)) for c in ("source", "target", "type")})
    edges = each.where("source <> '' and target <> '' and type <> ''")
    names = edges.select("text_id", F.explode(F.array("source", "target")).alias("entity"), "window_index")
    unique = names.groupBy("text_id", F.lower("entity").alias("_k")).agg(F.min_by("entity", "window_index").alias("entity"))
    per = unique.groupBy("text_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    counts = edges.groupBy("text_id").agg(F.count(F.lit(1)).alias("relationship_count")).join(per, "text_id")
    sizes = asked.groupBy("text_id").agg(F.count(F.lit(1)).alias("window_count"), F.count("error").alias("errors"))
    summary = texts.select("text_id").join(counts, "text_id", "left").join(sizes, "text_id", "left")
    return {"windows": asked.drop("reply", "parsed"), "edges": edges, "summary": summary.fillna(0, ["relationship_count", "window_count", "errors"])}


def relationships_verify(rows: DataFrame, windows: DataFrame, texts: DataFrame, provider: P.Provider, confidence_threshold: float | None = None, batch_size: int = 20) -> dict[str, DataFrame]:
    """rows judged against their window or text, and statistics. A threshold of 0 counts as given. A text's claims are asked
    in batches of at most `batch_size`; a claim the reply leaves out has no confidence. Rows without a source text aren't asked."""
    placed = materialise(R.with_source_text(rows, windows, texts))
    asked = R.batches(placed.where("source_text is not null"), ["text_id"], "seq", batch_size)
    claim = F.struct("seq", F.concat_ws(" ", "source", "type", "target").alias("claim"), "source_text")
    together = asked.groupBy("text_id", "batch").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    numbered = F.transform("claims", lambda x, i: F.concat(F.lit("CLAIM "), (i + 1).cast("string"), F.lit(": "), x["claim"], F.lit("\nSOURCE: "), x["source_text"]))
    replied = P.parse(P.annotate(together, P.prompt("verify", F.array_join(numbered, "\n")), provider), "verify")
    mine = lambda i: F.get(F.filter("parsed.verdicts", lambda v: v["index"] == i + 1), F.lit(0))
    each = F.transform("claims", lambda x, i: F.struct(x["seq"].alias("seq"), F.coalesce(mine(i)["confidence"], F.col("parsed.confidence")).alias("confidence"), F.coalesce(mine(i)["note"], F.col("parsed.note")).alias("note")))
    verdicts = replied.select(F.inline(each), "error")
    judged = placed.drop("confidence", "note", "error").join(verdicts, "seq", "left")
    verified = materialise(R.verify_rows(judged, 0.5 if confidence_threshold is None else confidence_threshold))
    return {"rows": verified, "statistics": R.verification_statistics(verified)}


def relationships_causal(rows: DataFrame, provider: P.Provider, max_evidence: int = 3) -> dict[str, DataFrame]:
    """rows with causal attributes, and both ways of counting. The evidence is the first `max_evidence` of a merged row's
    descriptions, else the row's own description, else said to be missing."""
    own = F.when(F.col("description") != "", F.array("description"))
    evidence = F.coalesce(F.when(F.size("descriptions") > 0, F.slice("descriptions", 1, max_evidence)), own) if "descriptions" in rows.columns else own
    listed = F.coalesce(F.array_join(F.transform(evidence, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("No direct evidence available"))
    asked = P.parse(P.annotate(rows, P.prompt("causal", F.concat_ws("\n", F.concat_ws(" ", "source", "type", "target"), listed)), provider), "causal")
    flat = asked.withColumn("is_causal", F.coalesce("parsed.is_causal", F.lit(False))).withColumns({c: F.col(f"parsed.{c}") for c in R.CAUSAL})
    judged = materialise(R.valid_causal(flat).drop("reply", "parsed", "parse_failed"))
    return {"rows": judged, "statistics": R.causal_statistics(judged)}


def relationships_normalise(rows: DataFrame, entity_threshold: str | float = "moderate", type_threshold: str | float = "moderate", method: str = "shortest", provider: P.Provider | None = None) -> dict[str, DataFrame]:
    """clusters of entities and types, and the merged relationships. Method llm asks the provider for each cluster's label."""
    if method == "llm" and provider is None:
        raise ValueError("method llm needs a provider")
    counts = materialise(R.label_counts(rows))
    maps = {}
    for kind, given in (("entity", entity_threshold), ("type", type_threshold)):
        own, t = counts.where(F.col("kind") == kind), threshold(given)
        pairs = materialise(M.similar_pairs(M.embed(own), t))
        clusters = materialise(M.cluster(own, pairs, t))
        maps[kind] = materialise(named_clusters(clusters, own, provider) if method == "llm" else M.canonical(clusters, own, method, pairs))
    return maps | {"merged": R.merge(rows, maps["entity"], maps["type"])}


def relationships_graph(rows: DataFrame, min_edge_weight: int = 1, tolerance: float = 1e-6) -> dict[str, DataFrame]:
    """nodes with all measures, edges, and a summary of one row. Ranks run to the tolerance."""
    clean = R.graph_rows(rows)
    nodes, edges = materialise(R.nodes(clean)), materialise(R.edges(clean))
    strong = N.simple_edges(R.filter_edges(edges, min_edge_weight))
    full = nodes.join(N.degrees(strong), "id", "left").join(N.pagerank(nodes.select("id"), strong, tolerance=tolerance).withColumnRenamed("rank", "pagerank"), "id", "left")
    full = full.join(N.betweenness(nodes.select("id"), strong), "id", "left").fillna(0, ["in_degree", "out_degree", "degree"])
    parts = N.components(nodes.select("id"), strong)
    summary = N.density(nodes, strong).join(parts.agg(F.count_distinct("component").alias("components"))).join(edges.agg(F.max("weight").alias("max_weight")))
    full = full.join(parts, "id", "left")
    full = materialise(full)
    for measure in ("degree", "pagerank", "betweenness"):
        top = full.orderBy(F.desc(measure), "id").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col(measure)).alias("m"), "id", "label"))).alias("x"))
        summary = summary.join(top.select(F.col("x.label").alias(f"top_by_{measure}")))
    return {"nodes": full, "edges": edges, "summary": summary}


def named_regions(nodes: DataFrame, provider: P.Provider, min_distance: float = 0.05, min_cluster_size: int = 3, most: int = 10) -> dict[str, DataFrame]:
    """positions of nodes (id, label) by likeness, pushed apart, with their region; regions with centre, size and the label the
    provider gives their nodes, told up to `most` of them."""
    placed = materialise(Y.repel(Y.semantic_layout(nodes), min_distance))
    found = materialise(Y.regions(placed, min_cluster_size))
    ranked = found.where("region >= 0").join(nodes.select("id", "label"), "id").withColumn("_n", F.row_number().over(Window.partitionBy("region").orderBy("label", "id")))
    told = ranked.where(F.col("_n") <= most).groupBy("region").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    asked = P.parse(P.annotate(told, P.prompt("name", F.array_join("labels", "\n")), provider), "name")
    names = asked.select("region", F.coalesce(F.nullif(trimmed(F.col("parsed.label")), F.lit("")), F.get("labels", F.lit(0))).alias("name"))
    return {"positions": placed.join(found, "id"), "regions": Y.region_centres(placed, found).join(names, "region")}


def entity_detect(texts: DataFrame, provider: P.Provider, size: int | None = 3, stride: int = 2, most: int = 500) -> dict[str, DataFrame]:
    """contexts (one per entity and window, context cut to `most` characters) and entities (distinct per text, by exact
    spelling). Blank texts are skipped."""
    found = P.parse(P.annotate(windows_of(texts, size, stride), P.prompt("entities", F.col("window_text")), provider), "entities")
    each = found.select("text_id", "window_index", "window_text", F.explode("parsed.entities").alias("entity")).withColumn("entity", trimmed(F.col("entity"))).where("entity <> ''")
    cut = F.when(F.length("window_text") > most, F.concat(F.substring("window_text", 1, most), F.lit("..."))).otherwise(F.col("window_text"))
    return {"contexts": each.select("text_id", "entity", cut.alias("context"), "window_index"), "entities": each.groupBy("text_id", "entity").agg(F.min("window_index").alias("window_index"))}


def entity_prepare_scoring(windows: DataFrame, nodes: DataFrame | None = None, mode: str = "window", most: int = 500, min_frequency: int = 1) -> DataFrame:
    contexts = X.entity_contexts(windows, mode, most)
    return contexts if nodes is None else X.filter_by_nodes(contexts, nodes, min_frequency)


def entity_score(entities: DataFrame, dimensions: Sequence[str | P.Dimension], provider: P.Provider, runs: int = 3, low: int = 0, high: int = 100, done: DataFrame | None = None, research: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """scores (long), statistics, justifications. Runs that fail drop; an entity counts while one run succeeds. Dimensions are
    names, scored from `low` to `high`, or Dimensions with a meaning, anchors and a scale of their own."""
    asked = [d if isinstance(d, P.Dimension) else P.Dimension(d, low=low, high=high) for d in dimensions]
    keys = ["entity", "text_id", "window_index"]
    todo = X.resume(entities, done, keys) if done is not None else entities
    each = todo.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    subject = F.concat_ws("\n", "entity", "context", F.col("run").cast("string"))
    replied = P.annotate(each, P.score_prompt(asked, subject, research), provider)
    scores = materialise(P.parse_scores(replied, [d.name for d in asked], {d.name: (d.low, d.high) for d in asked}).drop("reply"))
    low, high = min(d.low for d in asked), max(d.high for d in asked)
    by = [*keys, "dimension"]
    return {"scores": scores, "statistics": S.run_statistics(scores, by, low, high), "justifications": S.representative_justification(scores, by)}


def entity_consolidate(counts: DataFrame, given: str | float = "moderate", method: str = "frequent") -> dict[str, DataFrame]:
    """clusters, mapping, statistics of labels (label, count)."""
    t = threshold(given, ENTITY_THRESHOLDS)
    pairs = materialise(M.similar_pairs(M.embed(counts), t))
    clusters = materialise(M.cluster(counts, pairs, t))
    return {"clusters": clusters, "mapping": M.canonical(clusters, counts, method, pairs), "statistics": M.consolidation_statistics(clusters)}


def entity_compare(scores: DataFrame, dimensions: Sequence[str], groups: DataFrame | None = None, metric: str = "euclidean", permutations: int = 1000) -> dict[str, DataFrame]:
    v = materialise(C.centroids(scores, dimensions))
    d = materialise(C.distances(v, metric))
    out = {"centroids": v, "distances": d, "summary": C.distance_summary(v, metric)}
    if groups is not None:
        stats = materialise(C.group_distances(v, groups, metric))
        out |= {"groups": stats, "effect": C.effect_size(stats), "group_centroids": C.group_centroids(v, groups, len(dimensions)), "excluded": C.excluded(v, groups), "test": C.permutation_test(v, groups, metric, permutations)}
    return out


def entity_agreement(scores: DataFrame, mode: str = "run", n_bootstrap: int = 1000) -> DataFrame:
    return A.agreement(scores, mode, n_bootstrap)


def entity_cluster(scores: DataFrame, dimensions: Sequence[str], method: str = "hierarchical", k: int | None = None) -> dict[str, DataFrame]:
    v = materialise(C.centroids(scores, dimensions))
    labels = K.kmeans(v, k) if method == "kmeans" else K.hdbscan(C.distances(v)) if method == "hdbscan" else K.hierarchical_vectors(v, k)
    projected, loadings = K.pca(v)
    return {"labels": labels, "projection": projected, "loadings": loadings}


def entity_report(compared: dict[str, DataFrame]) -> str:
    """Markdown of a comparison: summary, effect and groups, all their rows in order."""
    lines = ["# Comparison", ""]
    for name in ("summary", "effect", "groups"):
        if name in compared:
            head = compared[name].columns
            rows = compared[name].orderBy(*head).collect()
            lines += [f"## {name}", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
            lines += ["| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows] + [""]
    return "\n".join(lines)


@dataclass(frozen=True)
class Decisions:
    strategy: str = "semantic_two_pass"
    size: int = 6
    stride: int = 4
    top_k: int = 3
    min_similarity: float = 0.5
    decision_threshold: float = 0.85
    factor_threshold: float = 0.80
    done: DataFrame | None = field(default=None, compare=False)


def decisions_detect(texts: DataFrame, provider: P.Provider, config: Decisions = Decisions()) -> dict[str, DataFrame]:
    """decisions, factors, and tables of them, by strategy. one_pass: both from each window, factors as they come;
    semantic_two_pass: decisions first, cleaned and deduplicated, factors from the windows most similar to each;
    context_aware: factors from every window of the text, with points of the windows before."""
    todo = X.resume(texts, config.done, ["text_id"]) if config.done is not None else texts
    windows = materialise(windows_of(todo, config.size, config.stride))
    found = P.parse(P.annotate(windows, P.prompt("decisions", F.col("window_text")), provider), "decisions")
    each = found.select("text_id", "window_index", F.posexplode("parsed.decisions").alias("_at", "decision"))
    order = F.format_string("%09d-%06d", "window_index", "_at")
    each = D.clean_decisions(each.withColumn("seq", order).drop("_at"))
    first = M.dedupe_by_leader(each, ["text_id"], "decision", "seq", config.decision_threshold) if config.strategy != "one_pass" else D.exact_unique(each, ["text_id"], "decision", "seq")
    decisions = materialise(first)
    pairs = decisions.select("text_id", "decision").join(windows, "text_id")
    if config.strategy == "semantic_two_pass":
        pairs = pairs.withColumn("similarity", _likeness(F.col("decision"), F.col("window_text")))
        pairs = M.relevant_windows(pairs, config.top_k, config.min_similarity).drop("rank")
    elif config.strategy == "one_pass":
        pairs = decisions.select("text_id", "decision", "window_index").join(windows, ["text_id", "window_index"])
    else:
        points = X.context_points(D.fallback_summary(windows), "text_id", "window_index", "bullet_points").select("text_id", "window_index", "context_points")
        pairs = pairs.join(points, ["text_id", "window_index"])
    context = F.col("context_points") if "context_points" in pairs.columns else None
    asked = P.parse(P.annotate(pairs, P.prompt("factors", F.concat_ws("\n", "decision", "window_text"), context), provider), "factors")
    raw = asked.select("text_id", "decision", "window_index", F.posexplode("parsed.factors").alias("_at", "_f")).select("text_id", "decision", "window_index", F.format_string("%09d-%06d", "window_index", "_at").alias("seq"), "_f.*")
    factors = raw if config.strategy == "one_pass" else M.dedupe_by_leader(D.clean_factors(raw), ["text_id", "decision"], "factor", "seq", config.factor_threshold)
    factors = materialise(factors)
    return {"decisions": D.decision_rows(decisions, factors), "factors": factors, "totals": D.totals(todo, decisions, factors)}


def _likeness(a: Column, b: Column) -> Column:
    """Cosine of character trigram counts of two columns, within the row."""

    def bag(x: Column) -> Column:
        return M.grams(x)

    ga, gb = bag(a), bag(b)
    ua, ub = F.array_distinct(ga), F.array_distinct(gb)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    dot = F.aggregate(F.array_intersect(ua, ub), F.lit(0.0), lambda s, x: s + count(ga, x) * count(gb, x))
    length = lambda g, u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + F.pow(count(g, x), 2)))
    return dot / (length(ga, ua) * length(gb, ub))


def decisions_normalise(decisions: DataFrame, given: float = 0.85) -> DataFrame:
    """(raw, canonical, avg_similarity) of distinct decisions; results aren't rewritten."""
    counts = materialise(decisions.groupBy(F.col("decision").alias("label")).agg(F.count(F.lit(1)).alias("count")))
    pairs = materialise(M.similar_pairs(M.embed(counts), given))
    return M.canonical(M.cluster(counts, pairs, given), counts, "frequent", pairs)


def decisions_aggregate(decisions: DataFrame, factors: DataFrame) -> dict[str, DataFrame]:
    return {"decisions": D.frequencies(decisions, "decision"), "factors": D.frequencies(factors, "factor"), "polarity": D.polarity_table(factors), "network": N.bipartite(factors)}
