"""Queries on relationships and their graphs, with their SQL. Relationships are rows of `relationships`, in order of rel_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import figurative, graphs
from textloom.operators import relationships as R
from textloom.operators import similarity as S
from textloom.plans.storage import materialise
from textloom.sources.tables import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "relationships").where("source is not null and target is not null and type is not null")
    return raw.select(F.col("rel_id").alias("seq"), "text_id", "window_index", "source", "target", "type", F.coalesce("description", F.lit("")).alias("description"), F.col("group_name").alias("group"))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.label_counts(_rows(spark, folder))


def merged_relationships(spark: SparkSession, folder: str) -> DataFrame:
    m = R.merge(_rows(spark, folder))
    return m.select(
        "seq", "source", "target", "type", "original_source", "original_target", "original_type", "description", "count", "confidence",
        F.array_join("descriptions", "|").alias("descriptions"), F.array_join("window_indices", ",").alias("window_indices"), F.array_join("text_ids", ",").alias("text_ids"),
    )


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return R.nodes(R.graph_rows(_rows(spark, folder)))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return R.edges(R.graph_rows(_rows(spark, folder))).withColumn("evidence", F.array_join("evidence", "|||"))


def graph_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that edges of weight 2 or more touch."""
    rows = R.graph_rows(_rows(spark, folder))
    return R.nodes_of(R.nodes(rows), R.filter_edges(R.edges(rows), 2)).select("id", "label", "frequency")


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.degrees(R.edges(R.graph_rows(_rows(spark, folder))))


def graph_density(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.graph_rows(_rows(spark, folder))
    d = graphs.density(R.nodes(rows), R.edges(rows))
    return d.select("node_count", "edge_count", F.round("density", 9).alias("density"), F.round("avg_degree", 6).alias("avg_degree"))


def graph_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks at convergence, to a change of 1e-10 in all; the SQL takes 150 rounds."""
    rows = R.graph_rows(_rows(spark, folder))
    ranks = graphs.pagerank(materialise(R.nodes(rows).select("id")), materialise(graphs.simple_edges(R.edges(rows))), tolerance=1e-10)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.graph_rows(_rows(spark, folder))
    return graphs.components(R.nodes(rows).select("id"), R.edges(rows).select("source", "target"))


def _subgraph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers' segments, nations and parts' brands: a small graph over whole tables."""
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    flows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    edges = flows.select(F.col("n_name").alias("source"), F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("target")).distinct()
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target")).where("length(source) > length(target) + 6")
    edges = materialise(edges.union(back))
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), edges


def graph_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.betweenness(*_subgraph(spark, folder)).select("id", F.round("betweenness", 9).alias("betweenness"))


def relationship_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """On the graph of relationships; graph_betweenness takes a small one over the star schema."""
    rows = R.graph_rows(_rows(spark, folder))
    pairs = materialise(rows.select(F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct())
    nodes = pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graphs.betweenness(nodes, pairs).select("id", F.round("betweenness", 9).alias("betweenness"))


def causal_majority(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.graph_rows(_rows(spark, folder)).withColumns(_causal())
    return R.causal_majority(R.valid_causal(rows))


def _causal() -> dict:
    pick = lambda xs, by: F.when(by.isNotNull(), F.get(F.array(*[F.lit(x) for x in xs]), (by % len(xs)).cast("int")))
    return {
        "is_causal": F.col("seq") % 3 != 0, "polarity": pick(["positive", "Negative", "odd"], F.col("seq")), "certainty": pick(["certain", "probable"], F.col("window_index")),
        "explicit_vs_implicit": pick(["explicit", None, "implicit "], F.col("seq")), "error": F.when(F.col("seq") % 6 == 0, "no reply"),
    }


def causal_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return R.causal_statistics(_rows(spark, folder).withColumns(_causal()))


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    windows = R.last_per_key(table(spark, folder, "rel_windows").select("text_id", "window_index", "window_text", "window_id"), ["text_id", "window_index"], "window_id")
    texts = table(spark, folder, "relationships_sample").select(F.col("id").alias("text_id"), "text")
    rows = R.with_source_text(_rows(spark, folder), windows, texts)
    return R.verify_rows(rows.withColumns({"confidence": (F.col("seq") % 100) / 80 - 0.1, "note": F.lit("")}))


def verified_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder).select("seq", "verified", F.round("verification_confidence", 6).alias("confidence"), "verification_note", F.length("source_text").alias("characters"))


def verification_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return R.verification_statistics(_verified(spark, folder))


def verification_batches(spark: SparkSession, folder: str) -> DataFrame:
    b = R.batches(_rows(spark, folder).where("text_id is not null"), ["text_id"], "seq", 20)
    return b.groupBy("text_id").agg(F.count_distinct("batch").alias("batches"), F.max("batch").alias("last"))


def mapped_labels(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    mapping = n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("raw"), F.col("r_name").alias("canonical"))
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return R.apply_mapping(c, "n_name", mapping, "place").groupBy("place").agg(F.count(F.lit(1)).alias("customers"))


def unfinished_windows(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.context import resume

    done = table(spark, folder, "relationships").where("text_id is not null").select("text_id", "window_index").distinct()
    return resume(table(spark, folder, "rel_windows").select("window_id", "text_id", "window_index"), done, ["text_id", "window_index"])


def seed_lists(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.context import parse_list

    rows = table(spark, folder, "relationships_sample_relationships_summary").where("entities_json is not null")
    return rows.select("text_id", F.size(parse_list(F.col("entities_json"))).alias("entities")).groupBy("text_id").agg(F.max("entities").alias("entities"))


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split(F.lower("instance_text"), r"[^\p{L}]+")
    rows = table(spark, folder, "fig_instances").select(F.col("instance_id").alias("seq"), "text_id", "type", "instance_text", F.element_at(words, -1).alias("source_domain"), F.get(words, F.lit(1)).alias("target_domain"))
    return rows


def alignment_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").select("alignment_status", "start_char")
    return figurative.alignment_counts(rows, rows.where("start_char is not null"))


def domain_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Domains at the broad level: some rows have a blank one, some none, and fall back to their own."""
    rows = _domains(spark, folder).where("source_domain <> ''")
    levels = F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("broad"), F.upper("source_domain"))).when(F.col("seq") % 3 == 1, F.create_map(F.lit("broad"), F.lit(" "))).otherwise(F.create_map(F.lit("narrow"), F.col("source_domain")))
    return rows.select("seq", figurative.domain_at(levels, "broad", F.col("source_domain")).alias("domain"))


def node_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nodes of the highest degree, as a picture would name them."""
    rows = R.graph_rows(_rows(spark, folder))
    nodes = R.nodes(rows).join(graphs.degrees(R.edges(rows)), "id")
    return R.labelled(nodes, "top:20")


def domain_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return figurative.domain_nodes(_domains(spark, folder))


def domain_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = figurative.domain_edges(_domains(spark, folder))
    return e.select("source", "target", "weight", "text_count", F.array_join("types", "|").alias("types"), F.array_join("examples", "|").alias("examples"))


def aligned_instances(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").select("instance_id", "text_id", "window_index", "window_text", "instance_text", "type", "confidence")
    return figurative.align(rows).select("instance_id", "alignment_status", "start_char", "end_char")


def canonical_instances(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").where("instance_text is not null and window_text is not null and window_index is not null and confidence is not null").select("instance_id", "text_id", "window_index", "window_text", "instance_text", "type", "confidence")
    found = figurative.canonicalise(figurative.align(rows))
    return found.select("instance_id", "text_id", "alignment_status", "support_count", F.array_join("supporting_window_indices", ",").alias("windows"))


def detection_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").where("confidence between 0 and 1")
    texts = table(spark, folder, "relationships").where("text_id is not null").select("text_id").distinct().union(table(spark, folder, "fig_instances").select("text_id").distinct())
    s = figurative.detection_summary(texts, rows)
    return s.withColumn("confidence", F.round("confidence", 6))


def similar_types(spark: SparkSession, folder: str) -> DataFrame:
    """Relationship types written alike, by the cosine of their character trigrams."""
    labels = table(spark, folder, "relationships").select(F.col("type").alias("label")).where("label is not null").distinct()
    return S.similar_pairs(S.embed(labels), 0.9).select("a", "b", F.round("similarity", 6).alias("similarity"))


def type_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).withColumn("label", F.lower(F.trim(F.regexp_replace("type", r"[^\p{L}]+", " "))))
    counts = materialise(rows.where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("count")))
    pairs = materialise(S.similar_pairs(S.embed(counts), 0.75))
    clusters = S.cluster(counts, pairs, 0.75)
    return S.canonical(clusters, counts, "frequent").withColumn("avg_similarity", F.round("avg_similarity", 4))


def embedding_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return S.dense_pairs(table(spark, folder, "embeddings"), 0.5, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50."""
    e = table(spark, folder, "embeddings")
    return S.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 5))


def queries() -> dict:
    found = [
        label_counts, merged_relationships, graph_nodes, graph_edges, graph_filtered, graph_degrees, graph_density, graph_pagerank, graph_components, graph_betweenness, relationship_betweenness, causal_majority,
        causal_statistics, verified_relationships, verification_statistics, verification_batches, mapped_labels, unfinished_windows, seed_lists, domain_nodes, domain_edges, aligned_instances,
        canonical_instances, alignment_counts, domain_levels, node_labels, detection_summaries, similar_types, type_clusters, embedding_pairs, nearest_vectors,
    ]
    return {f.__name__: f for f in found}


_TRIM = r"'^[\s\x{00a0}\x{2009}\x{3000}\x{0085}\v]+|[\s\x{00a0}\x{2009}\x{3000}\x{0085}\v]+$', '', 'g'"
_REL = f"""
with rels as (
    select rel_id as seq, text_id, window_index, source, target, type, coalesce(description, '') as description
    from relationships where source is not null and target is not null and type is not null
), clean as (
    select seq, text_id, window_index, description, regexp_replace(source, {_TRIM}) as source, regexp_replace(target, {_TRIM}) as target, regexp_replace(type, {_TRIM}) as type from rels
), g as (
    select *, lower(source) as source_id, lower(target) as target_id, lower(type) as type_id from clean where source <> '' and target <> '' and lower(source) <> lower(target)
), ends as (
    select source_id as id, source as label, seq, 0 as e, text_id, true as as_source from g union all select target_id, target, seq, 1, text_id, false from g
), n as (
    select id, arg_min(label, (seq, e)) as label, count(*) as frequency, count(distinct nullif(text_id, '')) as text_count,
        case when bool_or(as_source) and bool_or(not as_source) then 'both' when bool_or(as_source) then 'source' else 'target' end as role from ends group by 1
), words as (
    select source_id, target_id, type_id, description, min(seq) as pos from g where description <> '' group by all
), evidence as (
    select source_id, target_id, type_id, string_agg(description, '|||' order by pos, description) as evidence
    from (select * from words qualify row_number() over (partition by source_id, target_id, type_id order by pos, description) <= 5) group by all
), e as (
    select source_id as source, target_id as target, arg_min(type, seq) as type, count(*) as weight, count(distinct nullif(text_id, '')) as text_count, min(seq) as seq, type_id
    from g group by source_id, target_id, type_id
)
"""
_CAUSAL = """
, judged as (
    select *, seq % 3 <> 0 as is_causal, lower(['positive', 'Negative', 'odd'][seq % 3 + 1]) as p0, ['certain', 'probable'][window_index % 2 + 1] as c0, trim(['explicit', null, 'implicit '][seq % 3 + 1]) as x0,
        case when seq % 6 = 0 then 'no reply' end as error from {rows}
), attributes as (
    select *, case when p0 in ('positive', 'negative', 'neutral') then p0 else 'neutral' end as polarity, coalesce(c0, 'possible') as certainty, coalesce(x0, 'implicit') as explicit_vs_implicit from judged
)
"""
_VERIFIED = """
, w as (select text_id, window_index, arg_max(window_text, window_id) as window_text from rel_windows where text_id is not null and window_index is not null group by 1, 2),
wl as (select text_id, window_index, window_text from rel_windows qualify row_number() over (partition by text_id, window_index order by window_id desc) = 1),
judged as (
    select r.seq, coalesce(nullif(wl.window_text, ''), nullif(t.text, '')) as source_text, least(greatest((r.seq % 100) / 80 - 0.1, 0), 1) as c
    from rels r left join wl on r.text_id = wl.text_id and r.window_index = wl.window_index left join relationships_sample t on r.text_id = t.id
), v as (
    select seq, source_text is not null and c >= 0.5 as verified, case when source_text is null then 0.0 else c end as verification_confidence,
        case when source_text is null then 'No source text available' else '' end as verification_note, source_text from judged
)
"""


def oracle_sql() -> dict[str, str]:
    votes = " union all ".join(f"select source_id, target_id, type_id, seq, '{a}' as name, {a} as value from attributes where is_causal" for a in R.CAUSAL)
    domains = r"""
with d as (
    select instance_id as seq, text_id, type, instance_text, w[-1] as source, w[2] as target from (select *, regexp_split_to_array(lower(instance_text), '[^\p{L}]+') as w from fig_instances)
), r as (select * from d where source <> '' and target <> '' and source <> target),
ends as (select source as id, source as label, seq, 0 as n, text_id from r union all select target, target, seq, 1, text_id from r)
"""
    return {
        "label_counts": """select kind, label, count(*) as count from (select 'entity' as kind, source as label, type t, target g from relationships union all select 'entity', target, type, source from relationships
            union all select 'type', type, source, target from relationships) where label is not null and t is not null and g is not null group by 1, 2""",
        "merged_relationships": _REL + """, m as (
            select lower(source) as s, lower(type) as y, lower(target) as t, min(seq) as seq, arg_min(source, seq) as source, arg_min(target, seq) as target, arg_min(type, seq) as type,
                array_to_string(list_sort(list(distinct source)), '; ') as original_source, array_to_string(list_sort(list(distinct target)), '; ') as original_target, array_to_string(list_sort(list(distinct type)), '; ') as original_type,
                count(*) as count, coalesce(array_to_string(list_sort(list(distinct window_index) filter (where window_index is not null)), ','), '') as window_indices,
                coalesce(array_to_string(list_sort(list(distinct text_id) filter (where text_id <> '')), ','), '') as text_ids from rels group by all
        ), said as (select lower(source) as s, lower(type) as y, lower(target) as t, description, min(seq) as pos from rels where description <> '' group by all),
        lists as (select s, y, t, string_agg(description, '|' order by pos) as descriptions, arg_min(description, pos) as description from said group by all)
        select m.seq, source, target, type, original_source, original_target, original_type, coalesce(description, '') as description, count, 1.0::double as confidence, coalesce(descriptions, '') as descriptions, window_indices, text_ids
        from m left join lists using (s, y, t)""",
        "graph_nodes": _REL + "select * from n",
        "graph_edges": _REL + "select e.source, e.target, type, weight, text_count, coalesce(evidence, '') as evidence, seq from e left join evidence v on v.source_id = e.source and v.target_id = e.target and v.type_id = e.type_id",
        "graph_filtered": _REL + "select id, label, frequency from n where id in (select source from e where weight >= 2 union select target from e where weight >= 2)",
        "graph_degrees": _REL + """, p as (select distinct source, target from e), x as (select source as id, 0 as i, 1 as o from p union all select target, 1, 0 from p)
            select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, sum(i + o)::bigint as degree from x group by 1""",
        "graph_density": _REL + """, c as (select (select count(*) from n) as node_count, (select count(*) from (select distinct source, target from e)) as edge_count)
            select *, round(edge_count / (node_count * (node_count - 1)), 9) as density, round(2 * edge_count / node_count, 6) as avg_degree from c""",
        "graph_pagerank": _REL.replace("with rels", "with recursive rels") + """, s as (select source, target, arg_max(weight, seq) as weight from e group by 1, 2), w as (select source, target, weight / sum(weight) over (partition by source) as part from s),
            base as (select 0.15::double / count(*) as b from n), r(i, id, x) as (
                select 0, id, b from n, base union all
                select k.i + 1, n.id, b + 0.85::double * coalesce(f.flow, 0) from n cross join base cross join (select max(i) as i from r) k
                left join (select w.target, sum(r.x * w.part) as flow from r join w on w.source = r.id group by 1) f on f.target = n.id where k.i < 150
            ) select id, round(x / sum(x) over (), 9) as rank from r where i = 150""",
        "causal_majority": _REL + _CAUSAL.format(rows="g") + f""", votes as ({votes}), counted as (select source_id, target_id, type_id, name, value, count(*) as n, min(seq) as first from votes where value is not null group by all),
            best as (select * from counted qualify row_number() over (partition by source_id, target_id, type_id, name order by n desc, first) = 1)
            select source_id, target_id, type_id, max(value) filter (where name = 'polarity') as polarity, max(value) filter (where name = 'certainty') as certainty,
                max(value) filter (where name = 'explicit_vs_implicit') as explicit_vs_implicit, true as is_causal from best group by all""",
        "causal_statistics": _REL + _CAUSAL.format(rows="rels") + """, c as (select count(*) as total, count(*) filter (where is_causal) as causal, count(*) filter (where not is_causal and error is null) as non_causal, count(*) filter (where error is not null) as errors,
            count(*) filter (where is_causal and p0 = 'positive') as positive, count(*) filter (where is_causal and p0 = 'negative') as negative, count(*) filter (where is_causal and p0 not in ('positive', 'negative')) as neutral from attributes)
            select *, total - causal as non_causal_all, round(100 * causal / total, 1) as causal_percentage from c""",
        "verified_relationships": _REL + _VERIFIED + "select seq, verified, round(verification_confidence, 6) as confidence, verification_note, length(source_text)::int as characters from v",
        "verification_statistics": _REL + _VERIFIED + """select count(*) as total, count(*) filter (where verified) as verified, round(avg(verification_confidence), 3) as avg_confidence, round(min(verification_confidence), 3) as min_confidence,
            round(max(verification_confidence), 3) as max_confidence, count(*) filter (where not verified) as rejected, round(100 * count(*) filter (where verified) / count(*), 1) as rate from v""",
        "verification_batches": _REL + "select text_id, ceil(count(*) / 20)::bigint as batches, (ceil(count(*) / 20) - 1)::int as last from rels where text_id is not null group by 1",
        "mapped_labels": """select case when n_nationkey % 5 <> 0 then r_name else n_name end as place, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
        "unfinished_windows": "select window_id, text_id, window_index from rel_windows w where not exists (select 1 from relationships r where r.text_id = w.text_id and r.window_index = w.window_index)",
        "alignment_counts": "select count(*) as raw, count(start_char) as canonical, " + ", ".join(f"count(*) filter (where start_char is not null and alignment_status = '{s}') as {s}" for s in ("exact", "normalized_exact", "ambiguous", "missing", "approximate")) + ", count(*) - count(start_char) as deduplicated from fig_instances",
        "domain_levels": domains + "select seq, case when seq % 3 = 0 then upper(source) else source end as domain from d where source <> ''",
        "node_labels": _REL + ", p as (select distinct source, target from e), x as (select source as id from p union all select target from p), g2 as (select id, count(*) as degree from x group by 1) select id, label from n join g2 using (id) order by degree desc, id limit 20",
        "domain_edges": domains + """, ex as (select source, target, string_agg(instance_text, '|' order by seq, instance_text) as examples from
                (select * from (select distinct source, target, seq, instance_text from r) qualify row_number() over (partition by source, target order by seq, instance_text) <= 5) group by 1, 2)
            select r.source, r.target, count(*) as weight, count(distinct text_id) as text_count, array_to_string(list_sort(list(distinct type) filter (where type is not null)), '|') as types, any_value(examples) as examples
            from r join ex on ex.source = r.source and ex.target = r.target group by 1, 2""",
        "seed_lists": rf"""with j as (select text_id, entities_json as j, regexp_replace(entities_json, {_TRIM}) as t from relationships_sample_relationships_summary where entities_json is not null),
            m as (select text_id, case when t[1] = '[' and json_valid(j) and json_type(j) = 'ARRAY' then json_extract_string(j, '$[*]') when contains(j, ';') then string_split(j, ';') else string_split(j, ',') end as m from j)
            select text_id, max(len(list_filter(m, lambda x: x is not null and regexp_replace(x, {_TRIM}) <> '')))::int as entities from m group by 1""",
        "graph_components": _REL.replace("with rels", "with recursive rels") + """, both_ways as (select source as a, target as b from e union select target, source from e),
            cc(id, component) using key (id) as (
                select id, id from n union select w.a, min(cc.component) from cc join both_ways w on w.b = cc.id join recurring.cc as held on held.id = w.a where cc.component < held.component group by 1
            ) select id, component from cc""",
        "graph_betweenness": """with recursive flows as (select distinct n_name as source, c_mktsegment || '/' || o_orderpriority as target from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
            ways as (select source, target from flows union select target, source from flows where length(target) > length(source) + 6),
            ids as (select source as id from ways union select target from ways),
            walks(s, v, d) as (select id, id, 0 from ids union select s, target, d + 1 from walks join ways on source = v where d < (select count(*) from ids)),
            near as (select s, v, min(d) as d from walks group by 1, 2),
            paths(s, v, d, k) as (
                select id, id, 0, 1::double from ids union all
                select p.s, w.target, p.d + 1, sum(p.k) from paths p join ways w on w.source = p.v join near x on x.s = p.s and x.v = w.target and x.d = p.d + 1 group by 1, 2, 3
            ), through as (
                select a.v as id, sum(a.k * b.k / t.k) as part from paths a join paths b on b.s = a.v join paths t on t.s = a.s and t.v = b.v and t.d = a.d + b.d where a.v <> a.s and b.v <> a.v group by 1
            ) select ids.id, round(coalesce(part, 0) / ((select count(*) from ids) - 1) / ((select count(*) from ids) - 2), 9) as betweenness from ids left join through using (id)""",
        "similar_types": """with l as (select distinct type as label, ' ' || lower(type) || ' ' as t from relationships where type is not null),
            g as (select label, t[i:i + 2] as g from (select label, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) as i from l)), c as (select label, g, count(*) as c from g group by 1, 2),
            w as (select label, g, c / sqrt(sum(c * c) over (partition by label)) as w from c)
            select x.label as a, y.label as b, round(sum(x.w * y.w), 6) as similarity from w x join w y on x.g = y.g and x.label < y.label group by 1, 2 having sum(x.w * y.w) >= 0.9 - 1e-9""",
        "domain_nodes": domains + """select id, upper(id[1:1]) || lower(id[2:]) as label, count(*) filter (where n = 0) as as_source, count(*) filter (where n = 1) as as_target,
            case when bool_or(n = 0) and bool_or(n = 1) then 'both' when bool_or(n = 0) then 'source' else 'target' end as type from ends group by 1""",
        "detection_summaries": """select t.text_id, count(f.instance_id) > 0 as contains_figurative, round(coalesce(avg(f.confidence), 0), 6) as confidence, count(f.instance_id) as instance_count
            from (select distinct text_id from relationships where text_id is not null union all select distinct text_id from fig_instances) t left join (select * from fig_instances where confidence between 0 and 1) f using (text_id) group by 1""",
        "embedding_pairs": """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as similarity from embeddings a join embeddings b on a.vec_id < b.vec_id
            where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.5""",
        "nearest_vectors": """with s as (select q.vec_id as query, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as s from embeddings q, embeddings e where q.vec_id % 50 = 0)
            select query, vec_id, round(s, 5) as similarity from s qualify row_number() over (partition by query order by round(s, 12) desc, vec_id) <= 10""",
    }
