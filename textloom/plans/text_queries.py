"""Queries on windowing, projection, context and filtering, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.functions.tokens import explode_token_windows
from textloom.functions.vectors import inverse_logit, marker_size, scale_fraction
from textloom.functions.windowing import explode_windows, sentences
from textloom.operators import context as C
from textloom.operators import decisions as D
from textloom.operators import providers as P
from textloom.sources.tables import table


def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = explode_windows(table(spark, folder, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.max(F.length("window_text")).alias("longest"))


def sentence_windows(spark: SparkSession, folder: str) -> DataFrame:
    return explode_windows(table(spark, folder, "relationships_sample"), "id", "text")


def decision_windows(spark: SparkSession, folder: str) -> DataFrame:
    return explode_windows(table(spark, folder, "relationships_sample"), "id", "text", 6, 4)


def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    return explode_token_windows(table(spark, folder, "relationships_sample"), "id", "text").select("id", "window_index", F.length("window_text").alias("characters"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))


def prior_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").where("text_id is not null").select("text_id", "window_id", F.coalesce("summary", F.lit("")).alias("summary"))
    found = C.prior_summaries(rows, "text_id", "window_id", "summary", 5)
    return found.select("window_id", F.array_join("prior", "|").alias("prior"))


def context_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").where("text_id is not null and window_text is not null")
    points = D.fallback_summary(rows).select("text_id", "window_id", "bullet_points")
    return C.context_points(points, "text_id", "window_id", "bullet_points").select("window_id", F.array_join("context_points", "|").alias("points"))


def carried_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").where("text_id is not null").select("text_id", "window_id", F.from_json("entities_json", "array<string>").alias("entities"))
    return C.carry_entities(rows, "text_id", "window_id", "entities").select("window_id", F.size("carried").alias("carried"))


def entity_contexts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").where("text_id is not null and window_text is not null").groupBy("text_id", "window_index").agg(
        F.min_by(F.struct("window_text", "entities_json"), "window_id").alias("x")
    )
    windows = rows.select("text_id", "window_index", "x.window_text", F.from_json("x.entities_json", "array<string>").alias("entities"))
    return C.entity_contexts(windows, "window", 200)


def context_truncated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows")
    return rows.select("window_id", R.truncate(F.col("window_text"), 100).alias("context"))


def sentence_with_entity(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "fig_instances").where("window_text is not null and instance_text is not null")
    return each.select("instance_id", C.sentence_with(F.col("window_text"), F.lit("felt")).alias("sentence"))


def typed_instances(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fig_instances").select("instance_id", R.type_name(F.col("type")).alias("type"), "confidence")
    kept = rows.where(F.col("type").isin(R.FIGURATIVE_TYPES) & F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.clamp_confidence(F.col("confidence"))), 6).alias("confidence"))


def score_fractions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_suppkey").agg(F.round(F.avg(scale_fraction(F.col("l_quantity"), 10, 40)), 6).alias("fraction"))


def match_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fig_instances").select(R.match_key(F.col("instance_text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def reply_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    reply = F.concat(F.lit("<think>about it</think>\nHere it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return rows.select("event_id", F.get_json_object(R.object_text(reply), "$.k").cast("int").alias("k"))


def valid_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of replies, one of them a whole number written as a fraction; values beyond the scale drop the run."""
    rows = table(spark, folder, "events").select("event_id", F.concat(F.lit('{"depth": '), F.get_json_object("props", "$.k"), F.lit(".0, \"reach\": 7}")).alias("reply"))
    return P.parse_scores(rows, ["depth", "reach"], {"depth": (0, 80), "reach": (0, 80)}).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Decision-like sentences made of orders: the prose tables hold none."""
    o = table(spark, folder, "orders")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("We decided to ship", "They might ship", "Launch", "The depot holds", "Staff agreed to return")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    cause = F.element_at(F.array(*[F.lit(v) for v in ("", " because stock ran out", " due to rain since May", " given the price")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_custkey").cast("string").alias("text_id"), F.col("o_orderkey").alias("seq"), F.concat(verb, F.lit(" order class "), F.col("o_orderpriority"), cause).alias("decision"))


_SENTENCES = """
sentences as (
    select cast(o_custkey as varchar) as text_id, o_orderkey as seq,
        ['We decided to ship', 'They might ship', 'Launch', 'The depot holds', 'Staff agreed to return'][(o_orderkey % 5 + 1)::int] || ' order class ' || o_orderpriority ||
        ['', ' because stock ran out', ' due to rain since May', ' given the price'][(o_custkey % 4 + 1)::int] as decision
    from orders
)"""


def valid_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return D.frequencies(D.clean_decisions(_sentences(spark, folder)), "decision")


def first_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return D.exact_unique(_sentences(spark, folder), ["text_id"], "decision", "seq").select("text_id", "seq", "decision")


def _factors(spark: SparkSession, folder: str) -> DataFrame:
    polarity = F.element_at(F.array(F.lit("supporting"), F.lit("Opposing "), F.lit("odd")), (F.col("seq") % 3 + 1).cast("int"))
    rows = _sentences(spark, folder).withColumns({"factor": F.regexp_extract("decision", r"(because|due to|given) (.+)$", 2), "polarity": polarity})
    return D.clean_factors(rows.withColumn("decision", R.strip_causes(F.col("decision"))))


def factor_polarity(spark: SparkSession, folder: str) -> DataFrame:
    return D.polarity_table(_factors(spark, folder), "factor")


def decision_totals(spark: SparkSession, folder: str) -> DataFrame:
    s = _sentences(spark, folder)
    return D.totals(s.select("text_id").distinct(), D.clean_decisions(s), _factors(spark, folder))


def decision_factor_rows(spark: SparkSession, folder: str) -> DataFrame:
    f = _factors(spark, folder).select("text_id", "decision", "polarity")
    d = _sentences(spark, folder).select("text_id", R.strip_causes(F.col("decision")).alias("decision")).distinct()
    return D.decision_rows(d, f)


def fallback_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").where("window_text is not null")
    return D.fallback_summary(rows).select("window_id", F.size("bullet_points").alias("bullets"), F.length("summary").alias("summary_length"))


def rule_annotations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rel_windows").select("window_id", "window_text")
    asked = P.annotate(rows, P.prompt("entities", F.col("window_text")), P.RuleProvider())
    return P.parse(asked, "entities").select("window_id", F.size("parsed.entities").alias("entities"), "error", "parse_failed")


def recorded_annotations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eval_items").select("item_id", P.prompt("summary", F.col("text")).alias("p"), "answer")
    recorded = rows.where("item_id % 2 = 0").select(P.prompt_hash(F.col("p")).alias("prompt_hash"), F.to_json(F.struct(F.col("answer").alias("summary"))).alias("reply")).dropDuplicates(["prompt_hash"])
    found = P.parse(P.annotate_recorded(rows, F.col("p"), recorded), "summary")
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count("parsed.summary").alias("summaries"))


_SPACE = r"[\s\x{00a0}\x{2009}\x{3000}\x{0085}\v]"
_STRIP = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{2009}}\x{{3000}}\x{{0085}}\v]+|[\s\x{{00a0}}\x{{2009}}\x{{3000}}\x{{0085}}\v]+$', '', 'g')"
_EDGE = (_SPACE + r"|[!-/:-@\[-`{-~" + R.EDGE_MARKS + "]").replace("'", "''")


def _windows(source: str, key: str, size: int, stride: int) -> str:
    return rf"""
with s as (
    select {key} as key, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SPACE}+', E'\\1\x01', 'g'), E'\x01'),
        lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') as u
    from {source} where text is not null and regexp_matches(text, '[^\s\x{{00a0}}\x{{2009}}\x{{3000}}\x{{0085}}\v]')
), w as (
    select key, case when len(u) <= {size} then [text] else list_transform(range(0, len(u) - {size} + 1, {stride}), lambda i: array_to_string(u[i + 1:i + {size}], ' ')) end as w,
        len(u) as n, array_to_string(u[len(u) - {size} + 1:len(u)], ' ') as tail
    from s
), f as (
    select key, case when n <= {size} or (n - {size}) % {stride} = 0 or w[-1] = tail then w else list_append(w, tail) end as w from w
)
"""


def top_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent decisions."""
    return D.top(valid_decisions(spark, folder), "count", "decision", 10).select("decision", "count")


def attached_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Factors that name their decision in other case and with blanks around it."""
    f = _factors(spark, folder).select("text_id", F.concat(F.lit(" "), F.upper("decision")).alias("decision_text"), "factor")
    d = _sentences(spark, folder).select("text_id", R.strip_causes(F.col("decision")).alias("decision")).distinct()
    return D.attach_factors(d, f).groupBy("text_id", "decision").agg(F.count(F.lit(1)).alias("factors"))


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", R.safe_id(F.concat_ws("/", "c_name", "c_mktsegment")).alias("name"))


def marker_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(marker_size(F.col("l_quantity") / 40), 6).alias("size"), F.round(inverse_logit(F.col("l_quantity") / 10 - 2, 1, 7), 6).alias("scaled"))


def mapped_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Source and target domains by the default provider."""
    from textloom.plans.pipelines import figurative_map

    rows = table(spark, folder, "fig_instances").where("instance_text is not null").select("instance_id", "instance_text", "window_text")
    return figurative_map(rows, P.RuleProvider()).select("instance_id", "source_domain", "target_domain", "domain_confidence")


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Customers scored on two dimensions of different scales, three runs each, by the default provider."""
    from textloom.plans.pipelines import entity_score

    rows = table(spark, folder, "customer").select(F.col("c_name").alias("entity"), F.col("c_custkey").cast("string").alias("text_id"), F.lit(0).alias("window_index"), F.col("c_mktsegment").alias("context"))
    dimensions = [P.Dimension("depth", "how far it goes", 0, 100, "not at all", "all the way"), P.Dimension("reach", low=1, high=7)]
    return entity_score(rows, dimensions, P.RuleProvider())["scores"].select("text_id", "run", "dimension", "score")


def queries() -> dict:
    found = [
        window_counts, token_windows, sentence_windows, decision_windows, sentence_counts, prior_summaries, context_points, carried_entities, entity_contexts, context_truncated,
        sentence_with_entity, typed_instances, score_fractions, match_keys, reply_objects, valid_runs, valid_decisions, first_decisions, factor_polarity, decision_totals,
        decision_factor_rows, fallback_summaries, rule_annotations, recorded_annotations, mapped_domains, rule_scores, top_decisions, attached_factors, safe_names, marker_sizes,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    listing = "select key as id, (unnest(range(0, len(w))))::int as window_index, unnest(w) as window_text from f"
    talk = "|".join(R.NO_DECISION_WORDS)
    decided = "|".join(R.DECISION_WORDS + R.DECISION_PHRASES)
    first = ", ".join(f"'{x}'" for x in (y.split()[0] for y in R.IMPERATIVES))
    stripped = "decision"
    for pattern in R.CAUSAL_PATTERNS:
        stripped = f"regexp_replace({stripped}, '(?i){pattern}', '')"
    cleaned = _SENTENCES + rf""", stripped as (select text_id, seq, trim({stripped}) as decision, decision as whole from sentences),
cleaned as (select text_id, seq, decision from stripped where len(regexp_split_to_array(decision, '\s+')) >= 3 and not regexp_matches(lower(decision), '{talk}')
    and (regexp_matches(lower(decision), '{decided}') or split_part(lower(decision), ' ', 1) in ({first})))"""
    factors = """, factors as (
    select text_id, seq, decision, factor, case trim(lower(polarity)) when 'supporting' then 'supporting' when 'opposing' then 'opposing' else 'neutral' end as polarity
    from (select *, regexp_extract(whole, '(because|due to|given) (.+)$', 2) as factor, ['supporting', 'Opposing ', 'odd'][(seq % 3 + 1)::int] as polarity from stripped)
    where len(string_split(factor, ' ')) >= 3 and len(list_intersect(list_distinct(string_split(lower(factor), ' ')), list_distinct(string_split(lower(decision), ' ')))) / len(list_distinct(string_split(lower(factor), ' '))) <= 0.85
)"""
    return {
        "window_counts": _windows("documents", "doc_id", 3, 2) + "select key as doc_id, len(w) as windows, list_max(list_transform(w, lambda x: length(x)))::int as longest from f",
        "sentence_windows": _windows("relationships_sample", "id", 3, 2) + listing,
        "decision_windows": _windows("relationships_sample", "id", 6, 4) + listing,
        "sentence_counts": rf"""select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?]){_SPACE}+', E'\\1\x01', 'g'), E'\x01'),
            lambda x: regexp_matches(x, '[^\s\x{{00a0}}\x{{2009}}\x{{3000}}\x{{0085}}\v]')))::int as sentences from documents where text is not null""",
        "prior_summaries": """select window_id, coalesce(array_to_string(list(coalesce(summary, '')) over (partition by text_id order by window_id rows between 5 preceding and 1 preceding), '|'), '') as prior
            from rel_windows where text_id is not null""",
        "context_truncated": "select window_id, case when length(window_text) > 100 then window_text[1:100] || '...' else window_text end as context from rel_windows",
        "context_points": r"""with b as (
                select text_id, window_id, list_filter(list_transform(regexp_split_to_array(window_text, '\. ')[1:3], lambda x: """ + _STRIP.format("x") + r"""[1:80]), lambda x: x <> '') as p
                from rel_windows where text_id is not null and window_text is not null
            ), f as (select window_id, flatten(coalesce(list(p) over (partition by text_id order by window_id rows between 10 preceding and 1 preceding), [])) as q from b)
            select window_id, array_to_string(case when len(q) > 10 then q[len(q) - 9:] else q end, '|') as points from f""",
        "fallback_summaries": r"""with p as (select window_id, regexp_split_to_array(window_text, '\. ') as p from rel_windows where window_text is not null)
            select window_id, len(list_filter(list_transform(p[1:3], lambda x: """ + _STRIP.format("x") + "[1:80]), lambda x: x <> ''))::int as bullets, length(" + _STRIP.format("p[1]") + ")::int as summary_length from p",
        "sentence_with_entity": rf"""with s as (
                select instance_id, window_text, list_filter(list_transform(string_split(regexp_replace(window_text, '([.!?]){_SPACE}+', E'\\1\x01', 'g'), E'\x01'), lambda x: {_STRIP.format("x")}), lambda x: contains(lower(x), 'felt')) as u
                from fig_instances where window_text is not null and instance_text is not null
            ) select instance_id, coalesce(u[1], window_text) as sentence from s""",
        "entity_contexts": rf"""with w as (
                select text_id, window_index, arg_min(window_text, window_id) as t, arg_min(coalesce(entities_json, 'null'), window_id) as j from rel_windows where text_id is not null and window_text is not null group by 1, 2
            ), e as (
                select text_id, window_index, t, generate_subscripts(m, 1) as pos, unnest(m) as raw from (select *, json_extract_string(j, '$[*]') as m from w where json_valid(j) and json_type(j) = 'ARRAY')
            ), n as (select *, {_STRIP.format("raw")} as entity from e), k as (
                select text_id, lower(entity) as key, arg_min(entity, (window_index, pos)) as entity, min(window_index) as window_index, arg_min(t, (window_index, pos)) as t from n where entity <> '' group by 1, 2
            ) select text_id, entity, case when length(t) > 200 then t[1:197] || '...' else t end as context, window_index from k""",
        "carried_entities": rf"""with recursive w as (
                select text_id, window_id, row_number() over (partition by text_id order by window_id) as i, case when json_valid(entities_json) and json_type(entities_json) = 'ARRAY' then json_extract_string(entities_json, '$[*]') else [] end as m
                from rel_windows where text_id is not null
            ), own as (
                select text_id, window_id, i, list_distinct(list_filter(list_transform(m, lambda x: lower({_STRIP.format("x")})), lambda x: x is not null and x <> '')) as e from w
            ), r(text_id, window_id, i, carried, held) as (
                select text_id, window_id, i, []::varchar[], [e] from own where i = 1 union all
                select o.text_id, o.window_id, o.i, list_distinct(flatten(r.held)), list_append(r.held, list_distinct(list_concat(o.e, flatten(r.held))))[-5:] from r join own o on o.text_id = r.text_id and o.i = r.i + 1
            ) select window_id, len(carried)::int as carried from r""",
        "match_keys": rf"""with k as (
                select trim(regexp_replace(lower(translate(regexp_replace(instance_text, '^({_EDGE})+|({_EDGE})+$', '', 'g'), '{"".join(R.PLAIN).replace("'", "''")}', '{"".join(R.PLAIN.values()).replace("'", "''")}')), '{_SPACE}+', ' ', 'g')) as key from fig_instances
            ) select key, count(*) as n from k group by 1""",
        "recorded_annotations": """with a as (select item_id, coalesce(text, '') as p, answer from eval_items), r as (select p, any_value(answer) as answer from a where item_id % 2 = 0 group by 1), f as (select a.item_id, r.p is null as missing, r.answer from a left join r using (p))
            select case when missing then 'not recorded' end as error, count(*) as n, count(answer) as summaries from f group by 1""",
        "top_decisions": f"with {cleaned} select decision, count(*) as count from cleaned group by 1 order by 2 desc, 1 limit 10",
        "attached_factors": f"""with {cleaned}{factors} select s.text_id, s.decision, count(*) as factors from (select distinct text_id, decision from stripped) s join factors f on f.text_id = s.text_id and lower(f.decision) = lower(s.decision) group by 1, 2""",
        "safe_names": r"select c_custkey, regexp_replace(c_name || '/' || c_mktsegment, '[^\p{L}\p{N}]', '_', 'g') as name from customer",
        "marker_sizes": "select l_orderkey, l_linenumber, round(100 * (0.15::double + 2.35::double * least(greatest(l_quantity / 40, 0), 1)), 6) as size, round(1 + 6 / (1 + exp(-(l_quantity / 10 - 2))), 6) as scaled from lineitem",
        "mapped_domains": r"""with w as (select instance_id, list_filter(regexp_extract_all(lower(split_part(instance_text, chr(10), 1)), '\p{L}+'), lambda x: x not in ('a', 'an', 'the')) as w from fig_instances where instance_text is not null)
            select instance_id, case when len(w) > 1 then w[-1] else '' end as source_domain, case when len(w) > 1 then w[1] else '' end as target_domain, case when len(w) > 1 then 0.6 else 0.3 end::double as domain_confidence from w""",
        "rule_scores": """with e as (select c_custkey::varchar as text_id, unnest([1, 2, 3]) as run, c_name || chr(10) || c_mktsegment || chr(10) as t from customer),
            o as (select text_id, run, list_sum(list_transform(string_split(t || run, ''), lambda x: ord(x))) as n from e)
            select text_id, run, unnest([{'dimension': 'depth', 'score': ((n + 533) % 101)::int}, {'dimension': 'reach', 'score': (1 + (n + 515) % 7)::int}], recursive := true) from o""",
        "typed_instances": f"""select type, count(*) as n, round(avg(least(greatest(confidence, 0), 1)), 6) as confidence
            from (select translate(trim(lower(type)), ' -', '__') as type, confidence from fig_instances)
            where type in ({', '.join(repr(t) for t in R.FIGURATIVE_TYPES)}) and not isnan(confidence) group by 1""",
        "score_fractions": "select l_suppkey, round(avg(least(greatest((l_quantity - 10) / 30, 0), 1)), 6) as fraction from lineitem group by 1",
        "reply_objects": "select event_id, (props->>'$.k')::int as k from events",
        "valid_runs": """select dimension, count(*) as n, sum(score)::bigint as total from (
            select unnest([{'dimension': 'depth', 'score': (props->>'$.k')::int}, {'dimension': 'reach', 'score': 7}], recursive := true) from events where (props->>'$.k')::int between 0 and 80) group by 1""",
        "valid_decisions": f"with {cleaned} select decision, count(*) as count, count(distinct text_id) as texts from cleaned group by 1",
        "first_decisions": f"with {_SENTENCES} select text_id, seq, decision from sentences qualify row_number() over (partition by text_id, lower(trim(decision)) order by seq) = 1",
        "factor_polarity": f"""with {cleaned}{factors} select factor, count(*) filter (where polarity = 'supporting') as supporting, count(*) filter (where polarity = 'opposing') as opposing,
            count(*) filter (where polarity = 'neutral') as neutral from factors group by 1""",
        "decision_totals": f"""with {cleaned}{factors}, n as (select (select count(distinct text_id) from sentences) as texts, (select count(*) from cleaned) as decisions, (select count(*) from factors) as factors)
            select *, round(decisions / greatest(texts, 1), 2) as decisions_per_text, round(factors / greatest(decisions, 1), 2) as factors_per_decision from n""",
        "decision_factor_rows": f"""with {cleaned}{factors} select s.text_id, s.decision, count(f.seq) as factor_count, count(f.seq) filter (where polarity = 'supporting') as supporting_count,
            count(f.seq) filter (where polarity = 'opposing') as opposing_count, count(f.seq) filter (where polarity = 'neutral') as neutral_count
            from (select distinct text_id, decision from stripped) s left join factors f using (text_id, decision) group by 1, 2""",
    }
