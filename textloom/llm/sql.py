"""The same results in SQL that DuckDB runs over the same tables. Results no SQL expresses have none: whole survivors
(learned precedences), pieces (merging), containers (packing) and near matches are tested against brute force instead."""

from __future__ import annotations


def _term(value: str) -> str:
    return rf"trim(lower(regexp_replace({value}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')))"


_RECORDS = f"""
with replies as (
    select r.rel_id, lower(trim(e.key)) as k, json_extract_string(e.value, '$') as v
    from (select rel_id, payload from relationship_raw where json_valid(payload) and json_type(payload) = 'OBJECT') r, json_each(r.payload) e
), named as (
    select rel_id, source, target, type from relationships
    union all
    select rel_id, max(v) filter (where k = 'source'), max(v) filter (where k = 'target'), max(v) filter (where k = 'type') from replies group by 1
), records as (
    select rel_id, {_term('source')} as s, {_term('target')} as t, {_term('type')} as y from named
), grouped as (
    select rel_id, min(rel_id) over (partition by s, t, y) as keep_id from records where s <> '' and t <> '' and y <> ''
)
"""

_INSTANCES = f"""
with typed as (
    select *, {_term('type')} as type_term, {_term('instance_text')} as text_term, lower(trim(alignment_status)) as status,
        confidence between 0 and 1 and not isnan(confidence) as sure
    from fig_instances where text_id is not null and type is not null and instance_text is not null
), ranked as (
    select *, min(instance_id) over g as group_id, count(*) over g as n,
        coalesce(list_position(['exact', 'normalized_exact', 'approximate', 'ambiguous', 'missing'], status), 6) as trust,
        case when sure then -confidence else 1 end as doubt
    from typed window g as (partition by text_id, type_term, text_term)
), fields as (
    select *, 'instance_text' as field_name from ranked
    union all select *, 'confidence' from ranked where sure
    union all select *, 'support_count' from ranked where support_count >= 1
    union all select *, 'alignment_status' from ranked where status in ('exact', 'normalized_exact', 'approximate', 'ambiguous', 'missing')
)
select group_id, field_name, instance_id from fields where n > 1
qualify row_number() over (partition by group_id, field_name order by trust, doubt, detected_at desc nulls last, instance_id) = 1
"""

_LONG = r"""
with items as (
    select 'relationships_sample' as item_table, id as item_key, text from relationships_sample
    union all select 'rel_windows', cast(window_id as varchar), window_text from rel_windows
), marked as (
    select item_table, item_key, text,
        list_max(list_transform(string_split_regex(text, '[\n\r]+'), lambda x: length(trim(x, E' \t\n\r')))) as paragraph,
        list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '[\n\r]+'), lambda x: length(trim(x, E' \t\n\r')))) as sentence,
        list_max(list_transform(string_split_regex(text, '\s+'), lambda x: length(x))) as word
    from items where length(text) > 1200
)
select item_table, item_key,
    case when paragraph <= 1200 then 'paragraph' when sentence <= 1200 then 'sentence' when word <= 1200 then 'word' else 'none' end as boundary
from marked
"""

_TERMS = f"""
with single as (
    select 'relationship_type' as field_name, rel_id as record, {_term('type')} as term from relationships
    union all
    select 'entity', detection_id, {_term('e')} from (select detection_id, unnest(entities) as e from entity_detections)
), sizes as (
    select 'relationship_type' as field_name, count(*) as n from relationships union all select 'entity', count(*) from entity_detections
), totals as (
    select field_name, term, count(*) as occurrences, count(distinct record) as records from single where term <> '' group by all
), marked as (
    select totals.*, case when records <= 2 then 'rare' when records > 0.05 * n then 'common' end as mark from totals join sizes using (field_name)
)
"""

_PAIRS = f"""
with texts as (
    select row_number() over () as record, entities_json as j from relationships_sample_relationships_summary
), decoded as (
    select record, case when json_valid(j) and json_type(j) = 'VARCHAR' then json_extract_string(j, '$') else j end as j from texts
), members as (
    select 'summary' as list_name, record, unnest(json_extract_string(j, '$[*]')) as e
    from decoded where json_valid(j) and json_type(j) = 'ARRAY'
    union all
    select 'detection', detection_id, unnest(entities) from entity_detections
), single as (
    select distinct list_name, record, {_term('e')} as item from members where {_term('e')} <> ''
), sizes as (
    select 'summary' as list_name, count(*) as n from texts union all select 'detection', count(*) from entity_detections
), counts as (
    select list_name, item, count(*) as records from single group by all
), pairs as (
    select a.list_name, a.item as item_a, b.item as item_b, count(*) as together
    from single a join single b on a.list_name = b.list_name and a.record = b.record and a.item < b.item group by all having count(*) >= 6
), scored as (
    select p.list_name, item_a, item_b, together, ca.records as records_a, cb.records as records_b,
        round(together * n / (ca.records * cb.records), 6) as lift
    from pairs p join sizes using (list_name)
    join counts ca on ca.list_name = p.list_name and ca.item = item_a join counts cb on cb.list_name = p.list_name and cb.item = item_b
    where together * n >= 4 * ca.records * cb.records
)
"""

_LEAKS = f"""
with d as (select doc_id, string_split({_term('text')}, ' ') as w from documents),
i as (select item_id, string_split({_term('text')}, ' ') as w from eval_items),
dw as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
iw as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct doc_id, item_id from dw join iw using (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RECORDS + "select keep_id, rel_id as copy_id from grouped where rel_id <> keep_id",
        "p1_records": _RECORDS + "select keep_id, count(*) as copies from grouped group by 1",
        "p2_found": _INSTANCES,
        "p3_found": _LONG,
        "p3_lengths": """with items as (select 'relationships_sample' as item_table, id as item_key, text from relationships_sample union all select 'rel_windows', cast(window_id as varchar), window_text from rel_windows)
            select item_table, item_key, sum(length(text))::bigint as characters, true as within from items where length(text) > 1200 group by 1, 2""",
        "p6_documents": "select doc_id, true as whole from documents where text <> ''",
        "p7_runs": _LEAKS.replace("select distinct doc_id, array", "select doc_id, array").replace("select distinct item_id, array", "select item_id, array").replace("select distinct doc_id, item_id from dw join iw using (g)", "select doc_id, item_id, count(*) as runs from dw join iw using (g) group by 1, 2"),
        "p4_found": _TERMS + "select field_name, term, mark from marked where mark is not null",
        "p4_terms": _TERMS + "select field_name, term, occurrences, records, mark from marked",
        "p5_found": _PAIRS + "select list_name, item_a, item_b from scored",
        "p5_pairs": _PAIRS + "select list_name, item_a, item_b, together, records_a, records_b, lift from scored",
        "p7_found": _LEAKS,
    }
