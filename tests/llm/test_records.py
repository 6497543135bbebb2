"""Duplicates, survivors, term counts and pairs against brute force; nulls, blanks, ties, repeats, empty tables."""

import json
import random
import re
from collections import Counter
from datetime import datetime
from decimal import Decimal
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.json_text import json_field, json_object, json_strings
from textloom.functions.text import term, words
from textloom.llm import cooccurrence, term_frequency
from textloom.llm.formatting_duplicates import canonical_form, collapse, copies_of, fingerprint_records, merkle_digest
from textloom.llm.survivors import Field, latest_states, learn_precedences, partial_order, survivors


def plain(s):
    return " ".join(re.findall(r"[^\W_]+", s or "")).lower()


def test_terms(spark):
    cases = ["A  b_c", "«É​x»", "2.5 m", "", " \n", None, "ＡＢ", "x" * 100_000]
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select(term(F.col("s")).alias("t"), words(F.col("s")).alias("w")).collect()
    assert [r.t for r in rows] == [None if c is None else plain(c) for c in cases]
    assert rows[3].w == [] and rows[0].w == ["a", "b", "c"]


def test_json(spark):
    cases = ['{"Source": "a"}', '{"a": 1} x', '{"a": 1}{"b": 2}', "{'a': 1}", '{"a": 1', "[1]", "", None, '{"SOURCE": null, "source": "z"}', '{"source": {"b": "q"}}']
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select(json_object(F.col("p")).alias("o")).select("o", json_field(F.col("o"), "source").alias("s")).collect()
    assert [r.o is not None for r in rows] == [True, False, False, False, False, False, False, False, True, True]
    assert rows[0].s == "a" and rows[8].s == "z" and "q" in rows[9].s
    lists = ['["a", null]', json.dumps(json.dumps(["b"])), "x", "", None, '{"a": 1}', "null"]
    got = spark.createDataFrame([(c,) for c in lists], "p string").select(json_strings(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == [["a", None], ["b"], [], [], [], [], []]


RECORDS = [(1, "A b", "C", "t"), (2, "a-B", "c.", "T"), (3, "ab", "c", "t"), (4, "c", "a b", "t"), (5, None, "c", "t"), (6, None, "", "T"), (2, "a-B", "c.", "T")]


def records(spark, rows):
    return spark.createDataFrame([(*r, "noise") for r in rows], "rel_id long, source string, target string, type string, digest string")


def test_duplicates(spark):
    prints = fingerprint_records(records(spark, RECORDS), "rel_id", ["source", "target", "type"])
    assert {(r.keep_id, r.copies) for r in collapse(prints).collect()} == {(1, 3), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert sorted(tuple(r) for r in copies_of(prints).collect()) == [(1, 2), (1, 2)]
    none = fingerprint_records(records(spark, []), "rel_id", ["source", "target", "type"])
    assert collapse(none).count() == 0 and copies_of(none).count() == 0


def test_hot_duplicate(spark):
    rows = spark.range(30_000).select(F.col("id").alias("rel_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    prints = fingerprint_records(rows, "rel_id", ["source"])
    assert copies_of(prints).count() == 9_999


def test_nested_digest(spark):
    kind = T.StructType.fromDDL("a string, b array<string>, m map<string,string>")
    rows = [(("X y", ["p", "q"], {"k": "1", "l": "2"}),), (("x-Y", ["P", "q."], {"l": "2", "k": " 1"}),), (("x y", ["q", "p"], {"k": "1", "l": "2"}),), ((None, None, None),), (("", [], {}),)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("r", kind)]))
    got = df.select(merkle_digest(F.col("r"), kind).alias("d"), canonical_form(F.col("r"), kind).alias("c"), merkle_digest(F.col("r"), kind, False).alias("u")).collect()
    assert got[0].d == got[1].d != got[2].d and got[0].u == got[2].u
    assert got[0].c == got[1].c != got[2].c and got[3].c == got[4].c and got[3].d == got[4].d


def test_typed_leaves(spark):
    kind = T.StructType.fromDDL("d double, i int, x decimal(10,3), s string, t timestamp, b boolean, day date, f float, y binary")
    day, next_day = datetime(2024, 1, 2), datetime(2024, 1, 3)
    base = (1.5, 1, Decimal("1.500"), "1.5", day, True, day.date(), 2.5, b"a")
    other = [(0, -1.5), (0, 15.0), (1, -1), (1, 15), (2, Decimal("15")), (3, "15"), (4, next_day), (5, False), (6, next_day.date()), (7, -2.5), (8, b"A"), (0, None)]
    rows = [base, (*base[:3], "1-5", *base[4:])] + [(*base[:at], value, *base[at + 1 :]) for at, value in other]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("r", kind)]))
    got = df.select(merkle_digest(F.col("r"), kind).alias("d"), canonical_form(F.col("r"), kind).alias("c")).collect()
    assert got[0] == got[1] and len({r.d for r in got}) == len({r.c for r in got}) == len(rows) - 1
    zeros = spark.createDataFrame([((0.0,),), ((-0.0,),), ((float("nan"),),)], "r struct<v: double>")
    own = [r.c for r in zeros.select(canonical_form(F.col("r"), zeros.schema["r"].dataType).alias("c")).collect()]
    assert own[0] == own[1] != own[2]


def test_one_very_long_list(spark):
    """A list of 300,000 members hands on as many rows, each without the list."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: F.concat(F.lit("t"), (x % 1000).cast("string"))).alias("terms"))
    got = term_frequency.count_terms(term_frequency.occurrences(rows, "f", F.col("terms"))).agg(F.count(F.lit(1)), F.sum("occurrences"), F.sum("records")).first()
    assert tuple(got) == (1000, 300_000, 1000)


def test_terms_beyond_the_memory(spark):
    """Ahead of the shuffle sums are handed on in pieces; behind it they come together again."""
    rows = spark.range(0, 40_000, 1, 2).select(F.array(F.concat(F.repeat(F.lit("long "), 20), (F.col("id") % 9_000).cast("string")), F.lit("hot")).alias("terms"))
    got = term_frequency.count_terms(term_frequency.occurrences(rows, "f", F.col("terms")), partition_mb=0, bits=3, memory_mb=20)
    assert got.count() == 9_001 and {r.term: r.records for r in got.where("term = 'hot'").collect()} == {"hot": 40_000}


def instances(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, status string, score double, at timestamp, value string, size int")


def fields():
    return [Field("value", F.col("value"), F.col("value").isNotNull()), Field("score", F.col("score"), F.col("score").between(0, 1))]


def test_survivors(spark):
    t = datetime(2024, 1, 1)
    rows = instances(spark, [
        (3, "a", "good", 0.5, t, None, 1), (1, "a", "bad", 7.0, t, "x", 1), (2, "a", "bad", None, None, "y", 1), (4, "b", "bad", 0.1, t, "z", 1), (5, None, "bad", 0.1, t, "z", 1), (6, None, "bad", 0.1, t, "z", 1),
        (7, "c", None, float("nan"), None, None, 1), (8, "c", None, None, None, None, 1), (9, "d", "good", 0.4, t, "p", 1), (9, "d", "good", 0.4, t, "p", 1),
    ])
    order = [F.when(F.col("status") == "good", 0).otherwise(1), F.coalesce(-F.unix_micros("at"), F.lit(2**62))]
    got = {r.k: r for r in survivors(rows, ["k"], "id", order, fields()).collect()}
    assert set(got) == {"a", "c", "d"}
    assert (got["a"].group_id, got["a"].size, got["a"].value, got["a"].value_from, got["a"].score_from) == (1, 3, "x", 1, 3)
    assert (got["c"].value, got["c"].value_from, got["c"].score_from) == (None, None, None)
    assert got["d"].value_from == 9
    assert survivors(rows.limit(0), ["k"], "id", order, fields()).count() == 0


def staged():
    return [Field("value", F.col("value"), F.col("value").isNotNull(), F.col("status")), Field("score", F.col("score"), F.col("score").between(0, 1))]


def taught(groups=12):
    at = lambda d: datetime(2024, 1, d)
    rows = []
    for g in range(groups):
        rows += [(10 * g, f"g{g}", "draft", 0.5, at(1), "v", 1), (10 * g + 1, f"g{g}", "final", 0.5, at(2), "v", 1), (10 * g + 2, f"g{g}", "archived", 0.5, at(3), "v", 1)]
    return rows


def test_currency(spark):
    new = [(1000, "new", "draft", 0.9, None, "old value", 1), (1001, "new", "final", 0.1, None, "new value", 1), (1002, "new", "other", 0.2, None, None, 1)]
    df = instances(spark, taught() + new).withColumn("currency", F.lit("clash"))
    learned = learn_precedences(df, ["k"], staged(), "at")
    assert set(learned.pairs["value"]) == {("draft", "final"), ("final", "archived"), ("draft", "archived")} and "score" not in learned.pairs
    trust = [-F.col("score")]
    current = survivors(df, ["k"], "id", trust, staged(), "at", learned, trust_first=False).where("k = 'new'").first()
    assert (current.value, current.value_from, current.value_current, current.score, current.score_current) == ("new value", 1001, True, 0.9, False)
    trusted = survivors(df, ["k"], "id", trust, staged(), "at", learned).where("k = 'new'").first()
    assert (trusted.value, trusted.value_from, trusted.value_current) == ("old value", 1000, True)
    tied = survivors(df, ["k"], "id", [F.lit(1)], staged(), "at", learned).where("k = 'new'").first()
    assert tied.value == "new value"
    plain_ = survivors(df, ["k"], "id", trust, staged()).where("k = 'new'").first()
    assert (plain_.value, plain_.value_current) == ("old value", False)
    none = learn_precedences(df.limit(0), ["k"], staged(), "at")
    assert none.pairs == {"value": {}} and survivors(df.limit(0), ["k"], "id", trust, staged(), "at", none, False).count() == 0


def test_currency_of_all_transitions(spark):
    """Frequent states gain nothing by being frequent, and what goes both ways teaches nothing."""
    rng = random.Random(2)
    rows = [(100 * g + i, f"g{g}", rng.choice("aaaaaab"), 0.5, datetime(2024, 1, 1 + i), "v", 1) for g in range(300) for i in range(8)]
    assert learn_precedences(instances(spark, rows), ["k"], staged(), "at").pairs["value"] == {}


def test_contradictions():
    assert partial_order([("a", "b", 9), ("b", "c", 8), ("c", "a", 3), ("x", "x", 5)]) == {("a", "b"): 9, ("b", "c"): 8, ("a", "c"): 8}
    learned = {("a", "b"): 9, ("b", "c"): 8, ("a", "c"): 8}
    assert latest_states(["a", "c"], [None, None], learned) == ["c"]
    assert latest_states(["a", "c", "z"], [None, None, None], learned) == ["c", "z"]
    assert latest_states(["a", "c"], [5, 3], learned) == ["a"]
    assert latest_states(["b", "c", "a"], [7, None, 9], learned) == ["c"]
    assert latest_states(["a", "b", "c"], [5, None, 3], {("a", "b"): 4, ("b", "c"): 6}) == ["a"]
    assert latest_states([], [], learned) == [] and latest_states(["a", "b"], [4, 4], {}) == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.integers(1, 9)), max_size=20), st.dictionaries(st.sampled_from("abcdef"), st.none() | st.integers(0, 3), max_size=6))
def test_orders_are_partial(net, group):
    order = partial_order(net)
    assert all(a != b and (b, a) not in order for a, b in order)
    assert all((a, d) in order for a, b in order for c, d in order if b == c)
    latest = latest_states(list(group), list(group.values()), order)
    assert bool(latest) == bool(group)
    if all(t is None for t in group.values()):
        assert latest == [s for s in group if not any((s, x) in order for x in group)]
    if group and all(t is not None for t in group.values()):
        assert latest == [s for s in group if group[s] == max(group.values())]


def test_currency_by_brute_force(spark):
    rng = random.Random(8)
    states = ["s0", "s1", "s2", "s3"]
    rows = taught(20) + [
        (5_000 + i, f"n{rng.randrange(120)}", rng.choice([*states, "draft", "final", None]), round(rng.random(), 1), rng.choice([None, datetime(2024, 2, rng.randrange(1, 20))]), rng.choice(["v", "w", None]), 1)
        for i in range(700)
    ]
    df = instances(spark, rows)
    learned = learn_precedences(df, ["k"], staged(), "at")
    got = {r.k: (r.value, r.value_from, r.value_current) for r in survivors(df, ["k"], "id", [F.col("score")], staged(), "at", learned, False).collect()}
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for k, members in groups.items():
        if len(members) < 2:
            continue
        usable = [r for r in members if r[5] is not None]
        own = {s: max((r[4] for r in usable if r[2] == s and r[4]), default=None) for s in {r[2] for r in usable if r[2] is not None}}
        part = len(own) > 1 and any(r[4] is None for r in usable if r[2] is not None)
        if part:
            latest = latest_states(sorted(own), [own[s] for s in sorted(own)], learned.pairs["value"])
            usable = [r for r in usable if r[2] in latest]
        best = min(usable, key=lambda r: (r[3], r[0]), default=None)
        assert got[k] == ((best[5], best[0], part) if best else (None, None, False)), k
    assert sum(c for _, _, c in got.values()) > 30


@pytest.mark.parametrize("limit", [0, 100])
def test_term_counts(spark, limit):
    rng = random.Random(4)
    data = [(i, [rng.choice(["a", "b b", "B-b", "", None, f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(6))] if i % 50 else None) for i in range(2_000)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in data], "id int, terms array<string>, term string")
    single = term_frequency.occurrences(rows, "f", F.transform("terms", term))
    got = {r.term: (r.occurrences, r.records) for r in term_frequency.count_terms(single, partition_mb=limit, bits=2).collect()}
    occurrences, records_ = Counter(), Counter()
    for _, terms in data:
        own = [plain(t) for t in terms or [] if plain(t)]
        occurrences.update(own)
        records_.update(set(own))
    assert got == {t: (n, records_[t]) for t, n in occurrences.items()}
    sizes = rows.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit("f").alias("field_name"), "table_rows")
    marks = {r.term: r.mark for r in term_frequency.mark_terms(term_frequency.count_terms(single), sizes).collect()}
    assert marks == {t: "rare" if n <= 2 else "common" if n > 100 else None for t, n in records_.items()}
    assert term_frequency.count_terms(single.limit(0)).count() == 0


def test_radix_plan():
    plan = term_frequency._radix_plan({0: 10, 1: 10, 2: 1, 7: 1}, 3, 10)
    assert plan[0] != plan[1] and plan[2] == plan[3] and len(set(plan)) == 8 and set(plan.values()) == set(range(max(plan.values()) + 1))


@pytest.mark.parametrize(("most", "block"), [(500_000, 1000), (0, 3)])
def test_pairs(spark, monkeypatch, most, block):
    monkeypatch.setattr(cooccurrence, "MOST_ITEMS", most)
    rng = random.Random(7)
    items = [f"i{k}" for k in range(40)] + ["", None, "Hot!"]
    data = [(rng.choice("st"), [rng.choice(items) for _ in range(rng.randrange(9))] + ["hot"] * (i % 3 == 0)) if i % 40 else ("s", None) for i in range(1_500)]
    data += [("s", ["x one", "X-one", "y"])] * 20
    rows = spark.createDataFrame(data, "l string, items array<string>").withColumn("weight", F.lit(1))
    lists = [cooccurrence.baskets(rows.where(F.col("l") == k), k, F.transform("items", term)) for k in "st"]
    found = cooccurrence.item_pairs(lists[0].union(lists[1]), 3, 1.5, block).collect()
    got = {(r.list_name, r.item_a, r.item_b): (r.together, r.records_a, r.records_b, round(r.lift, 9)) for r in found}
    single, both, n = Counter(), Counter(), Counter()
    for k, own in data:
        kept = sorted({plain(x) for x in own or []} - {""})
        n[k] += 1
        single.update((k, x) for x in kept)
        both.update((k, *p) for p in combinations(kept, 2))
    want = {
        (k, a, b): (c, single[k, a], single[k, b], round(c * n[k] / single[k, a] / single[k, b], 9))
        for (k, a, b), c in both.items() if c >= 3 and c * n[k] >= 1.5 * single[k, a] * single[k, b]
    }
    assert got == want and ("s", "x one", "y") in got and len(found) == len(got)
    assert cooccurrence.item_pairs(cooccurrence.baskets(rows.limit(0), "s", F.col("items"))).count() == 0


def test_pairs_of_long_lists(spark):
    rows = spark.createDataFrame([([f"w{i:04d}" for i in range(1_500)],)] * 6, "items array<string>").union(spark.createDataFrame([([],)] * 60, "items array<string>"))
    assert cooccurrence.item_pairs(cooccurrence.baskets(rows, "s", F.col("items")), block=200).count() == 1_500 * 1_499 // 2
    cut = spark.createDataFrame([([*range(6_000)], 1)], "codes array<int>, weight long")
    sizes = cooccurrence._pairs_of(cut, 100).where(F.rand() < 2).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()
    assert sum(r.n for r in sizes) == 6_000 * 5_999 // 2 and max(r.n for r in sizes) < 0.2 * sum(r.n for r in sizes)
