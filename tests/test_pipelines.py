import os
import sys

import pytest
from pyspark import cloudpickle

from textloom.operators import context as X
from textloom.operators import providers as P
from textloom.plans import pipelines as L
from textloom.sources import readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])
TEXTS = [
    ("t1", "The city felt like a sleeping giant. Heavy Rain causes River Floods. We decided to build a dam because floods damaged homes. We went home."),
    ("t2", "Traffic reduces Air Quality. The council agreed to close Main Street due to dirty air in winter. Nobody spoke."),
    ("t3", "  "),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "text_id string, text string")


class Scripted:
    """Replies by the task in the prompt's first line."""

    def __init__(self, **replies):
        self.replies = replies

    def generate(self, prompt, system=None):
        reply = self.replies[prompt.split("\n")[0]]
        if isinstance(reply, Exception):
            raise reply
        return reply


def test_figurative(texts):
    out = L.figurative_detect(texts, P.RuleProvider())
    rows = out["instances"].collect()
    assert rows and all(r.text_id == "t1" and r.alignment_status == "exact" for r in rows)
    summary = {r.text_id: r for r in out["summary"].collect()}
    assert summary["t1"].contains_figurative and not summary["t3"].contains_figurative and summary["t3"].confidence == 0


def test_figurative_survives_bad_replies(texts):
    out = L.figurative_detect(texts, Scripted(summary="no json", figurative=RuntimeError("down")))
    assert out["instances"].count() == 0
    assert {r.error for r in out["windows"].collect()} == {"RuntimeError: down"}


def test_domains(spark):
    rows = spark.createDataFrame([(1, "a", "time is money", "w", "metaphor"), (2, "b", "life is a trip", "w", "metaphor")], "seq int, text_id string, instance_text string, window_text string, type string")
    reply = '```json\n{"source_domain": {"moderate": "journeys"}, "target_domain": "Time", "confidence": "high"}\n```'
    out = L.figurative_pipeline(rows, Scripted(domains=reply))
    assert [(r.source, r.target, r.weight) for r in out["edges"].collect()] == [("journeys", "time", 2)]
    assert {r.domain_confidence for r in out["mapped"].collect()} == {0.9}
    assert {(r.kind, r.canonical) for r in out["mapping"].collect()} == {("source", "JOURNEYS"), ("target", "TIME")}


def test_relationships(spark, texts):
    out = L.relationships_detect(texts, P.RuleProvider())
    edges = out["edges"].collect()
    assert {(e.source, e.type, e.target) for e in edges} >= {("Heavy Rain", "causes", "River Floods"), ("Traffic", "reduces", "Air Quality")}
    rows = out["edges"].selectExpr("monotonically_increasing_id() as seq", "*")
    graph = L.relationships_graph(rows)
    nodes = {r.id: r for r in graph["nodes"].collect()}
    assert nodes["traffic"].out_degree == 1 and nodes["traffic"].role == "source" and nodes["air quality"].in_degree == 1
    windows = L.windows_of(texts)
    checked = L.relationships_verify(rows, windows, texts, P.RuleProvider(), 0.0)
    assert all(r.verified for r in checked["rows"].collect())
    causal = L.relationships_causal(rows, P.RuleProvider())["statistics"].first()
    assert causal.total == causal.causal + causal.non_causal
    merged = L.relationships_normalise(rows)["merged"]
    assert merged.count() == 2


def test_entities(spark, texts):
    out = L.entity_detect(texts, P.RuleProvider())
    assert ("t1", "Heavy Rain") in {(r.text_id, r.entity) for r in out["entities"].collect()}
    scored = L.entity_score(out["contexts"].limit(3), ["depth"], Scripted(score='{"depth": {"score": 80.0, "justification": "so"}}'), runs=2)
    stats = scored["statistics"].collect()
    assert stats and all(s.mean == 80 and s.std == 0 and s.n == 2 for s in stats)
    assert L.entity_score(out["contexts"].limit(3), ["depth", "reach"], Scripted(score='{"depth": 80}'), runs=2)["scores"].count() == 0
    counts = spark.createDataFrame([("heavy rain", 3), ("heavy rains", 1), ("sun", 1)], "label string, count int")
    groups = L.entity_consolidate(counts, "loose")
    assert {(r.raw, r.canonical) for r in groups["mapping"].collect()} == {("heavy rain", "heavy rain"), ("heavy rains", "heavy rain"), ("sun", "sun")}


@pytest.mark.parametrize("strategy", ["one_pass", "semantic_two_pass", "context_aware"])
def test_decisions(texts, strategy):
    out = L.decisions_detect(texts, P.RuleProvider(), L.Decisions(strategy=strategy))
    found = {(r.text_id, r.decision) for r in out["decisions"].collect()}
    assert ("t1", "We decided to build a dam") in found and ("t2", "The council agreed to close Main Street") in found
    assert out["totals"].first().texts == 3
    if strategy != "one_pass":
        assert {r.polarity for r in out["factors"].collect()} == {"supporting"}
    again = L.decisions_aggregate(out["decisions"], out["factors"])
    assert again["decisions"].count() == len({d for _, d in found})


def test_csv_round_trip(spark, tmp_path, texts):
    path = str(tmp_path / "t.csv")
    writers.write_csv(texts, path)
    back = {(r.text_id, r.text.strip()) for r in readers.texts(spark, path).collect()}
    assert back == {(i, t.strip()) for i, t in TEXTS}
    rel = spark.createDataFrame([("a ", "b", "t", "3", "yes"), ("", "b", "t", "x", "no"), ("a", "c", "u", "x", "0")], "source string, target string, type string, window_index string, is_causal string")
    writers.write_csv(rel, str(tmp_path / "r.csv"))
    rows = {(r.source, r.target, r.window_index, r.is_causal, r.kind) for r in readers.relationships(spark, str(tmp_path / "r.csv")).collect()}
    assert rows == {("a", "b", 3, True, "causal"), ("a", "c", 0, False, "causal")}


def test_columns_and_groups(spark):
    assert readers.pick_columns(["id", "body"]) == ("body", "id")
    with pytest.raises(ValueError):
        readers.pick_columns(["a"])
    assert {tuple(r) for r in readers.inline_groups(spark, "a:x, y;b:z").collect()} == {("a", "x"), ("a", "y"), ("b", "z")}


def test_resume(spark, tmp_path):
    path = tmp_path / "done"
    store = writers.Results(spark, str(path), "entity string, score int", ["entity"])
    assert store.load().count() == 0
    store.append(spark.createDataFrame([("a", 1)], "entity string, score int"))
    (path / "broken.json").write_text('{"entity": "b", "sco\n')
    todo = store.remaining(spark.createDataFrame([("a",), ("b",)], "entity string"))
    assert [r.entity for r in todo.collect()] == ["b"]


def test_metadata_and_folders(tmp_path):
    run = tmp_path / "run_1" / "detect"
    path = writers.run_metadata(str(run), "detect", {"a": 1}, {"n": 2}, {}, 0.0)
    assert os.path.exists(path) and readers.metadata(path)["statistics"] == {"n": 2}
    assert writers.nested_folder(str(run / "x.csv"), "map") == str(tmp_path / "run_1" / "map")


def test_gexf(spark):
    nodes = spark.createDataFrame([("a", "A & B")], "id string, label string")
    edges = spark.createDataFrame([("a", "a", 2, "t")], "source string, target string, weight int, type string")
    text = writers.gexf(nodes, edges)
    assert "A &amp; B" in text and text.index("<nodes>") < text.index("<edges>") and 'weight="2"' in text


def test_carried_entities(spark):
    rows = spark.createDataFrame([("t", 0, ["A"]), ("t", 1, ["b", "a"]), ("t", 2, None)], "text_id string, window_index int, entities array<string>")
    got = {r.window_index: r.carried for r in X.carry_entities(rows, "text_id", "window_index", "entities").collect()}
    assert got == {0: [], 1: ["A"], 2: ["A", "b"]}


def test_balanced_json(spark):
    rows = spark.createDataFrame([('x {"a": "}"} y',), ("[1, [2]] z",), ("none",), (None,)], "r string")
    assert [r[0] for r in rows.select(P.balanced_json(rows.r)).collect()] == ['{"a": "}"}', "[1, [2]]", None, None]


def test_token_windows(spark):
    from textloom.functions import tokens

    codec = tokens.words_codec()
    assert tokens.token_windows("a b c d e f", codec, 3, 2) == ["a b c", "c d e", "d e f"]
    assert tokens.token_windows("a  b", codec, 3, 2) == ["a  b"] and tokens.token_windows(" ", codec, 3, 2) == [] and tokens.token_windows(None, codec, 3, 2) == []
    text = "Seven words make up this short text, more or less."
    rows = spark.createDataFrame([("x", text), ("y", None)], "id string, text string")
    got = tokens.explode_token_windows(rows, "id", "text", 5, 5).orderBy("window_index").collect()
    assert got[0].window_text + got[1].window_text == text[: len(got[0].window_text + got[1].window_text)] and text.endswith(got[-1].window_text)


def test_report_has_every_group(spark):
    """45 groups: 45 means within and 990 between."""
    names = [f"g{i:02}" for i in range(45)]
    pairs = [("within", a, a) for a in names] + [("between", a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    lines = L.entity_report({"groups": spark.createDataFrame(pairs[::-1], "kind string, group_a string, group_b string")}).splitlines()
    assert [x for x in lines if x.startswith(("| within", "| between"))] == [f"| {k} | {a} | {b} |" for k, a, b in sorted(pairs)]


def test_default_provider_answers_every_task(spark, texts):
    rows = spark.createDataFrame([(1, "a", "time is a thief", "w", "metaphor"), (2, "b", "thief", None, "metaphor")], "seq int, text_id string, instance_text string, window_text string, type string")
    mapped = {r.seq: (r.source_domain, r.target_domain, r.domain_confidence, r.error) for r in L.figurative_map(rows, P.RuleProvider()).collect()}
    assert mapped == {1: ("thief", "time", 0.6, None), 2: ("", "", 0.3, None)}
    found = L.entity_detect(texts, P.RuleProvider())["contexts"]
    scored = L.entity_score(found, ["depth", P.Dimension("reach", "how far", 1, 5, "near", "far")], P.RuleProvider(), runs=2)
    assert scored["scores"].count() == 4 * found.count() and scored["scores"].where("dimension = 'reach' and not score between 1 and 5").count() == 0
    assert {r.text_id: r.text for r in L.resolved(texts, P.RuleProvider()).collect()}["t2"] == TEXTS[1][1]
    assert {r.text for r in L.resolved(texts, Scripted(coreference='{"resolved_text": " "}')).collect()} == {t for _, t in TEXTS}


def test_score_prompt(spark):
    from pyspark.sql import functions as F

    asked = P.score_prompt([P.Dimension("depth", "how deep", 0, 10, "flat", "bottomless"), P.Dimension("reach", high=10)], F.lit("the sea"), {"topic": "water", "none": ""})
    text = spark.range(1).select(asked.alias("p")).first().p
    assert text.startswith("score\n") and "Meaning: how deep" in text and "0 stands for: flat" in text and "10 stands for: bottomless" in text
    assert "from 0 to 10, for example 5, 6, 8, 8, 9" in text and "topic: water" in text and "none:" not in text and text.endswith("ENTITY:\nthe sea")


class Counting:
    """Verdicts for all claims but the second of each batch; refuses more than three claims at once."""

    def generate(self, prompt, system=None):
        import json

        n = prompt.count("CLAIM ")
        if n > 3:
            raise ValueError("too many")
        return json.dumps({"verdicts": [{"index": i, "confidence": 0.5 + i / 10, "note": str(i)} for i in range(1, n + 1) if i != 2]})


def test_claims_are_verified_in_batches(spark):
    rows = spark.createDataFrame([(i, "t" if i < 7 else "u" if i < 9 else None, 0, f"s{i}", "x", "y") for i in range(10)], "seq long, text_id string, window_index int, source string, type string, target string")
    windows = spark.createDataFrame([("t", 0, "the window")], "text_id string, window_index int, window_text string")
    texts = spark.createDataFrame([("u", "the text")], "text_id string, text string")
    got = L.relationships_verify(rows, windows, texts, Counting(), batch_size=3)["rows"].collect()
    assert len(got) == 10 and not any(r.error for r in got)
    by_text = {t: sorted(r.verification_confidence for r in got if r.text_id == t) for t in ("t", "u", None)}
    assert by_text == {"t": [0.0, 0.0, 0.6, 0.6, 0.6, 0.8, 0.8], "u": [0.0, 0.6], None: [0.0]}
    assert {r.verification_note for r in got if r.text_id is None} == {"No source text available"}


def test_clusters_named_by_the_provider(spark):
    rows = spark.createDataFrame([(1, "t", 0, "heavy rain", "floods", "causes", ""), (2, "t", 0, "heavy rains", "floods", "causes", "")], "seq long, text_id string, window_index int, source string, target string, type string, description string")
    named = L.relationships_normalise(rows, method="llm", provider=Scripted(name='{"label": "RAIN"}'))
    assert {(r.raw, r.canonical) for r in named["entity"].collect()} == {("heavy rain", "RAIN"), ("heavy rains", "RAIN"), ("floods", "floods")}
    assert {r.canonical for r in L.relationships_normalise(rows, method="llm", provider=Scripted(name="no"))["entity"].collect()} == {"heavy rain", "floods"}
    with pytest.raises(ValueError):
        L.relationships_normalise(rows, method="llm")


def test_label_modes(spark):
    from textloom.operators import relationships as R

    nodes = spark.createDataFrame([("a", "A", 3, 0.1), ("b", "B", 3, 0.5), ("c", "C", 1, 0.4)], "id string, label string, degree int, pagerank double")
    got = {m: {r.id for r in R.labelled(nodes, m).collect()} for m in ("all", "none", "top:1", "pagerank:2", "top:x", "odd")}
    assert got == {"all": {"a", "b", "c"}, "none": set(), "top:1": {"a"}, "pagerank:2": {"b", "c"}, "top:x": {"a", "b", "c"}, "odd": {"a", "b", "c"}}


@pytest.mark.parametrize(("text", "want"), [('x {"a": [1]} y', '{"a": [1]}'), ("[1}", None), ('{"a": "]"}', '{"a": "]"}'), ("{[}]", None), ("none", None)])
def test_balanced_brackets(text, want):
    assert P.balanced(text) == want


def test_http_provider_tries_again(monkeypatch):
    import io
    import urllib.request

    calls = []

    def open_(request, timeout):
        calls.append(request.data)
        if len(calls) < 3:
            raise OSError("down")
        return io.BytesIO(b'{"response": "ok"}')

    monkeypatch.setattr(urllib.request, "urlopen", open_)
    assert P.HttpProvider("m", options={"temperature": 0.1}, pause=0).generate("p") == "ok" and b'"temperature": 0.1' in calls[0] and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        P.HttpProvider("m", retries=1, pause=0).generate("p")
