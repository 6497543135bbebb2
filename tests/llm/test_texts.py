"""Splitting, packing, leaks and subjects: exact round trips, brute force and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import contamination, packing, splitting, subjects


def check_pieces(text, limit, overlap):
    pieces, kind = splitting.split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    before = 0
    for n, (a, b, o) in enumerate(pieces):
        assert 0 < b - a and b - a + o <= limit and (n or not o)
        assert not n or min(overlap, before) // 2 <= o <= min(overlap, before)
        before = b - a + o
    return pieces, kind


def coarsest(text, limit):
    cuts = {"paragraph": r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]", "sentence": r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]|(?<=[.!?])\s", "word": r"\s"}
    return next((k for k, cut in cuts.items() if all(len(x.strip()) <= limit for x in re.split(cut, text))), "none")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t é", max_size=300), st.integers(6, 40), st.integers(0, 3))
def test_pieces_lose_nothing(text, limit, overlap):
    _, kind = check_pieces(text, limit, overlap)
    assert not text or splitting.KINDS[kind] == coarsest(text, limit)


def test_pieces_end_at_boundaries():
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    pieces, _ = check_pieces(text, 200, 30)
    assert all(re.search(r"\.\s?$", text[a:b]) for a, b, _ in pieces)
    assert all(o for _, _, o in pieces[1:]) and max(b - a for a, b, _ in pieces) > 100
    assert all(text[a - o - 1].isspace() for a, b, o in pieces[1:])


def test_overlap_is_kept_beside_long_sentences():
    """Sentences between limit - overlap and the limit leave no room; they are cut at words so that the overlap fits."""
    text = " ".join("word " * 229 + "end." for _ in range(5))
    pieces, kind = check_pieces(text, 1200, 120)
    assert kind == splitting.SENTENCE and all(60 <= o <= 120 for _, _, o in pieces[1:]) and all(text[b - 1 : b + 1] != "rd" for _, b, _ in pieces)


def test_unbroken_text():
    pieces, _ = check_pieces("x" * 50_000, 1200, 120)
    assert all(o == 120 for _, _, o in pieces[1:])
    check_pieces(" " * 5_000, 1200, 120)
    check_pieces("a\n" * 20_000, 1200, 120)
    assert splitting.split_text("", 1200, 120)[0] == []


@pytest.mark.parametrize(("text", "kind"), [("a b\n" * 400, "paragraph"), ("Aa b. " * 300, "sentence"), ("aa " * 500, "word"), ("a" * 1300, "none"), ("a" * 1201 + "\nb", "none"), (("a b " * 299 + ". ") * 3, "sentence"), ("a" * 1150 + "\n" + "b" * 1200, "paragraph")])
def test_boundaries(text, kind):
    assert splitting.KINDS[splitting.split_text(text, 1200, 120)[1]] == kind == coarsest(text, 1200)


def test_split_items(spark):
    long = "Word after word. " * 200
    rows = spark.createDataFrame([("a", long), ("a", long), ("b", None), ("c", ""), ("d", "short"), ("e", "x" * 1200), (None, "y" * 1201)], "id string, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_items(rows, "id", "text").collect()
    keys = Counter(r.item_key for r in got)
    assert set(keys) == {"a", None} and keys["a"] == 2 * len(splitting.split_text(long, 1200, 120)[0])
    assert "".join(r.text[r.overlap :] for r in got if r.item_key == "a") == long * 2
    assert splitting.split_items(rows.limit(0), "id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    packs = packing.pack_histogram(histogram, 64)
    placed = Counter()
    for n, pattern in packs:
        assert n > 0 and sum(length * k for length, k in pattern) <= 64
        for length, k in pattern:
            placed[length] += n * k
    assert placed == Counter(histogram)


def test_packing(spark):
    rng = random.Random(1)
    sizes = [rng.choice([3, 5, 8, 90, 100, 250, None, 0]) for _ in range(4_000)] + [7] * 2_000
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "item long, tokens int, length string")
    got = packing.pack(rows, 100).collect()
    parts, fill, slots = Counter(), Counter(), {}
    for r in got:
        parts[r.item] += r.tokens
        fill[r.container] += r.tokens
        slots.setdefault(r.container, set()).add(r.slot)
        assert r.tokens <= 100 and (r.part == 0 or sizes[r.item] > 100)
    assert parts == Counter({i: n for i, n in enumerate(sizes) if n})
    assert max(fill.values()) <= 100 and all(fill[r.container] == r.fill for r in got)
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(len(s) for s in slots.values()) == len(got)
    least = -(-sum(n or 0 for n in sizes) // 100)
    assert len(fill) <= 1.05 * least
    assert packing.pack(rows.limit(0), 100).count() == 0


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 200_000)], "id long, text string")
    got = {r.item: r.tokens for r in packing.token_counts(rows, "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 1 and got[5] > 10


def leak_tables(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 40])))) for i in range(30)]
    docs = []
    for d in range(200):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if d % 4 == 0:
            source = items[rng.randrange(30)][1].split()
            cut = source[: rng.choice([11, 12, 13])]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in cut]
        docs.append((d, "\n".join(w) if d % 3 else " - ".join(w)))
    docs += [(900, None), (901, ""), (902, items[2][1] + " x " + items[2][1]), (902, items[2][1])]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item string")


@pytest.mark.parametrize("at_once", [100, 100_000])
def test_leaks(spark, at_once):
    items, docs, item_rows, doc_rows = leak_tables(spark)
    grams = lambda s: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (s or "").lower())] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    found = contamination.find_leaks(doc_rows, "doc_id", "text", item_rows, "item_id", "text", words_at_once=at_once).where("same")
    assert {(r.doc, r.item) for r in found.collect()} == want and len(want) > 10
    assert contamination.find_leaks(doc_rows.limit(0), "doc_id", "text", item_rows, "item_id", "text").count() == 0
    assert contamination.find_leaks(doc_rows, "doc_id", "text", item_rows.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("radius", [3, 7, 12])
def test_index_finds_all_within_radius(radius):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    index, near = contamination._Blocks(prints, radius), prints.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, radius, replace=False).tolist():
            near[i] ^= np.uint64(1) << np.uint64(bit)
    position, window, distance = index.candidates(near)
    assert {(i, i) for i in range(len(near))} <= set(zip(position.tolist(), window.tolist(), strict=True)) and distance.max() <= radius


def test_fingerprints_by_brute_force():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 50, dtype=np.uint64)
    ids = rng.integers(0, 50, 40_000)
    signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1
    got = contamination.fingerprints(contamination.running_signs(ids, signs), 17)
    for at in (0, 5, 39_000, 40_000 - 17):
        assert got[at] == np.packbits(signs[ids[at : at + 17]].sum(0, dtype=int) > 0).view(np.uint64)[0]
    assert len(got) == 40_000 - 16 and len(contamination.fingerprints(contamination.running_signs(ids[:5], signs), 17)) == 0


def altered(rng, w, each):
    out, at = list(w), rng.randrange(each)
    for i in range(at, len(w), each):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def recall(spark, each, similarity, radius):
    """Share of items whose whole, with every `each`-th word changed, is found in a document at its place."""
    rng = random.Random(each)
    items = [(i, [f"w{rng.randrange(3_000)}" for _ in range(rng.randrange(37, 110))]) for i in range(320)]
    docs = [(i, " ".join([f"d{rng.randrange(3_000)}" for _ in range(rng.randrange(50))] + altered(rng, w, each) + ["end"] * rng.randrange(30))) for i, w in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = contamination.find_leaks(d, "doc_id", "text", i, "item_id", "text", similarity=similarity, radius=radius).where("size > 12 and doc = item").select("doc").distinct().count()
    return found / len(items)


def test_recall_of_near_passages(spark):
    """Within the similarity of 0.8, one changed word in about 60, by the radius in use; and, by wider parameters, passages
    with every tenth to twelfth word changed, whose five-word shingles are 0.3 to 0.4 similar."""
    assert recall(spark, 110, 0.8, 7) >= 0.9
    for each in (10, 11, 12):
        assert recall(spark, each, 0.2, 15) >= 0.9


def test_index_is_linear():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(50_000)]
    items = [(i, rng.choices(vocabulary, k=100)) for i in range(20_000)]
    import time

    began = time.time()
    index = contamination.ItemIndex(items, 12, 7)
    assert time.time() - began < 30 and len(index.sizes[12][1]) == 20_000 * 89


def test_long_text_in_stretches(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(40)]
    long = rng.choices([f"x{i}" for i in range(900)], k=250_000)
    for at in (0, 99_990, 200_030, len(long) - 40):
        long[at : at + 40] = item
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item[:13]))], "doc_id long, text string")
    found = contamination.find_leaks(docs, "doc_id", "text", spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), "item_id", "text").collect()
    assert {r.doc_at - r.item_at for r in found if r.doc == 1 and r.same} == {0, 99_990, 200_030, len(long) - 40}
    assert {(r.doc_at, r.size) for r in found if r.doc == 2} == {(0, 12), (1, 12)} and len({(r.doc, r.doc_at, r.item_at, r.size) for r in found}) == len(found)


WORDS = {
    "law": "court judge trial appeal statute verdict".split(), "sport": "match goal referee medal stadium coach".split(),
    "energy": "grid turbine boiler meter tariff pylon".split(), "health": "nurse clinic vaccine fever surgery ward".split(),
    "finance": "loan bond ledger payroll credit audit".split(), "climate": "drought glacier heatwave monsoon carbon flood".split(),
    "education": "school exam tutor lecture homework pupil".split(), "transport": "tram ferry commuter cycleway junction bus".split(),
}
FRAMES = ["We talked about the {} and the {} again.", "The {} is only one side of the {}.", "Who pays for the {} and the {}?", "New rules for the {} came with the {}."]
FILLER = ["It is a long story.", "Nobody asked us.", "The coffee was cold by then.", "We voted twice and went home."]


def corpus():
    rng = random.Random(11)
    docs, truth = [], {}
    for d in range(900):
        about = rng.sample(list(WORDS), rng.choice([0, 1, 1, 2]))
        lines = [rng.choice(FRAMES).format(*rng.choices(WORDS[a], k=2)) for a in about for _ in range(3)] + rng.choices(FILLER, k=3)
        other = rng.choice(list(WORDS))
        lines.append(f"It was like a {rng.choice(WORDS[other])} for all of us.")
        rng.shuffle(lines)
        bare = d % 10 == 9
        docs.append((d, " ".join(x.lower().rstrip(".?") if bare else x for x in lines), "en"))
        truth[d] = set(about) or {"general"}
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus()
    labels = [(d, s, c) for d in range(0, 300) for s in truth[d] for c in ("c1", "c2")] + [(301, "law", "c1"), (301, "sport", "c2"), (None, "law", "c1")]
    extra = [(2_000, None, "en"), (2_001, " ", "en"), (2_002, "...", None), (2_003, "Zip zap. " + "The long quoted passage of the test stands here. " * 2, "xx")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").withColumn("doc", F.lit("clash"))
    l = spark.createDataFrame(labels, "doc_id long, subject string, coder string")  # noqa: E741
    passages = spark.createDataFrame([("The long quoted passage of the test stands here.",)], "text string")
    found = subjects.subject_areas(d, "doc_id", "text", "lang", l, passages, "text", [*WORDS, "general"])
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.doc, set()).add(r.subject)
    held_out = range(302, 900)
    assert set(got) == set(truth) | {2_002, 2_003} and got[2_002] == {"general"}
    assert sum(got[k] == truth[k] for k in held_out) / len(held_out) > 0.97
    none = subjects.subject_areas(d.limit(0), "doc_id", "text", "lang", l.limit(0), passages.limit(0), "text", [*WORDS, "general"])
    assert none.count() == 0


def test_sentences(spark):
    rows = spark.createDataFrame([(1, "[00:01] Interviewer: Well <b>um</b>, yes. No!\n- P05: (inaudible) Go on (as we did in the autumn when the river came up)", "EN "), (2, None, None)], "doc_id long, text string, lang string")
    got = subjects.document_sentences(rows, "doc_id", "text", "lang").collect()
    assert [(r.lang, r.sentences) for r in got] == [("en", ["well um yes", "no", "go on as we did in the autumn when the river came up"])]


def test_openings_without_stops():
    starts, asides = {"who pays for", "it is a", "nobody asked us"}, {"as i said"}
    assert subjects.cut_openings("as i said who pays for it nobody asked us it is a story".split(), starts, asides) == ["as i said who pays for it", "nobody asked us", "it is a story"]
    assert subjects.cut_openings([], starts, asides) == []
