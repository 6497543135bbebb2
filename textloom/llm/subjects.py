"""Subject areas of documents, propagated from a few coded ones.

Documents are similar as far as they share words. The similarity graph is kept in factored form, document - word -
document, so its edges hold for all pairs without being listed. Subjects travel along it in rounds: words collect the
subjects of the documents they occur in; only those pass them on that are verified to be concentrated on a subject well
beyond what the languages they occur in would give; documents whose coders agree are clamped to their codes; every document
may hold several subjects. Then each sentence takes the subject of its most telling word, told with regard to the subjects
its document came to hold; frames whose subject keeps missing the rest of the document (similes, comparisons) are recognised
and left out, and a subject counts for a document that has it in a sufficient share of its sentences.

Texts are cut into sentences and hashed once. From then on a round is one pass over the documents where they lie, with the
verified words broadcast a block at a time, and one shuffle of sums per word, subject and language, combined per task.
Documents are never joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import term
from textloom.llm.contamination import shingle_hashes
from textloom.operators.keyed import join_checked
from textloom.plans.storage import broadcast_object, broadcast_value, materialise

#: A word with this share in one subject is telling, however frequent that subject is.
CERTAIN = 0.6
#: Words in one broadcast block; a table of more is taken block by block.
MOST_WORDS = 500_000
#: Coded documents are broadcast up to this number, of some 40 bytes each, and joined by a shuffle beyond.
MOST_SEEDS = 500_000
#: Marks of transcription and markup that are not part of what was said; longer text in brackets is part of it.
NOISE = r"\[[^\]\n]{0,40}\]|\([^)\n]{0,40}\)|</?[A-Za-z][^>\n]{0,200}>"
SPEAKER = r"^\s*(?:-\s+)?\p{L}{1,12}\d{0,3}\s*:\s+"
FULL_STOP = r"[.!?](\s|$)"


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, NOISE, " "), r"[\n\r]+"), lambda x: F.regexp_replace(F.trim(x), SPEAKER, ""))


def cut_openings(words: list[str], starts: set[str], asides: set[str]) -> list[str]:
    """Cut words without punctuation where a known start begins, alone or behind a known aside such as "as I said"."""
    found: list[list[str]] = []
    for i in range(len(words)):
        now = found[-1] if found else None
        begins = " ".join(words[i : i + 3]) in starts and " ".join(now or []) not in asides
        aside = now is not None and len(now) >= 3 and any(
            " ".join(words[i : i + k]) in asides and " ".join(words[i + k : i + k + 3]) in starts for k in range(1, 6)
        )
        if now is None or begins or aside:
            found.append([])
        found[-1].append(words[i])
    return [" ".join(s) for s in found]



def _learn_openers(sentences: DataFrame, share: float, least: int) -> tuple[set[str], set[str]]:
    """Starts and asides of sentences (words, aside). Starts are three words that begin a sentence four times out of five
    they occur; asides stand ahead of a comma there. Either makes up at least `share` of all sentences or asides, so at
    most 1 / share of each reach the driver."""
    rest = F.when(F.col("aside") != "", F.substr("words", F.length("aside") + 2))
    begun = sentences.select(F.explode(F.array(F.substring_index("words", " ", 3), F.substring_index(rest, " ", 3))).alias("start")).where("start like '% % %'")
    total = sentences.count()
    at_least = max(least, int(total * share))
    starts = {r.start: r.n for r in begun.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).collect()}
    names = sorted(starts)
    grams = shingle_hashes(_hashes(pa.array([w for s in names for w in s.split(" ")], pa.string())), 3)[::3] if names else np.zeros(0, np.uint64)
    order = np.argsort(grams)
    known = sentences.sparkSession.sparkContext.broadcast((grams[order], order))

    def anywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, position = known.value
        count = np.zeros(len(keys), np.int64)
        for batch in batches if len(keys) else ():
            words, ends = _split(batch.column(0))
            inside = _whole(ends, 3)
            found = shingle_hashes(_hashes(words), 3)[inside]
            slot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            count += np.bincount(slot[keys[slot] == found], minlength=len(keys))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(position[at].astype(np.int32)), pa.array(count[at])], ["start", "m"])

    met = sentences.select("words").mapInArrow(anywhere, "start int, m long").groupBy("start").agg(F.sum("m").alias("m")).collect()
    kept = {names[r.start] for r in met if starts[names[r.start]] >= 0.8 * r.m}
    often = sentences.where("aside <> '' and size(split(aside, ' ')) <= 5").groupBy("aside").agg(F.count(F.lit(1)).alias("n"))
    often = often.where(F.col("n") >= max(4 * least, int(total * 5 * share)))
    return kept, {r.aside for r in often.select("aside").collect()}


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def _split(sentences: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of sentences, and where each sentence ends among them."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(sentences, " ")
    return lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _whole(ends: np.ndarray, n: int) -> np.ndarray:
    """Positions from which `n` words lie within one sentence."""
    total = int(ends[-1]) if len(ends) else 0
    last = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(max(0, total - n + 1))
    return at[at + n <= last[: len(at)]]

def document_sentences(documents: DataFrame, doc: str, text: str, lang: str, share: float = 2e-5, least: int = 5) -> DataFrame:
    """(doc, lang, sentences): the words of each sentence of every document with text, speakers and marks removed.

    Texts without punctuation are cut where a sentence opening learned from the others occurs. Null and blank texts give
    no row; texts without words have no sentences. Sentences are an array in the document's own row: no shuffle.
    """
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), "^([a-z]{2})", 1)
    rows = documents.where(F.col(text).rlike(r"\S")).select(F.col(doc).alias("doc"), code.alias("lang"), F.col(text).alias("text"))
    stopped = F.col("text").rlike(FULL_STOP)
    cut = F.flatten(F.transform("lines", lambda x: F.when(F.col("stopped"), F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x))))
    aside = lambda x: term(F.regexp_extract(x, r"^([^,.;:!?]{1,30}),\s", 1))
    each = F.filter(F.transform("cut", lambda x: F.struct(term(x).alias("words"), aside(x).alias("aside"))), lambda x: x["words"] != "")
    lined = rows.select("doc", "lang", stopped.alias("stopped"), _lines(F.col("text")).alias("lines")).select("doc", "lang", "stopped", cut.alias("cut"))
    lined = materialise(lined.select("doc", "lang", "stopped", each.alias("sentences")))
    learned = _learn_openers(lined.where("stopped").select(F.inline("sentences")), share, least)
    openers = documents.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<string>")
    def by_openings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[s for line in lines for s in cut_openings(line.split(" "), *openers.value)] for lines in batch])

    whole = lined.where("stopped").select("doc", "lang", F.col("sentences.words").alias("sentences"))
    return whole.unionByName(lined.where("not stopped").select("doc", "lang", by_openings("sentences.words").alias("sentences")))


def _blocks(table: DataFrame, key: str, most: int) -> Iterator[DataFrame]:
    """The rows of a materialised table in blocks of about `most`, by the hash of the key."""
    n = max(1, -(-table.count() // most))
    for k in range(n):
        yield table.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else table


class _Batch:
    """Documents as flat arrays: the hashed words of all sentences of all documents, and what is known of each. Columns that a
    pass has no use for may be missing."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        flat = lambda n, kind: column[n].flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        sizes = lambda n: column[n].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner = lambda n: np.repeat(np.arange(batch.num_rows), sizes(n))
        self.doc, self.n_docs = column["doc"], batch.num_rows
        if "lang" in column:
            self.lang = column["lang"].to_numpy(zero_copy_only=False)
        if "words" in column:
            self.words, self.length, self.n_sentences = flat("words", np.int64).view(np.uint64), flat("lengths", np.int64), sizes("lengths")
            self.ends, self.sentence_doc = np.cumsum(self.length), owner("lengths")
            self.word_sentence = np.repeat(np.arange(len(self.length)), self.length)
            self.lift, self.best = np.zeros(len(self.length)), np.full(len(self.length), -1)
        if "grams" in column:
            self.grams, self.gram_doc = flat("grams", np.int64).view(np.uint64), owner("grams")
            self.seed, self.seed_doc, self.is_seed = flat("seed", np.int64), owner("seed"), column["seed"].is_valid().to_numpy(zero_copy_only=False)
        self.votes = flat("votes", np.float64).reshape(self.n_docs, len(column["votes"].flatten()) // max(1, self.n_docs)) if "votes" in column else None
        if "best" in column:
            self.lift, self.best = flat("lift", np.float64), flat("best", np.int64).copy()

    def vote(self, table: Words, n: int) -> None:
        """Add what the table's words pass on to the documents they occur in."""
        at, row = table.find(self.grams)
        subject, weight, owner = table.votes(row, self.gram_doc[at])
        cast = np.bincount(owner * n + subject, weight, self.n_docs * n).reshape(self.n_docs, n)
        self.votes = cast if self.votes is None else self.votes + cast

    def scores(self, n: int, least_share: float) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each document's subjects, and whether it has any say: coded documents are clamped to their codes."""
        votes = np.zeros((self.n_docs, n)) if self.votes is None else self.votes
        total = votes.sum(1, keepdims=True)
        strong = np.where(votes >= least_share * total, votes, 0.0)
        y = strong / np.maximum(strong.sum(1, keepdims=True), 1e-300)
        codes = np.bincount(self.seed_doc * n + self.seed, minlength=self.n_docs * n).reshape(self.n_docs, n).astype(float)
        codes /= np.maximum(codes.sum(1, keepdims=True), 1.0)
        return np.where(self.is_seed[:, None], codes, y), self.is_seed | (total[:, 0] > 0)

    def mark(self, table: Words, y: np.ndarray) -> None:
        """Each sentence's most telling word: the highest lift, raised by the part its subject has in the document."""
        at, row = table.find(self.words)
        sentence, best = self.word_sentence[at], table.best[row]
        lift = table.lift[row] * (1 + y[self.sentence_doc[sentence], best])
        order = np.lexsort((best, lift))
        new, subject = np.zeros(len(self.length)), np.full(len(self.length), -1)
        new[sentence[order]], subject[sentence[order]] = lift[order], best[order]
        better = new > self.lift
        self.lift, self.best = np.where(better, new, self.lift), np.where(better, subject, self.best)


@dataclass
class Words:
    """Verified words, sorted by hash: lift, best subject, and the votes they pass on as rows of (subject, weight)."""

    grams: np.ndarray
    lift: np.ndarray
    share: np.ndarray
    best: np.ndarray
    start: np.ndarray
    subject: np.ndarray
    weight: np.ndarray

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = np.flatnonzero(self.grams[slot] == grams)
        return at, slot[at]

    def votes(self, row: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.start[row + 1] - self.start[row]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[row], n)
        return self.subject[at], self.weight[at], np.repeat(owner, n)

    def where(self, kept: np.ndarray) -> Words:
        n = np.diff(self.start)
        inner = np.repeat(kept, n)
        return Words(self.grams[kept], self.lift[kept], self.share[kept], self.best[kept], np.concatenate([[0], np.cumsum(n[kept])]), self.subject[inner], self.weight[inner])


def _summed(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Values summed by equal keys."""
    if not len(values):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return [k[new] for k in keys], np.add.reduceat(values[order], np.flatnonzero(new))


SUMS = "kind int, gram long, part int, value double"
#: Kinds of sums: of a word's subjects, of its documents by language, and the same for all documents.
OF_SUBJECT, OF_LANGUAGE, ALL_SUBJECTS, ALL_DOCUMENTS = range(4)


def _language(codes: np.ndarray) -> np.ndarray:
    """Two-letter codes as numbers, 0 for none."""
    return np.array([0 if len(c) != 2 else 1 + (ord(c[0]) - 97) * 26 + ord(c[1]) - 97 for c in codes.tolist()], np.int64)


def _combined(pieces: Iterator[tuple[list[np.ndarray], np.ndarray]], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Sums of a whole partition, handed on whenever there are `most` different ones."""
    keys, values = [np.zeros(0, np.int64)] * 3, np.zeros(0)
    waiting, rows = [], 0

    def merged() -> tuple[list[np.ndarray], np.ndarray]:
        return _summed([np.concatenate([keys[i], *[w[0][i] for w in waiting]]) for i in range(3)], np.concatenate([values, *[w[1] for w in waiting]]))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int32)), pa.array(keys[1]), pa.array(keys[2].astype(np.int32)), pa.array(values)], ["kind", "gram", "part", "value"])

    for piece in pieces:
        waiting.append(piece)
        rows += len(piece[1])
        if rows >= most:
            (keys, values), waiting, rows = merged(), [], 0
            if len(values) >= most:
                yield batch()
                keys, values = [np.zeros(0, np.int64)] * 3, np.zeros(0)
    keys, values = merged()
    yield batch()


def _word_sums(b: _Batch, n: int, least_share: float) -> tuple[list[np.ndarray], np.ndarray]:
    y, said = b.scores(n, least_share)
    lang = _language(b.lang)
    doc_of, subject = np.nonzero(np.where(said[:, None], y, 0.0))
    part = y[doc_of, subject]
    own = np.bincount(doc_of, minlength=b.n_docs)
    start = np.cumsum(own) - own
    here = said[b.gram_doc]
    doc = b.gram_doc[here]
    grams, row = np.unique(b.grams[here].view(np.int64), return_inverse=True)
    k = own[doc]
    at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[doc], k)
    langs, code = np.unique(lang, return_inverse=True)
    docs = np.flatnonzero(said)

    def of(keys: np.ndarray, width: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums by keys row * width + column, as rows, columns and sums."""
        if len(grams) * width <= 1 << 24:
            total = np.bincount(keys, values, len(grams) * width)
            found = np.flatnonzero(total)
            return found // width, found % width, total[found]
        (found,), total = _summed([keys], values)
        return found // width, found % width, total

    r, s, v = of(np.repeat(row, k) * n + subject[at], n, part[at])
    q, c, w = of(row * len(langs) + code[doc], len(langs), np.ones(len(row)))
    parts = [
        (OF_SUBJECT, grams[r], s, v), (OF_LANGUAGE, grams[q], langs[c], w),
        (ALL_SUBJECTS, subject, lang[doc_of], part), (ALL_DOCUMENTS, np.zeros(len(docs), np.int64), lang[docs], np.ones(len(docs))),
    ]
    kinds, keys, inner, values = zip(*[(np.full(len(v), kind), g, p, v) for kind, g, p, v in parts], strict=True)
    return [np.concatenate(kinds), np.concatenate(keys), np.concatenate(inner)], np.concatenate(values)


def _verified(sums: pd.DataFrame, totals: pd.DataFrame, n: int, prior: float, least_lift: float) -> Words:
    """Words at least `least_lift` times as frequent with their best subject as the languages of their documents would give,
    and the votes they pass on."""
    docs = totals[totals.kind == ALL_DOCUMENTS].set_index("part").value
    held = totals[totals.kind == ALL_SUBJECTS]
    langs = docs.index.to_numpy()
    by = np.zeros((len(langs), n))
    by[np.searchsorted(langs, held.part.to_numpy()), held.gram.to_numpy()] = held.value.to_numpy()
    everywhere = by.sum(0) / max(1.0, docs.sum())
    expected = (by + 5 * everywhere) / (docs.to_numpy()[:, None] + 5)
    grams, row = np.unique(sums.gram.to_numpy().view(np.uint64), return_inverse=True)
    own, kind, part, value = np.zeros((len(grams), n)), sums.kind.to_numpy(), sums.part.to_numpy(), sums.value.to_numpy()
    of = kind == OF_SUBJECT
    own[row[of], part[of]] = value[of]
    base = np.zeros((len(grams), n))
    np.add.at(base, row[~of], value[~of, None] * expected[np.searchsorted(langs, part[~of])])
    chances = own + prior * everywhere
    lifts = chances / (base + np.maximum(prior * everywhere, 1e-9))
    best = lifts.argmax(1)
    lift, mine = lifts[np.arange(len(grams)), best], chances[np.arange(len(grams)), best]
    total = chances.sum(1)
    share = mine / np.maximum(total, 1e-300)
    kept = (lift >= least_lift) | ((share >= CERTAIN) & (lift > 1))
    weights = (chances[kept] / total[kept, None]) ** 2 * np.log(lift[kept])[:, None]
    at, subject = np.nonzero(weights)
    return Words(grams[kept], lift[kept], share[kept], best[kept], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=int(kept.sum())))]), subject, weights[at, subject])


class _Graph:
    """The documents, the votes written down with them, and the words whose votes are still to be counted: with one block of
    words these are counted in the pass that needs them, of several blocks all but the last are written down first."""

    def __init__(self, docs: DataFrame, n: int, least_share: float) -> None:
        self.docs, self.n, self.least_share, self.spark = docs, n, least_share, docs.sparkSession
        self.voted, self.pending = docs, None

    def verify(self, prior: float, least: int, least_lift: float) -> Iterator[Words]:
        """One pass over the documents, one shuffle of sums; words in fewer than `least` documents are left out."""
        n, least_share, pending = self.n, self.least_share, self.pending

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _combined(_word_sums(b, n, least_share) for b in _voted(batches, pending, n))

        columns = [c for c in ("doc", "lang", "grams", "seed", "votes") if c in self.voted.columns]
        each = self.voted.select(*columns).mapInArrow(count, SUMS).groupBy("kind", "gram", "part").agg(F.sum("value").alias("value"))
        listed = each.groupBy((F.col("kind") >= ALL_SUBJECTS).alias("all"), F.when(F.col("kind") < ALL_SUBJECTS, F.col("gram")).alias("gram")).agg(
            F.collect_list(F.struct("kind", "gram", "part", "value")).alias("sums"), F.sum(F.when(F.col("kind") == OF_LANGUAGE, F.col("value"))).alias("n"),
        )
        kept = materialise(listed.where(F.col("all") | (F.col("n") >= least)))
        totals = kept.where("all").select(F.inline("sums")).toPandas().sort_values(["kind", "part"])
        return (_verified(block.select(F.inline("sums")).toPandas(), totals, n, prior, least_lift) for block in _blocks(kept.where("not all"), "gram", MOST_WORDS))

    def vote(self, tables: Iterator[Words]) -> None:
        """Let the words of all blocks vote anew."""
        self.voted, self.pending, n = self.docs, None, self.n
        schema = T.StructType([*self.docs.schema.fields, T.StructField("votes", T.ArrayType(T.DoubleType()))])
        for words in tables:
            if self.pending:

                def cast(batches: Iterator[pa.RecordBatch], pending=self.pending) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        for b in _voted([batch], pending, n):
                            yield _with(batch.select([c for c in batch.schema.names if c != "votes"]), votes=_lists(b.votes.ravel(), np.full(b.n_docs, n)))

                self.voted = materialise(self.voted.mapInArrow(cast, schema))
            self.pending = broadcast_object(self.spark, words)


def _voted(batches: Iterator[pa.RecordBatch], pending: Broadcast | None, n: int) -> Iterator[_Batch]:
    table = broadcast_value(pending) if pending else None
    for batch in batches:
        if batch.num_rows:
            b = _Batch(batch)
            if table:
                b.vote(table, n)
            yield b


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _passage_runs(passages: DataFrame, text: str, run: int) -> DataFrame:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = _split(batch.column(0))
            found = shingle_hashes(_hashes(words), run)[_whole(ends, run)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).view(np.int64))], ["gram"])

    return passages.select(term(F.col(text)).alias("words")).where("words <> ''").mapInArrow(runs, "gram long").distinct()


def hashed_documents(cut: DataFrame, seeds: DataFrame, passages: DataFrame, passage_text: str, run: int = 4) -> DataFrame:
    """(doc, lang, words, lengths, grams, seed): the hashed words of all sentences, the sentences' lengths, the document's
    different words, and its codes. Sentences that share `run` consecutive words with a passage are left out."""
    spark, kind = cut.sparkSession, cut.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, lang string, words array<long>, lengths array<int>, grams array<long>"
    known = materialise(_passage_runs(passages, passage_text, run))
    rows, plain = cut.select("doc", "lang", "sentences"), True
    for block in _blocks(known, "gram", 4 * MOST_WORDS):
        grams = spark.sparkContext.broadcast(np.sort(np.array([r.gram for r in block.collect()], np.int64).view(np.uint64)))

        def hashed(batches: Iterator[pa.RecordBatch], grams=grams, plain=plain) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sentences, n = batch.column(2), batch.num_rows
                if plain:
                    words, ends = _split(sentences.flatten())
                    words = _hashes(words)
                else:
                    words, ends = sentences.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(batch.column(3).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
                own = (sentences if plain else batch.column(3)).value_lengths().to_numpy(zero_copy_only=False)
                at = _whole(ends, run)
                quoted = np.zeros(len(ends), bool)
                if len(grams.value):
                    runs = shingle_hashes(words, run)[at]
                    slot = np.minimum(np.searchsorted(grams.value, runs), len(grams.value) - 1)
                    quoted[np.searchsorted(ends, at[grams.value[slot] == runs], "right")] = True
                length, doc = np.diff(ends, prepend=0), np.repeat(np.arange(n), own)
                words, sizes, doc = words[np.repeat(~quoted, length)], length[~quoted], doc[~quoted]
                in_doc = np.bincount(doc, sizes, n).astype(np.int64)
                order = np.lexsort((words, np.repeat(np.arange(n), in_doc)))
                ordered, owner = words[order], np.repeat(np.arange(n), in_doc)
                first = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])])[: len(words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _lists(words.view(np.int64), in_doc), _lists(sizes.astype(np.int32), np.bincount(doc, minlength=n)), _lists(ordered[first].view(np.int64), np.bincount(owner[first], minlength=n))],
                    ["doc", "lang", "words", "lengths", "grams"],
                )

        rows, plain = (rows if plain else materialise(rows)).mapInArrow(hashed, schema), False
    return join_checked(rows, materialise(seeds), ["doc"], MOST_SEEDS, "left")


def _seeds(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc, seed): documents whose coders agree, with the numbers of their subjects; none for those of no subject."""
    coded = labels.where("doc_id is not null and subject is not null").groupBy("doc_id", "coder").agg(F.array_sort(F.collect_set("subject")).alias("codes"))
    agreed = coded.groupBy("doc_id").agg(F.collect_set("codes").alias("all")).where("size(all) = 1").select(F.col("doc_id").alias("doc"), F.explode(F.col("all")[0]).alias("subject"))
    numbers = labels.sparkSession.createDataFrame([(s, i) for i, s in enumerate(subjects)], "subject string, number int")
    return agreed.join(numbers, "subject", "left").groupBy("doc").agg(F.array_sort(F.collect_list("number")).alias("seed"))


def propagate(graph: _Graph, rounds: int = 3, prior: float = 8.0, least: int = 3, least_lift: float = 2.0) -> list[Words]:
    """Words verified after `rounds` rounds; the graph's documents have the votes of the last round."""
    for _ in range(rounds):
        graph.vote(graph.verify(prior, least, least_lift))
    return list(graph.verify(prior, least, least_lift))


def subject_areas(
    documents: DataFrame, doc: str, text: str, lang: str, labels: DataFrame, passages: DataFrame, passage_text: str,
    subjects: list[str], none: str = "general", part: float = 1 / 6, telling_lift: float = 3.0, frame_sentences: int = 30, frame_agreement: float = 0.4, least_share: float = 0.12,
) -> DataFrame:
    """(doc, subject): one row per subject that at least `part` of a document's sentences are literally about, `none` if
    there is none. Every document with text comes out; null and blank texts don't. Rows repeated under one id are judged each;
    the document has the subjects of all of them. Without labels all documents are `none`."""
    own, spark = [s for s in subjects if s != none], documents.sparkSession
    n = len(own)
    cut = document_sentences(documents, doc, text, lang)
    if not own:
        return cut.select("doc", F.lit(none).alias("subject")).distinct()
    docs = materialise(hashed_documents(cut, _seeds(labels, own), passages, passage_text))
    graph = _Graph(docs, n, least_share)
    tables = [w.where((w.lift >= telling_lift) | (w.share >= CERTAIN)) for w in propagate(graph)]
    marked, pending = graph.voted, graph.pending
    kept = [f for f in docs.schema.fields if f.name in ("doc", "words", "lengths")]
    added = [T.StructField("lift", T.ArrayType(T.DoubleType())), T.StructField("best", T.ArrayType(T.LongType()))]
    for k, words in enumerate(tables):
        table, last = broadcast_object(spark, words), k == len(tables) - 1

        def mark(batches: Iterator[pa.RecordBatch], table=table, last=last, names=[f.name for f in kept]) -> Iterator[pa.RecordBatch]:
            known = broadcast_value(table)
            for batch in batches:
                for b in _voted([batch], pending, n):
                    b.mark(known, b.scores(n, least_share)[0])
                    rest = batch.select(names if last else [c for c in batch.schema.names if c not in ("lift", "best")])
                    yield _with(rest, lift=_lists(b.lift, b.n_sentences), best=_lists(b.best, b.n_sentences))

        base = kept if last else [f for f in graph.voted.schema.fields if f.name not in ("lift", "best")]
        marked = materialise(marked.mapInArrow(mark, T.StructType([*base, *added])))
    beside = materialise(_frames(marked, part, n).where((F.col("n") >= frame_sentences) & (F.col("agreeing") < frame_agreement * F.col("n"))).select("gram"))
    judged = marked
    for k, block in enumerate(_blocks(beside, "gram", MOST_WORDS)):
        grams = spark.sparkContext.broadcast(np.sort(np.array([r.gram for r in block.collect()], np.int64).view(np.uint64)))

        def literal(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = _Batch(batch)
                at = _whole(b.ends, 2)
                pairs = shingle_hashes(b.words, 2)[at]
                if len(grams.value):
                    slot = np.minimum(np.searchsorted(grams.value, pairs), len(grams.value) - 1)
                    b.best[b.word_sentence[at[grams.value[slot] == pairs]]] = -1
                kept = batch.select([c for c in batch.schema.names if c != "best"])
                yield _with(kept, best=_lists(b.best, b.n_sentences))

        names = [f for f in marked.schema.fields if f.name != "best"]
        judged = (materialise(judged) if k else judged).mapInArrow(literal, T.StructType([*names, marked.schema["best"]]))

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            kept = b.best >= 0
            counts = np.bincount(b.sentence_doc[kept] * n + b.best[kept], minlength=b.n_docs * n).reshape(b.n_docs, n)
            at, subject = np.nonzero((counts > 0) & (counts >= b.n_sentences[:, None] * part - 1e-9))
            bare = np.setdiff1d(np.arange(b.n_docs), at)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.doc.take(pa.array(at)), b.doc.take(pa.array(bare))]), pa.array(np.concatenate([subject, np.full(len(bare), -1)]).astype(np.int32))], ["doc", "number"]
            )

    found = judged.mapInArrow(areas, f"doc {docs.schema['doc'].dataType.simpleString()}, number int").groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    each = F.explode(F.when(F.size("numbers") > 1, F.filter("numbers", lambda x: x >= 0)).otherwise(F.col("numbers")))
    names = F.array(*[F.lit(s) for s in own]).cast("array<string>")
    return found.select("doc", each.alias("number")).select("doc", F.when(F.col("number") >= 0, F.get(names, F.col("number"))).otherwise(none).alias("subject"))


def _frames(marked: DataFrame, part: float, n: int) -> DataFrame:
    """(gram, n, agreeing): pairs of neighbouring words, in how many sentences with a subject they stand, and in how many of
    those the subject holds for enough of the document's other sentences. Documents with few such sentences can't tell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined(sums(_Batch(b)) for b in batches if b.num_rows)

    def sums(b: _Batch) -> tuple[list[np.ndarray], np.ndarray]:
        told = np.flatnonzero(b.best >= 0)
        doc = b.sentence_doc[told]
        others = np.bincount(doc, minlength=b.n_docs) - 1
        same = np.bincount(doc * n + b.best[told], minlength=b.n_docs * n)[doc * n + b.best[told]] - 1
        agrees = np.full(len(b.length), -1)
        agrees[told] = np.where(others[doc] >= 3, same >= np.maximum(1, others[doc] * part), -1)
        at = _whole(b.ends, 2)
        at = at[agrees[b.word_sentence[at]] >= 0]
        (sentence, grams), _ = _summed([b.word_sentence[at], shingle_hashes(b.words, 2)[at].view(np.int64)], np.ones(len(at)))
        return _summed([np.zeros(len(grams), np.int64), grams, agrees[sentence]], np.ones(len(grams)))

    each = marked.mapInArrow(count, SUMS)
    return each.groupBy("gram").agg(F.sum("value").alias("n"), F.sum(F.when(F.col("part") == 1, F.col("value")).otherwise(0.0)).alias("agreeing"))
