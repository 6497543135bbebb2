"""Annotators: where a window's text becomes structured values.

A provider answers prompts. The default one follows fixed rules, so results don't vary; a recorded one looks replies up by
the prompt's hash, which is a join; a remote one calls a server from the executors, a batch at a time. Failures are values in
the error column, never failed tasks; deterministic filters belong ahead of this stage, as they aren't pushed through it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.rules import object_text, without_thinking
from textloom.operators.keyed import join_groups


class Provider(Protocol):
    def generate(self, prompt: str, system: str | None = None) -> str: ...


class RuleProvider:
    """Replies in JSON by rules on the text after the last line "TEXT:". The task is named in the prompt's first line."""

    #: Cues the rules look for.
    SIMILE = re.compile(r"\b(?:like|as \w+ as) an? [\w' -]+", re.I)
    CAUSE = re.compile(r"(?P<source>[\w' -]{3,60}?)\s+(?P<type>causes|caused|leads to|led to|increases|reduces|prevents|affects)\s+(?P<target>[\w' -]{3,60})", re.I)
    NAME = re.compile(r"\b[A-Z][\w'-]+(?: [A-Z][\w'-]+)*")
    REASON = re.compile(r"\b(?:because|due to|given|since)\s+(?P<factor>[^.;]+)", re.I)

    def generate(self, prompt: str, system: str | None = None) -> str:
        task, _, text = prompt.partition("\n")[0], None, prompt.rpartition("TEXT:\n")[2]
        return json.dumps(getattr(self, f"_{task.strip().lower().replace(' ', '_')}", self._summary)(text))

    def _summary(self, text: str) -> dict:
        return {"summary_points": [p.strip()[:80] for p in re.split(r"(?<=[.!?])\s+", text)[:3] if p.strip()]}

    def _figurative(self, text: str) -> dict:
        found = [{"text": m[0].strip(), "type": "simile", "confidence": 0.7, "explanation": "a comparison"} for m in self.SIMILE.finditer(text)]
        return {"has_figurative": bool(found), "confidence": 0.7 if found else 0.1, "instances": found}

    def _entities(self, text: str) -> dict:
        return {"entities": list(dict.fromkeys(self.NAME.findall(text)))}

    def _relationships(self, text: str) -> dict:
        rows = [{k: v.strip() for k, v in m.groupdict().items()} | {"description": m[0].strip()} for m in self.CAUSE.finditer(text)]
        return {"relationships": rows}

    def _decisions(self, text: str) -> dict:
        return {"decisions": [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\b(?:decided|will|agreed|plan(?:ned)?)\b", s, re.I)]}

    def _factors(self, text: str) -> dict:
        return {"factors": [{"factor": m["factor"].strip(), "polarity": "supporting"} for m in self.REASON.finditer(text)]}

    def _causal(self, text: str) -> dict:
        return {"is_causal": bool(self.CAUSE.search(text)), "polarity": "neutral", "certainty": "possible", "explicit_vs_implicit": "explicit"}

    def _verify(self, text: str) -> dict:
        sure = lambda x: 0.9 if x.strip() else 0.0
        claims = list(re.finditer(r"^CLAIM (\d+): ", text, re.M))
        if not claims:
            return {"confidence": sure(text), "note": ""}
        return {"verdicts": [{"index": int(m[1]), "confidence": sure(text[m.end() :]), "note": ""} for m in claims]}

    def _score(self, text: str) -> dict:
        """A score for each dimension named ahead of the line "ENTITY:", within its scale, told by the letters behind it."""
        head, _, subject = text.partition("ENTITY:\n")
        asked = re.findall(r"^DIMENSION: (.+)\n(?:.*\n)*?Scale: (-?\d+) to (-?\d+)$", head, re.M)
        told = sum(map(ord, subject or text))
        found = {d: {"score": int(a) + (told + sum(map(ord, d))) % (int(b) - int(a) + 1), "justification": "by rule"} for d, a, b in asked}
        return found or {"score": told % 101, "justification": "by rule"}

    def _domains(self, text: str) -> dict:
        """What is spoken of comes first, what it is seen as comes last."""
        words = [w for w in re.findall(r"[^\W\d_]+", text.partition("\n")[0].lower()) if w not in ("a", "an", "the")]
        return {"source_domain": words[-1], "target_domain": words[0], "confidence": "medium"} if len(words) > 1 else {"source_domain": "", "target_domain": "", "confidence": "low"}

    def _name(self, text: str) -> dict:
        """The shortest of the listed labels, the first in the alphabet of those."""
        return {"label": min((x for x in text.split("\n") if x.strip()), key=lambda x: (len(x), x), default="")}

    def _coreference(self, text: str) -> dict:
        return {"resolved_text": text}


class HttpProvider:
    """A local server with an /api/generate route. A call that fails is made `retries` more times, after growing pauses; what
    fails then is an error value. `options` go to the server, such as temperature or the number of tokens."""

    def __init__(self, model: str, url: str = "http://localhost:11434", timeout: float = 60.0, as_json: bool = True, options: dict | None = None, retries: int = 2, pause: float = 0.5) -> None:
        self.model, self.url, self.timeout, self.as_json = model, url, timeout, as_json
        self.options, self.retries, self.pause = options or {}, retries, pause

    def generate(self, prompt: str, system: str | None = None) -> str:
        import time
        import urllib.request

        body = {"model": self.model, "prompt": prompt, "stream": False, "system": system, "options": self.options or None} | ({"format": "json"} if self.as_json else {})
        data = json.dumps({k: v for k, v in body.items() if v is not None}).encode()
        for left in range(self.retries, -1, -1):
            try:
                request = urllib.request.Request(f"{self.url}/api/generate", data, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read())["response"]
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause * 2 ** (self.retries - left))
        raise AssertionError


# What each task asks for; our own wording.
PROMPTS = {
    "summary": "Give up to three short points that say what the text is about. Answer as JSON: {\"summary_points\": [..]}.",
    "figurative": "Say whether the text holds figurative language and list each instance with text, type, confidence and explanation. Answer as JSON: {\"has_figurative\": .., \"confidence\": .., \"instances\": [..]}.",
    "entities": "List the entities the text names. Answer as JSON: {\"entities\": [..]}.",
    "relationships": "List relationships between entities with source, target, type and description. Answer as JSON: {\"relationships\": [..]}.",
    "decisions": "List the decisions the text reports. Answer as JSON: {\"decisions\": [..]}.",
    "factors": "List what spoke for or against the decision, with factor and polarity. Answer as JSON: {\"factors\": [..]}.",
    "causal": "Say whether the relationship is causal, its polarity, certainty and whether it is explicit. Answer as JSON.",
    "verify": "Say how surely the text supports the relationship. Answer as JSON: {\"confidence\": .., \"note\": ..}.",
    "domains": "Name the domain that is spoken of (target) and the one it is seen as (source). Answer as JSON: {\"source_domain\": .., \"target_domain\": .., \"confidence\": ..}.",
    "name": "Give one label that stands for all of these. Answer as JSON: {\"label\": ..}.",
    "coreference": "Replace pronouns by what they stand for and change nothing else. Answer as JSON: {\"resolved_text\": ..}.",
    "score": "Score the entity on each dimension, in whole numbers of the scale, with a justification. Answer as JSON.",
}


def load_prompt(task: str, custom_path: str | None = None) -> str:
    """The task's wording, or that of a file."""
    if custom_path:
        with open(custom_path, encoding="utf-8") as f:
            return f.read()
    return PROMPTS[task]


def prompt(task: str, text: Column, context: Column | None = None, template: str | None = None) -> Column:
    """First line the task, then the wording, earlier context if any, and the text behind "TEXT:"."""
    head = F.lit(f"{task}\n{template or PROMPTS[task]}\n")
    before = F.when(F.size(context) > 0, F.concat(F.lit("CONTEXT:\n"), F.array_join(context, "\n"), F.lit("\n"))).otherwise("") if context is not None else F.lit("")
    return F.concat(head, F.coalesce(before, F.lit("")), F.lit("TEXT:\n"), F.coalesce(text, F.lit("")))


def annotate(rows: DataFrame, asked: Column, provider: Provider, system: str | None = None) -> DataFrame:
    """Add reply and error (null where all went well). Rows keep their partitions; a batch goes to Python at a time."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch:
                try:
                    out.append((provider.generate(p, system), None))
                except Exception as e:  # noqa: BLE001 - a failed call is a value
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["reply", "error"])

    asked_rows = rows.withColumn("_answer", ask(asked))
    return asked_rows.withColumns({"reply": without_thinking(F.col("_answer.reply")), "error": F.col("_answer.error")}).drop("_answer")


def annotate_recorded(rows: DataFrame, asked: Column, recorded: DataFrame) -> DataFrame:
    """The same from recorded replies (prompt_hash, reply), hash as prompt_hash gives it; a missing one is an error."""
    keyed = rows.withColumn("prompt_hash", prompt_hash(asked))
    found = join_groups(keyed, recorded.select("prompt_hash", "reply"), ["prompt_hash"], "left")
    return found.withColumn("error", F.when(F.col("reply").isNull(), "not recorded")).drop("prompt_hash")


def prompt_hash(asked: Column) -> Column:
    return F.sha2(asked, 256)


SCHEMAS = {
    "summary": "summary_points array<string>, summary string",
    "figurative": "has_figurative boolean, confidence double, instances array<struct<text:string,type:string,confidence:double,explanation:string,context_dependent:boolean>>",
    "entities": "entities array<string>",
    "relationships": "relationships array<struct<source:string,target:string,type:string,description:string>>",
    "decisions": "decisions array<string>",
    "factors": "factors array<struct<factor:string,polarity:string,confidence:double>>",
    "causal": "is_causal boolean, polarity string, certainty string, explicit_vs_implicit string, reasoning string",
    "verify": "confidence double, note string, verdicts array<struct<index:int,confidence:double,note:string>>",
    "name": "label string",
    "coreference": "resolved_text string",
}


def parse(rows: DataFrame, task: str, reply: str = "reply") -> DataFrame:
    """Add `parsed`, the reply's object as the task's struct, and `parse_failed`. A bare array stands for the task's list."""
    inside = F.from_json(object_text(F.col(reply)), SCHEMAS[task])
    return rows.withColumn("parsed", inside).withColumn("parse_failed", F.col(reply).isNotNull() & object_text(F.col(reply)).isNull())


def parse_scores(rows: DataFrame, dimensions: list[str], scales: dict[str, tuple[int, int]], reply: str = "reply") -> DataFrame:
    """One row per dimension of replies that are whole: each dimension a whole number within its scale (80.0 counts, true and
    "80" don't), nothing else. One missing or bad dimension drops the run."""
    members = F.from_json(object_text(F.col(reply)), "map<string,string>")
    value = lambda d: F.try_element_at(members, F.lit(d))
    raw = lambda d: F.coalesce(F.get_json_object(value(d), "$.score"), value(d))
    number = lambda d: F.when(raw(d).rlike(r"^-?\d+(\.0+)?$"), raw(d).cast("double").cast("int"))
    good = [number(d).between(*scales[d]) for d in dimensions]
    known = F.size(F.array_except(F.map_keys(members), F.array(*[F.lit(d) for d in dimensions]))) == 0
    whole = rows.where(F.coalesce(known, F.lit(False)))
    for g in good:
        whole = whole.where(F.coalesce(g, F.lit(False)))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), number(d).alias("score"), F.coalesce(F.get_json_object(value(d), "$.justification"), F.lit("")).alias("justification")) for d in dimensions]))
    return whole.withColumn("_x", each).select(*rows.columns, "_x.*")


def score_examples(low: float, high: float) -> list[int]:
    """Example scores at 50, 60, 75, 85 and 90 percent of the scale."""
    return [round(low + (high - low) * p) for p in (0.5, 0.6, 0.75, 0.85, 0.9)]


@dataclass(frozen=True)
class Dimension:
    """What is scored: a name, what it means, its scale, and what the ends of the scale stand for."""

    name: str
    meaning: str = ""
    low: int = 0
    high: int = 100
    low_anchor: str = ""
    high_anchor: str = ""


def score_prompt(dimensions: Sequence[Dimension], subject: Column, research: dict[str, str] | None = None) -> Column:
    """The prompt of a scoring task: every dimension with meaning, scale and anchors, the scale in words with examples that
    fit it, what the research is about, and the subject."""
    lines = []
    for d in dimensions:
        lines += [f"DIMENSION: {d.name}"] + [f"Meaning: {d.meaning}"] * bool(d.meaning) + [f"Scale: {d.low} to {d.high}"]
        lines += [f"{d.low} stands for: {d.low_anchor}"] * bool(d.low_anchor) + [f"{d.high} stands for: {d.high_anchor}"] * bool(d.high_anchor) + [""]
    scales = {(d.low, d.high) for d in dimensions}
    if len(scales) == 1:
        (low, high), = scales
        lines.append(f"Use whole numbers from {low} to {high}, for example {', '.join(map(str, score_examples(low, high)))}.")
    else:
        lines.append("Use whole numbers of each dimension's own scale.")
    lines += [f"{k}: {v}" for k, v in (research or {}).items() if v]
    return prompt("score", F.concat(F.lit("\n".join(lines) + "\nENTITY:\n"), F.coalesce(subject, F.lit(""))))


def balanced(text: str | None) -> str | None:
    """The first balanced {...} or [...] of a reply, minding strings and escapes; None if there is none, or
    a bracket closes one of the other kind."""
    start = next((i for i, c in enumerate(text or "") if c in "{["), None)
    if start is None:
        return None
    open_, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if c != open_.pop():
                return None
            if not open_:
                return text[start : i + 1]
    return None


def balanced_json(reply: Column) -> Column:
    """`balanced` as a column; an Arrow UDF, as nesting is beyond regular expressions."""

    @F.pandas_udf("string")
    def find(replies: pd.Series) -> pd.Series:
        return pd.Series([balanced(r) for r in replies], dtype=object)

    return find(reply)
