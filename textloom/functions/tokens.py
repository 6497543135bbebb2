"""Sliding windows over tokens. The tokenizer is pluggable; the default reads a byte-level BPE vocabulary from a path."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text ahead of merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
Codec = tuple[Callable[[str], list], Callable[[list], str]]


def byte_bpe(vocabulary: str = VOCABULARY) -> Codec:
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("bpe", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    return encoder.encode_ordinary, encoder.decode


def words_codec() -> Codec:
    """Runs of non-blanks as tokens, for use without a vocabulary."""
    return lambda text: re.findall(r"\S+", text), " ".join


def token_windows(text: str | None, codec: Codec, size: int, stride: int) -> list[str]:
    """Windows of `size` tokens, every `stride` tokens; a text of at most `size` is one window, unchanged; the last tokens
    form one more window if they aren't reached, unless it reads like the one before. Blank texts have none."""
    if not text or not text.strip():
        return []
    encode, decode = codec
    tokens = encode(text)
    if len(tokens) <= size:
        return [text]
    found = [decode(tokens[i : i + size]) for i in range(0, len(tokens) - size + 1, stride)]
    if (len(tokens) - size) % stride:
        last = decode(tokens[-size:])
        found += [last] if last != found[-1] else []
    return found


def explode_token_windows(texts: DataFrame, key: str, text: str, size: int = 256, stride: int = 192, load: Callable[[], Codec] = byte_bpe) -> DataFrame:
    """(key, window_index, window_text); narrow. `load` makes the tokenizer, once per task."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load()
        for batch in batches:
            yield pd.Series([token_windows(x, codec, size, stride) for x in batch])

    return texts.select(key, F.posexplode(cut(F.col(text))).alias("window_index", "window_text"))
