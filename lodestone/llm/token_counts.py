"""Token counts without token ids.

A piece of the vocabulary never continues over the start of a word, so a text's count is the sum over its
pre-tokens (a run of word marks and what follows up to the next mark). Each block of documents is reduced to
per-document pre-token frequencies; the distinct pre-tokens that the worker hasn't met yet are counted by the
library in one call; frequencies and counts are joined by pre-token and summed. No ids are kept or returned.

The join is made inside the worker's block: over the cluster it would move a row for each document and distinct
word, more than the texts themselves, for counts that cost the library a few microseconds each.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import blocks

CACHE_WORDS, CACHE_CHARS = 600_000, 64
MARK = "▁"  # stands for a blank in the library's pieces
PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class PieceCounter:
    """Counts a model's pieces per pre-token, each distinct one once (as long as the bounded cache keeps it)."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in p.lstrip(MARK) for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))):
            raise ValueError("pieces of this model cross word starts: its texts can't be counted by words")
        self.known: dict[str, int] = {}
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a lone mark at the end of a text

    def frequencies(self, text: str) -> Counter:
        """Pre-tokens without their first mark, which the library puts before every text."""
        if not text:
            return Counter()
        if text[0] != " " and "  " not in text and MARK not in text:
            return Counter(text.split(" "))
        return Counter(p[1:] for p in PRETOKEN.findall(MARK + text.replace(" ", MARK)))

    def counts(self, texts: list[str]) -> list[int]:
        bags = [self.frequencies(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = list(set().union(*bags).difference(known))
        table = dict(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True)) if new else {}
        if "" in table:
            table[""] = self.alone
        known.update((w, n) for w, n in table.items() if len(w) <= CACHE_CHARS)
        table = {w: n for w, n in table.items() if len(w) > CACHE_CHARS}
        return [sum(n * (known[w] if w in known else table[w]) for w, n in bag.items()) for bag in bags]


@cache
def counter(path: str) -> PieceCounter:
    try:
        return PieceCounter(path)
    except OSError:
        return PieceCounter(SparkFiles.get(path.rpartition("/")[2]))


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole; repeated rows stay repeated; columns
    of these names are replaced; an empty table stays empty."""

    def make():
        c = counter(path)

        def work(texts):
            n = c.counts(texts)
            return [[len(t.encode("utf-8", "surrogatepass")) for t in texts], n]

        return work

    out = blocks.add_columns(df, text_col, {"n_bytes": T.LongType(), "n_tokens": T.LongType()}, make, keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
