"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (over UTF-8 bytes, with word boundaries), hashed to a table of
embeddings, so an unseen misspelling shares most of its vectors with the word it hides. A window of words is the
average of its words' averages; a softmax over two classes gives the window's probability, and a document is
toxic unless all its windows are clean (noisy or). Windows keep one insult as visible in a text of 20,000 words
as in one of 30. Embeddings and softmax are trained together by gradient steps on the likelihood of the documents' labels.

Training takes a bounded sample of labelled documents (``MAX_POSITIVE`` and ``MAX_NEGATIVE`` rows, chosen by a
hash of the id, and at most ``MAX_BYTES`` of text); scoring covers every whole text. Scoring needs only the difference of the two classes' logits
for each table entry, ``BUCKETS`` numbers, which is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import blocks, words
from lodestone.llm.shared import fresh, sampled

GRAMS, BUCKET_BITS, DIM, WINDOW = (3, 5, 7), 18, 8, 2
BUCKETS = 1 << BUCKET_BITS
MAX_POSITIVE, MAX_NEGATIVE = 2_000, 4_000
MAX_BYTES = 64 << 20  # of the sample's texts together; the rows beyond it, by the hash of their ids, aren't learned from
STEPS, RATE, MIN_COUNT = 120, 0.25, 5
START = 4.0  # half the logit at which an untrained window counts as clean
BLOCK_CHARS = 1_000_000


@dataclass
class Model:
    weights: np.ndarray  # difference of the classes' logits for each n-gram bucket
    bias: float


@dataclass
class Bags:
    """The distinct words of some texts, and the texts as windows over their distinct words.

    A word that a text repeats counts once, where it first occurs: a word repeated a hundred times is one word."""

    data: np.ndarray  # bytes of all texts
    first: np.ndarray  # where each distinct word's bytes begin
    size: np.ndarray  # and how many they are
    hashes: np.ndarray
    word: np.ndarray  # numbers of distinct words, in text order
    window_starts: np.ndarray  # in ``word``
    windows_upto: np.ndarray  # windows before the end of each text

    def grams(self, words_at_once: int = 40_000):
        """(number of the distinct word, bucket of one of its n-grams), some words at a time."""
        for i in range(0, len(self.first), words_at_once):
            first, size = self.first[i : i + words_at_once], self.size[i : i + words_at_once]
            # the words' bytes side by side, each between two boundary marks
            starts = np.cumsum(np.append(0, size + 2))
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(np.append(0, size[:-1])), size)
            flat = np.zeros(starts[-1], np.uint8)
            flat[np.repeat(starts[:-1] + 1, size) + inner] = self.data[np.repeat(first, size) + inner]
            letters = words._letters()[flat]
            left = np.repeat(starts[1:], size + 2) - np.arange(starts[-1])  # bytes from here to the word's end
            owner = np.repeat(np.arange(i, i + len(first), dtype=np.int32), size + 2)
            yield np.arange(i, i + len(first), dtype=np.int32), _bucket(self.hashes[i : i + words_at_once])  # the word itself
            h = np.zeros(len(flat), np.uint64)
            for n in range(1, min(max(GRAMS), len(flat)) + 1):
                h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + letters[n - 1 :]
                if n in GRAMS:
                    here = np.flatnonzero(left[: len(h)] >= n)
                    yield owner[here], _bucket(h[here] + np.uint64(n))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (words.mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def bags(texts: list[str]) -> Bags:
    data, first, last, upto = words.spans(texts)
    found, at, word = np.unique(words.span_hashes(data, first, last), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
    firsts = np.sort(np.unique(doc * len(at) + word, return_index=True)[1])
    word, upto = word[firsts].astype(np.int32), np.searchsorted(firsts, upto)
    per = -(-np.diff(upto, prepend=0) // WINDOW)
    begin = np.repeat(np.append(0, upto[:-1]), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(np.append(0, per[:-1])), per)
    return Bags(data, first[at], last[at] - first[at], found, word, begin + nth * WINDOW, np.cumsum(per))


def _joined(parts: Iterable[Bags]) -> Bags:
    """The bags of consecutive blocks as one, with the bytes of distinct words only."""
    seen = np.zeros(0, np.uint64)
    data, sizes, hashes, word, starts, upto = [], [], [], [], [], []
    n_words = n_windows = 0
    for b in parts:
        new = np.flatnonzero(~np.isin(b.hashes, seen, assume_unique=True))
        size = b.size[new]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(np.append(0, size))[:-1], size)
        data.append(b.data[np.repeat(b.first[new], size) + inner])
        sizes.append(size)
        hashes.append(b.hashes[new])
        word.append(b.hashes[b.word])
        starts.append(b.window_starts + n_words)
        upto.append(b.windows_upto + n_windows)
        n_words, n_windows = n_words + len(b.word), n_windows + len(b.window_starts)
        seen = np.union1d(seen, b.hashes[new])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    size, order = join(sizes), np.argsort(join(hashes))
    first = np.cumsum(np.append(0, size))[:-1]
    number = np.concatenate([np.searchsorted(seen, w).astype(np.int32) for w in word]) if word else np.zeros(0, np.int32)
    return Bags(join(data), first[order], size[order], seen, number, join(starts), join(upto))


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(starts, append=len(values))
    return np.add.reduceat(values, starts, axis=0) / (n if values.ndim == 1 else n[:, None])


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of the toxic class; a text without words has the probability of an empty window."""
    b = bags(texts)
    out = np.full(len(texts), 1 / (1 + np.exp(-model.bias)))
    if len(b.word):
        total, count = np.zeros(len(b.first)), np.zeros(len(b.first))
        for owner, grams in b.grams():
            total += np.bincount(owner, model.weights[grams], len(total))
            count += np.bincount(owner, minlength=len(count))
        per_word = total / count
        logit = _means(per_word[b.word], b.window_starts) + model.bias
        clean = -np.logaddexp(0, logit)  # log probability that the window is clean
        some = np.diff(b.windows_upto, prepend=0) > 0
        total = np.add.reduceat(clean, np.append(0, b.windows_upto[:-1])[some])
        out[some] = -np.expm1(total)
    return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 7) -> Model:
    """``train_blocks`` on a list of texts."""
    return train_blocks((block for _, block in blocks.text_blocks(texts, BLOCK_CHARS)), labels, prior, seed)


def train_blocks(texts: Iterable[list[str]], labels: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Fit embeddings and softmax together. ``prior``: share of toxic documents where the model will be used.

    The loss depends on an embedding only through its product with the difference of the softmax's two columns,
    so gradients are formed as one number per n-gram and spread over the dimensions by that difference. An n-gram's
    gradient is measured by the root of its number, and steps have a common scale for all embeddings, so that what
    speaks for a class moves far and chance hardly. Each
    eighth document chooses the step at which training stops."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        p = float(np.clip(prior, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    b = _joined(map(bags, texts))
    n_words = np.diff(b.window_starts, append=len(b.word))
    uses = np.bincount(b.word, minlength=len(b.first))  # documents with the word
    n_grams, seen = np.zeros(len(b.first)), np.zeros(BUCKETS)
    for owner, grams in b.grams():
        n_grams += np.bincount(owner, minlength=len(n_grams))
        seen += np.bincount(grams, uses[owner], BUCKETS)
    used = np.flatnonzero(seen >= MIN_COUNT)  # rarer n-grams are left at zero
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    kept = [(owner[keep], number[grams[keep]]) for owner, grams in b.grams() for keep in [number[grams] >= 0]]
    b.data = b.hashes = None
    per_doc = np.diff(b.windows_upto, prepend=0)
    doc, window_of = np.repeat(np.arange(len(labels)), per_doc), np.repeat(np.arange(len(n_words)), n_words)
    some, doc_starts = per_doc > 0, np.append(0, b.windows_upto[:-1])
    check = np.arange(len(labels)) % 8 == 7
    weight = np.where(labels > 0, prior / labels.mean(), (1 - prior) / (1 - labels.mean())) / len(labels)
    fit_weight = np.where(check, 0.0, weight)

    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.02, (len(used), DIM)), rng.normal(0, 1, (DIM, 2)), np.array([START, -START], np.float64)
    params, speed = [emb, soft, bias], [np.zeros_like(emb), np.zeros_like(soft), np.zeros_like(bias)]
    root = np.sqrt(seen[used])  # what chance makes of an n-gram's gradient grows with the root of its number
    best, model = np.inf, None
    for step in range(STEPS):
        diff = soft[:, 1] - soft[:, 0]
        unit = emb @ diff
        per_word = np.zeros(len(n_grams))
        for owner, gram in kept:
            if len(owner):
                low = owner.min()
                part = np.bincount(owner - low, unit[gram])
                per_word[low : low + len(part)] += part
        per_word /= n_grams
        logit = np.add.reduceat(per_word[b.word], b.window_starts) / n_words + bias[1] - bias[0]
        log_clean = np.zeros(len(labels))
        log_clean[some] = np.add.reduceat(-np.logaddexp(0, logit), doc_starts[some])
        toxic = np.clip(-np.expm1(log_clean), 1e-6, 1 - 1e-6)
        loss = -np.where(labels > 0, np.log(toxic), np.log1p(-toxic)) * weight
        if loss[check].sum() < best:
            weights = np.zeros(BUCKETS, np.float32)
            weights[used] = unit
            best, model = loss[check].sum(), Model(weights, float(bias[1] - bias[0]))
        slope = np.where(labels > 0, -(1 - toxic) / toxic, 1.0) * fit_weight
        g = slope[doc] * np.exp(-np.logaddexp(0, -logit))  # of each window's logit
        g_word = np.bincount(b.word, (g / n_words)[window_of], len(n_grams)) / n_grams
        g_unit = sum(np.bincount(gram, g_word[owner], len(used)) for owner, gram in kept)
        g_soft = emb.T @ g_unit
        grads = [np.outer(g_unit / root, diff), np.stack([-g_soft, g_soft], axis=1), np.array([-g.sum(), g.sum()])]
        for x, dx, v, rate in zip(params, grads, speed, (RATE, RATE / 4, RATE / 4), strict=True):
            v *= 0.8
            v += 0.2 * dx / (np.sqrt(np.mean(dx * dx)) + 1e-12)
            x -= rate * (1 - step / STEPS) * v
    return model


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled documents that aren't held out.

    Labels are (id, label); null labels and ids are ignored, several labels of one id count as toxic if any is. Of rows
    that share an id the longest text is learned from; null texts are empty. Without two classes of labelled texts, as
    in an empty table, every text gets the share of toxic labels. Other columns are ignored."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y"))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    take = lambda y, n: sampled(known.filter(F.col("_y") == y), n, sizes.get(y, 0), "_id")
    chosen = take(1, MAX_POSITIVE).unionByName(take(0, MAX_NEGATIVE))  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    lengths = rows.select("_id", F.octet_length("_text").alias("_n")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.max("_n").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(F.xxhash64(F.lit(12), "_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = lengths.withColumn("_upto", upto).filter(F.col("_upto") <= MAX_BYTES).select("_id", "_y")
    rows = rows.join(F.broadcast(fitting), "_id").groupBy("_id", "_y").agg(F.max(F.struct(F.octet_length("_text").alias("n"), "_text")).alias("_t"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = pc.sort_indices(table.column("_id"))
        texts = table.column("_text").take(order).combine_chunks()
        model = train_blocks((part for _, part in blocks.arrow_blocks(texts, BLOCK_CHARS)), table.column("_y").take(order).to_numpy(), share)
        return pa.table({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    # one task of an executor trains on the bounded sample; only the weights come to the driver
    made = rows.select("_id", "_y", "_t._text").groupBy(F.lit(0).alias("_all")).applyInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(made["weights"], "<f4"), made["bias"]) if made else train([], np.zeros(0), share)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``df`` with ``out``, the probability of the toxic class from the whole text and nothing else.

    Null and empty texts and texts without words get the score of an empty window. Repeated rows get equal
    scores; an existing column ``out`` is replaced; an empty table stays empty."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda texts: [score_texts(m, texts)]

    return blocks.add_columns(df, text_col, {out: T.DoubleType()}, make, keep, BLOCK_CHARS)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with the input's columns, whatever their names."""
    name = fresh(df, "score")
    scored = score(df, fit(df, labels, id_col, text_col), text_col, out=name)
    return scored.filter(F.col(name) < threshold).drop(name)
