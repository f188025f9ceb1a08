"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and word pairs of all training documents. Workers combine the counts of millions of tokens
before they leave, packed by range of the hash; each range is merged in one task of bounded size. A count c is
quantised to level 1 + floor(log_BASE(c / cutoff)), and an n-gram of level q enters the Bloom filter as the q
items (n-gram, 1) ... (n-gram, q). The filter is made range by range, so its parts need no merging, and is
has ``BITS`` bits for each stored item at every size of input, so its error rate stays the same and its size grows
with the number of items. The bits of an item lie in one block of 512, so a probe touches one cache line.

The filter is broadcast as long as it stays below ``MAX_FILTER_BYTES``. Beyond that its ranges stay where they are:
blocks of texts send their distinct keys to the ranges and get the levels back, so no task holds more than one range
of the filter, whatever the size of the corpus.

Scoring probes (n-gram, 1), (n-gram, 2), ... until one is missing; the level reached gives the count. The
probability of a word is an interpolation, P(w|h) = l * c(hw) / c(h) + (1 - l) * P(w), whose weight l depends on
the level of the context's count and is learned by deleted interpolation on all training documents: a probability
depends on the levels of context, pair and word only. So the filter is probed once, the levels of each text's
words and pairs are kept (a byte each), the weights are learned from the tokens of each combination of levels, and
scores are sums over the kept levels.

Beside it runs the exact add-one unigram model (``base_score``). Its counts must be exact, and the vocabulary
has no bound, so the most frequent words (at most ``HEAD_WORDS``) are broadcast, which covers most tokens and
every hot word, and the rest meet their counts in a join.
"""

from __future__ import annotations

import pickle
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm import blocks, words
from lodestone.llm.shared import drop_written, written

BASE, PAIR_CUTOFF = 1.5, 1  # quantisation; every pair is stored
LEVELS = 129  # 0 for what isn't stored, and more than a 64-bit count can reach
BITS, HASHES = 12, 5
MAX_FILTER_BYTES = 256 << 20  # up to which the filter is broadcast
HEAD_WORDS = 1 << 20
RANGE_BYTES = 8 << 20  # bytes of text for each hash range
FLUSH_TOKENS, BLOCK_CHARS = 2_000_000, 1_000_000
ASK_CHARS = 4_000_000  # of a block that asks the ranges: larger blocks share more keys and send fewer messages
END, START = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000B0)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def held_out(id_col: Column) -> Column:
    """Rows that aren't learned from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes of the tokens before them, number of tokens of each text); each text ends with END."""
    h, upto = words.word_hashes(texts)
    out = np.insert(h, upto, END)
    size = np.diff(upto, prepend=0) + 1
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.cumsum(size) - size] = START
    return out, before, size


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """48-bit keys of word pairs."""
    return words.mix(before * _PAIR + token) >> np.uint64(16)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences, all lowest bytes first: what lies above the differences is zeros, which the shuffle's compression removes."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def levels(counts: np.ndarray, cutoff: int) -> np.ndarray:
    """0 below the cutoff, else 1 + floor(log_BASE(count / cutoff))."""
    q = np.floor(np.log(np.maximum(counts, 1) / cutoff) / np.log(BASE) + 1e-9).astype(np.int64) + 1
    return np.where(counts >= cutoff, q, 0)


def level_counts(cutoff: int, n: int = 128) -> np.ndarray:
    """The count that each level stands for: the geometric mean of its smallest and largest."""
    low = np.ceil(cutoff * BASE ** np.arange(n) - 1e-9)
    high = np.maximum(low, np.ceil(cutoff * BASE ** np.arange(1, n + 1) - 1e-9) - 1)
    return np.concatenate([[0.0], np.sqrt(low * high)])


def _positions(item: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bit of each item's block, a number whose groups of 9 bits say which bits of the block are the item's)."""
    block = ((item >> np.uint64(32)) * (bits >> np.uint64(9))) >> np.uint64(32)
    return (block << np.uint64(9)).astype(np.int64), words.mix(item)


def _bit(within: np.ndarray, i: int) -> np.ndarray:
    return ((within >> np.uint64(9 * i)) & np.uint64(511)).astype(np.int64)


def _items(key: np.ndarray, level: int) -> np.ndarray:
    return words.mix(key * np.uint64(2) + np.uint64(level * 0xA24BAED4963EE407 % (1 << 64)))


@dataclass
class Filter:
    """Bits of all ranges one after the other. Words and pairs are told apart by their keys' last bit."""

    bits: np.ndarray
    starts: np.ndarray  # first bit of each range; one more at the end
    top: int = LEVELS - 1  # the largest stored level; what seems to be above it is a false positive

    def level(self, key: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The highest level of each key, by probing one level after the other; ``spread`` (0 to 1) names the range."""
        part = np.minimum((spread * (len(self.starts) - 1)).astype(np.int64), len(self.starts) - 2)
        start, size = self.starts[part], (self.starts[part + 1] - self.starts[part]).astype(np.uint64)
        out, live = np.zeros(len(key), np.int64), np.flatnonzero(size > 0)
        key, start, size = key[live], start[live], size[live]
        for level in range(1, self.top + 1):
            if not len(live):
                break
            block, within = _positions(_items(key, level), size)
            block += start
            hit = np.ones(len(live), bool)
            for i in range(HASHES):
                at = block + _bit(within, i)
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if i == 1:  # most of what is missing shows by now
                    block, within, key, start, size, live, hit = (x[hit] for x in (block, within, key, start, size, live, hit))
            key, start, size, live = (x[hit] for x in (key, start, size, live))
            out[live] = level
        return out


def _sent_bits(sent: Broadcast) -> np.ndarray:
    """Broadcast bytes as numbers, mapped from the file in which they came: a machine's workers share it and none holds a copy."""
    path = getattr(sent, "_path", None)
    if path and not hasattr(sent, "_value"):
        with open(path, "rb") as f:
            head = f.read(64)
            size = f.seek(0, 2)
        at = head.find(b"\x96") + 1  # the opcode of a bytearray, its length in 8 bytes and its contents
        n = struct.unpack_from("<Q", head, at)[0] if 0 < at <= len(head) - 8 else 0
        if n and at + 8 + n <= size <= at + 8 + n + 64:
            return np.asarray(np.memmap(path, np.uint8, "r", at + 8, (n,)))
    return np.frombuffer(sent.value, np.uint8)  # small, or encrypted on its way


def word_key(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h | np.uint64(1), h / 2.0**64


def pair_key(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return k << np.uint64(1), k / 2.0**48


@dataclass
class Model:
    counts: Filter | None  # None where the filter is too large to be broadcast
    ranges: DataFrame | None  # its ranges as a table (part, bits), at the driver only
    n: int  # training tokens
    v: int  # distinct ones
    docs: int
    top: int  # the largest stored level
    weights: np.ndarray  # of the pair estimate, by level of the context's count
    head: np.ndarray  # hashes of the most frequent words, sorted
    head_counts: np.ndarray

    def _estimates(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(pair estimate, word estimate) for the levels of context, pair and word."""
        words_, pairs = level_counts(1), level_counts(PAIR_CUTOFF)
        count, context, pair = words_[word], words_[context], pairs[pair]
        if less:  # as if this occurrence hadn't been counted
            pair = np.where(pair - less >= PAIR_CUTOFF, pair - less, 0.0)
            count, context = np.maximum(count - less, 0), np.maximum(context - less, 1)
        return np.minimum(1.0, pair / np.maximum(context, 1.0)), (count + 1) / (self.n + self.v + 1)

    def contexts(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Levels of the tokens before, from the words' levels and where texts begin."""
        out = np.roll(word, 1)
        out[first] = levels(np.array([self.docs]), 1)[0]
        return out

    def learn_weights(self, codes: np.ndarray, n: np.ndarray) -> None:
        """Deleted interpolation: expectation maximisation over tokens, ``n`` of each code, each left out of its own counts."""
        if not len(codes):
            return
        level = codes // LEVELS**2
        seen, single = self._estimates(level, codes // LEVELS % LEVELS, codes % LEVELS, 1)
        total = np.bincount(level, n, len(self.weights)) + 2.0
        for _ in range(12):
            w = self.weights[level]
            share = w * seen / np.maximum(w * seen + (1 - w) * single, 1e-300)
            self.weights = (np.bincount(level, n * share, len(self.weights)) + 0.2) / total

    def logs(self, word: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of texts that begin at ``first``, from the levels of their words and pairs."""
        context = self.contexts(word, first)
        seen, single = self._estimates(context, pair, word)
        w = self.weights[context]
        return np.add.reduceat(np.log10(w * seen + (1 - w) * single), first)

    def known(self, block: _Block) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Per text, of the head's words: known tokens and the sum of log10(c + 1); the other words as (h, f)."""
        size, first = block.size, np.cumsum(block.size) - block.size
        at = np.searchsorted(self.head, block.words)
        at[at == len(self.head)] = 0
        found = self.head[at] == block.words if len(self.head) else np.zeros(len(block.words), bool)
        logs = np.where(found, np.log10((self.head_counts[at] if len(self.head) else np.zeros(len(at))) + 1.0), 0.0)[block.word]
        found = found[block.word]
        others = np.flatnonzero(~found)
        doc, other = np.repeat(np.arange(len(size)), size)[others], block.token[others]
        order = np.lexsort((other, doc))
        doc, other = doc[order], other[order]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(other, prepend=other[:1]) != 0))
        pairs = pa.StructArray.from_arrays([pa.array(other[new].view(np.int64)), pa.array(np.diff(new, append=len(doc)))], ["h", "f"])
        tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(size) + 1)), pa.int32()), pairs)
        return np.add.reduceat(found.astype(np.int64), first), np.add.reduceat(logs, first), tails


class _Block:
    """The distinct words and pairs of some texts, in order of their hash ranges, and the tokens as numbers of them."""

    def __init__(self, texts: list[str]) -> None:
        self.token, before, self.size = tokens(texts)
        self.words, self.word = np.unique(self.token, return_inverse=True)
        self.pairs, self.pair = np.unique(pair_keys(before, self.token), return_inverse=True)

    def levels(self, words_: np.ndarray, pairs: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Levels of the tokens and of the pairs that they end, a byte each, per text, from those of the distinct ones."""
        cuts = [0, *np.cumsum(self.size).tolist()]
        out = (words_.astype(np.uint8)[self.word].tobytes(), pairs.astype(np.uint8)[self.pair].tobytes())
        return tuple([x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for x in out)

    def by_range(self, ranges: int):
        """(part, distinct words, distinct pairs) of every range that has any."""
        parts = [_ranges_of(self.words, 64, ranges), _ranges_of(self.pairs, 48, ranges)]
        present = np.union1d(*parts)
        (a, c), (b, d) = ((np.searchsorted(p, present, "left"), np.searchsorted(p, present, "right")) for p in parts)
        for j, part in enumerate(present.tolist()):
            yield part, self.words[a[j] : c[j]], self.pairs[b[j] : d[j]]


def _ranges_of(hashes: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return np.minimum((hashes / 2.0**bits * ranges).astype(np.int64), ranges - 1)


def _counted(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, words, word_counts, pairs, pair_counts) packed by hash range, from (text)."""

    def run(batches):
        kept, n = [], 0

        def flush():
            token, pairs = (np.concatenate(x) for x in zip(*kept, strict=True))
            for_words, for_pairs = (np.unique(x, return_counts=True) for x in (token, pairs))
            parts = [_ranges_of(x[0], bits, ranges) for x, bits in ((for_words, 64), (for_pairs, 48))]
            present = np.union1d(*parts)  # only ranges that have something, so rows follow the tokens
            (a, c), (b, d) = ((np.searchsorted(p, present, "left"), np.searchsorted(p, present, "right")) for p in parts)
            for i in range(0, len(present), 256):
                span = range(i, min(len(present), i + 256))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(present[i : i + 256], pa.int32()),
                        pa.array([for_words[0][a[j] : c[j]].tobytes() for j in span], pa.binary()),
                        pa.array([for_words[1][a[j] : c[j]].astype("<u4").tobytes() for j in span], pa.binary()),
                        pa.array([_pack48(for_pairs[0][b[j] : d[j]]) for j in span], pa.binary()),
                        pa.array([for_pairs[1][b[j] : d[j]].astype("<u4").tobytes() for j in span], pa.binary()),
                    ],
                    names=["part", "words", "word_counts", "pairs", "pair_counts"],
                )

        blocks.give_back()
        for batch in batches:
            for _, part in blocks.arrow_blocks(batch.column(0), BLOCK_CHARS):
                token, before, _ = tokens(part)
                kept.append((token, pair_keys(before, token)))
                n += len(token)
                if n >= FLUSH_TOKENS:
                    yield from flush()
                    kept, n = [], 0
        if kept:
            yield from flush()
        del kept
        blocks.give_back()

    return docs.mapInArrow(run, "part int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _merged(table: pa.Table, bits: float) -> pa.Table:
    """One hash range: exact word counts (packed) and its part of the filter."""
    col = {c: table.column(c).to_pylist() for c in table.column_names}
    w, wc = _summed([np.frombuffer(x, np.uint64) for x in col["words"]], [np.frombuffer(x, "<u4") for x in col["word_counts"]])
    p, pc = _summed([_unpack48(x) for x in col["pairs"]], [np.frombuffer(x, "<u4") for x in col["pair_counts"]])
    found, top = [], 0
    for key, level in ((word_key(w)[0], levels(wc, 1)), (pair_key(p)[0], levels(pc, PAIR_CUTOFF))):
        top = max(top, int(level.max(initial=0)))
        for q in range(1, int(level.max(initial=0)) + 1):
            found.append(_items(key[level >= q], q))
    items = np.concatenate(found) if found else np.zeros(0, np.uint64)
    size = max(1, -(-int(len(items) * bits) // 512)) * 512
    flags = np.zeros(size, bool)
    block, within = _positions(items, np.uint64(size))
    for i in range(HASHES):
        flags[block + _bit(within, i)] = True
    row = {"part": [col["part"][0]], "bits": [np.packbits(flags, bitorder="little").tobytes()], "items": [len(items)], "top": [top], "n": [int(wc.sum())], "v": [len(w)], "words": [w.tobytes()], "counts": [wc.astype("<i8").tobytes()]}
    return pa.table(row, schema=pa.schema([("part", pa.int32()), ("bits", pa.binary()), ("items", pa.int64()), ("top", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))


def _counts(docs: DataFrame) -> tuple[Model, DataFrame]:
    """From (text): the model without its weights, and the exact counts (h, c) of the words that aren't in its head."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total, n_docs = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = max(16, -(-(total or 0) // RANGE_BYTES))
    merged = written(_counted(texts, ranges).groupBy("part").applyInArrow(lambda t: _merged(t, BITS), "part int, bits binary, items long, top int, n long, v long, words binary, counts binary"), "counts")

    def unpack(batches):
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["h", "c"])

    counts = merged.select("words", "counts").mapInArrow(unpack, "h long, c long")
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c"))
    # a running sum over the distinct counts; only those of the head's size reach the driver
    room, floor = HEAD_WORDS, None
    for row in by_count.limit(HEAD_WORDS).toLocalIterator():
        if row["n"] > room:
            break
        room, floor = room - row["n"], row["c"]
    head = counts.filter(F.col("c") >= (floor if floor is not None else 2**62)).toArrow()
    hashes = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    size, top, n, v = merged.agg(F.sum(F.octet_length("bits")), F.max("top"), F.sum("n"), F.sum("v")).first()
    model = Model(None, merged.select("part", "bits", F.lit(ranges).alias("ranges")), n or 0, v or 0, n_docs, top or 0, np.full(LEVELS, 0.2), hashes[order], head.column("c").to_numpy()[order].astype(np.float64))
    if (size or 0) <= MAX_FILTER_BYTES:
        model.counts, model.ranges = _gathered(merged, ranges, model.top), None
    return model, counts.filter(F.col("c") < (floor if floor is not None else 2**62))


def _gathered(merged: DataFrame, ranges: int, top: int) -> Filter:
    """The whole filter at the driver, which holds it once and a part of it."""
    parts = merged.select("part", F.octet_length("bits").alias("bytes")).toArrow().to_pydict()
    made = np.zeros(ranges, np.int64)
    made[parts["part"]] = parts["bytes"]
    starts = np.cumsum([0, *made])
    table = np.zeros(max(1, int(starts[-1])), np.uint8)
    for row in merged.select("part", "bits").toLocalIterator():
        table[starts[row["part"]] : starts[row["part"] + 1]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(table, 8 * starts, top)


TAIL = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("f", T.LongType())]))
FOUND = {"n_tokens": T.LongType(), "words": T.BinaryType(), "pairs": T.BinaryType(), "head_known": T.LongType(), "head_logs": T.DoubleType(), "tail": TAIL}


def _answered(asked: pa.Table, held: pa.Table, top: int) -> pa.Table:
    """Levels of the words and pairs that blocks ask of one range: a single probe for all blocks, whose own keys are few."""
    bits = np.concatenate([np.frombuffer(x, np.uint8) for x in held.column("bits").to_pylist()] or [np.zeros(0, np.uint8)])
    one = Filter(bits if len(bits) else np.zeros(1, np.uint8), np.array([0, 8 * len(bits)]), top)

    def of(column: str, key) -> pa.Array:
        asks = [_unpack_sorted(x) for x in asked.column(column).to_pylist()]
        keys, at = np.unique(np.concatenate(asks or [np.zeros(0, np.uint64)]), return_inverse=True)
        level = one.level(key(keys)[0], np.zeros(len(keys))).astype(np.uint8)[at].tobytes()
        ends = np.cumsum([0, *map(len, asks)]).tolist()
        return pa.array([level[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "words": of("words", word_key), "pairs": of("pairs", pair_key)})


def _leveled(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``rows`` (with text) with the levels of their words and pairs and what is known of their words, written."""
    spark = rows.sparkSession
    ranges, whole, model.ranges, model.counts = model.ranges, model.counts, None, None
    sent = spark.sparkContext.broadcast(model)
    model.ranges, model.counts = ranges, whole

    def found(block: _Block, words_, pairs) -> list:
        return [block.size, *block.levels(words_, pairs), *sent.value.known(block)]

    if ranges is None:
        bits, starts, top = spark.sparkContext.broadcast(pickle.PickleBuffer(whole.bits)), whole.starts, whole.top

        def make():
            level = Filter(_sent_bits(bits), starts, top).level

            def work(texts):
                block = _Block(texts)
                return found(block, level(*word_key(block.words)), level(*pair_key(block.pairs)))

            return work

        return written(blocks.add_columns(rows, "text", FOUND, make, keep, BLOCK_CHARS), "leveled")

    rows = written(rows, "rows", compression="zstd")  # read twice below
    n = ranges.first()["ranges"]
    top, total = model.top, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = F.pmod(F.xxhash64(F.lit(3), *keep), F.lit(max(1, total // ASK_CHARS))).alias("block")
    dealt = rows.select(number, F.coalesce("text", F.lit("")).alias("text"), *keep)

    def ask(table: pa.Table) -> pa.Table:
        block = _Block(table.column("text").to_pylist())
        part, words_, pairs = zip(*block.by_range(n), strict=True)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(part), pa.int64()), "part": pa.array(part, pa.int32()), "words": [_pack_sorted(x) for x in words_], "pairs": [_pack_sorted(x) for x in pairs]})

    kept = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, t) for c, t in FOUND.items()])
    kinds = to_arrow_schema(kept)

    def fill(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return kinds.empty_table()
        block, answers = _Block(texts.column("text").to_pylist()), answers.sort_by("part")
        whole = [np.frombuffer(b"".join(answers.column(c).to_pylist()), np.uint8) for c in ("words", "pairs")]
        made = [v if isinstance(v, pa.Array) else pa.array(v, type=kinds.field(c).type) for c, v in zip(FOUND, found(block, *whole), strict=True)]
        return pa.Table.from_arrays([*(texts.column(c) for c in keep), *made], schema=kinds)

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, part int, words binary, pairs binary")
    answers = asked.groupBy("part").cogroup(ranges.select("part", "bits").groupBy("part")).applyInArrow(lambda asked, held: _answered(asked, held, top), "block long, part int, words binary, pairs binary")
    leveled = written(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fill, kept), "leveled")
    drop_written(rows)
    return leveled


def _learn(leveled: DataFrame, model: Model) -> None:
    """The model's weights, from (words, pairs) of all training documents."""

    def run(batches):
        tally = np.zeros(LEVELS**3, np.int64)
        for _, word, pair, context in _level_blocks(batches, contexts):
            codes, n = np.unique((context.astype(np.int64) * LEVELS + pair) * LEVELS + word, return_counts=True)
            tally[codes] += n
        found = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(tally[found], pa.int64())], names=["code", "n"])

    contexts = Model(None, None, 0, 0, model.docs, 0, *[np.zeros(0)] * 3).contexts
    got = leveled.select("words", "pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    model.learn_weights(got.column("code").to_numpy(), got.column("n").to_numpy())


def _level_blocks(batches, contexts, rows_at_once: int = 2_000):
    """(first tokens of the texts, levels of words, of pairs, of contexts) of some texts at a time, from (words, pairs)."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows_at_once):
            part = batch.slice(i, rows_at_once)
            raw = part.column(0).to_pylist()
            word, pair = (np.frombuffer(b"".join(x), np.uint8) for x in (raw, part.column(1).to_pylist()))
            first = np.cumsum([0, *map(len, raw[:-1])])
            yield first, word, pair, contexts(word, first)


def _scores(leveled: DataFrame, model: Model, rest: DataFrame, keep: list[str]) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score beside the columns ``keep``; ``row`` tells rows apart."""
    small = Model(None, None, model.n, model.v, model.docs, model.top, model.weights, *[np.zeros(0)] * 2)

    def run(batches):
        for batch in batches:
            scores = [small.logs(word, pair, first) for first, word, pair, _ in _level_blocks([batch.select([0, 1])], small.contexts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, "score"])

    names = ["row", *keep, "n_tokens", "head_known", "head_logs"]
    plain = leveled.select("words", "pairs", *names)
    scored = plain.mapInArrow(run, T.StructType([*plain.schema.fields[2:], T.StructField("score", T.DoubleType())]))
    met = leveled.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.f").join(rest, "h")
    tails = met.groupBy("row").agg(F.sum("f").alias("known"), F.sum(F.col("f") * F.log10(F.col("c") + 1)).alias("logs"))
    whole = scored.join(tails, "row", "left")
    known = F.col("head_known") + F.coalesce("known", F.lit(0))
    base = F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(model.n + model.v + 1)))
    return whole.select(*keep, "n_tokens", known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _rows(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), *more)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """From (text): the model, and the exact counts (h, c) of the words that aren't in its head.

    Null and empty texts are one END token each; repeated rows count as often as they occur; an empty table gives a
    model without counts, by which every token has the same probability. Other columns are ignored."""
    model, rest = _counts(docs)
    leveled = _leveled(docs.select("text", F.monotonically_increasing_id().alias("row")), model, ["row"])
    _learn(leveled, model)
    drop_written(leveled)
    return model, rest


def score(df: DataFrame, model: Model, rest: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known (tokens that occur in training), train_tokens, base_score and score.

    Null and empty texts are one END token. Repeated rows are scored alike; an empty table gives an empty result;
    other columns of the input are ignored; texts of any length are scored whole."""
    leveled = _leveled(_rows(df, id_col, text_col), model, ["row", "id"])
    return _scores(leveled, model, rest, ["id"]).withColumnRenamed("id", id_col)


def fit_and_score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows, and ``held_out``, by a model of the rows that aren't held out.

    The same as ``fit`` on those rows and ``score`` on all, but the filter is probed once for both."""
    rows = _rows(df, id_col, text_col, held_out.alias("held_out"))
    model, rest = _counts(rows.filter(~F.col("held_out")).select("text"))
    leveled = _leveled(rows, model, ["row", "id", "held_out"])
    _learn(leveled.filter(~F.col("held_out")), model)
    return _scores(leveled, model, rest, ["id", "held_out"]).withColumnRenamed("id", id_col)
