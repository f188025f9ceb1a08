"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without regular expressions. An array over all code points gives each character of a block
a class; shifted copies of the class array refine it by what comes next (last blank of a run, apostrophe of a
contraction). Over these classes the pattern is a finite automaton. The transition functions of its letters
generate a small finite monoid, so "which state precedes each character" is a prefix product of monoid elements:
an associative scan, done over columns of equally long segments with one table lookup per character.

The slices between boundaries go through a cache, bounded in bytes, to the pair merging, which runs once per
distinct slice. Each token's byte start is retained: decoding copies every token's bytes to its start, and a range of
bytes or tokens can be decoded by itself.

The scan goes over ``SCAN_CHARS`` characters at a time and carries the state on, so a text of any length needs the
same scratch arrays.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from functools import cache

import numpy as np
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import blocks

CACHE_BYTES, CACHE_CHARS = 24 << 20, 64  # a worker's cache of slices; longer slices aren't kept for later blocks
BLOCK_CHARS, SCAN_CHARS = 250_000, 1 << 18  # characters encoded and scanned at once
# the only pattern that the automaton stands for (a fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# classes
LETTER, NUMBER, OTHER, SHORT, LONG, BLANKS, JOINED, ALONE, END = range(9)
# states: what the open match is. CLOSED: none; PREFIX: one blank that the next run takes; C1, C2: letters of a contraction to come
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, PREFIX, C1, C2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a match begins before the character, both [state, class]."""
    step, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for s in range(8):
        for k, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
            step[s, k], begins[s, k] = run, s not in (run, PREFIX)
        if s in (C1, C2):
            step[s, LETTER], begins[s, LETTER] = (CLOSED if s == C1 else C1), False
        if s not in (IN_OTHERS, PREFIX):  # the apostrophe begins a match of its own
            step[s, SHORT], step[s, LONG] = C1, C2
        step[s, BLANKS], begins[s, BLANKS] = IN_BLANKS, s != IN_BLANKS
        step[s, JOINED], step[s, ALONE], step[s, END] = PREFIX, CLOSED, CLOSED
    return step, begins


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, flat product table, state that each element leads to, by state before it)."""
    step, _ = _automaton()
    elements = {tuple(range(8)): 0}
    letters = [tuple(step[:, k].tolist()) for k in range(9)]
    queue = list(elements)
    for f in queue:
        for g in letters:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    table = np.array([[elements[tuple(g[s] for s in f)] for g in queue] for f in queue], np.int32)
    return np.array([elements[g] for g in letters], np.int32), table, np.array(queue, np.uint8).T.copy()


def _prefixes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Product of all elements before each position (0 is the neutral element)."""
    n = len(x)
    width = max(1, int(n**0.5) // 2)
    if n < 64:
        out, acc = np.zeros(n, np.int32), 0
        for i in range(n):
            out[i], acc = acc, table[acc, x[i]]
        return out
    rows = -(-n // width)
    lanes = np.zeros(rows * width, np.int32)
    lanes[:n] = x
    lanes = np.ascontiguousarray(lanes.reshape(rows, width).T)
    size, flat = len(table), table.ravel()
    before, acc = np.empty_like(lanes), np.zeros(rows, np.int32)
    for j in range(width):
        before[j] = acc
        acc = flat.take(acc * size + lanes[j])
    offset = _prefixes(acc, table)
    return flat.take(offset[None, :] * size + before).T.ravel()[:n]


@cache
def _class_table() -> np.ndarray:
    """Class of every code point; blanks get BLANKS or, for U+0020, JOINED."""
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANKS)):
        # the library's own character properties, so that both follow the same version of Unicode; in pieces, as its answer is a list
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for a in itertools.chain(range(0, 0xD800, 0x800), range(0xE000, 0x110000, 0x800)):
            found = bytes(library.encode_ordinary("".join(map(chr, range(a, a + 0x800)))))
            out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = k
    out[0xD800:0xE000] = OTHER
    out[0x20] = JOINED
    return out


def slice_starts(text: str, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in ``text``, in which the positions ``ends`` are separators."""
    found, state = [], CLOSED
    for a in range(0, len(text), SCAN_CHARS):
        n = min(SCAN_CHARS, len(text) - a)
        inner = ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + n + 2)] - a
        begins, state = _scan(text[a : a + n + 2], inner, n, state)
        found.append(begins + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _scan(text: str, ends: np.ndarray, n: int, state: int) -> tuple[np.ndarray, int]:
    """The starts among the first ``n`` characters, and the state after them; the rest of ``text`` is what follows."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _class_table()[points]
    cls[ends] = END
    blank = (cls == BLANKS) | (cls == JOINED)
    then = np.ones(len(cls) + 2, bool)  # no blank or end follows
    then[: len(cls)] = ~blank & (cls != END)
    last = blank & then[1:-1]
    cls = np.where(blank, np.where(last, np.where(cls == JOINED, JOINED, ALONE), BLANKS), cls).astype(np.uint8)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, (0, 0))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        cls[quotes[short]] = SHORT
        cls[quotes[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = LONG
    letters, table, reached = _monoid()
    elements = letters[cls[:n]]
    before = _prefixes(elements, table)
    states = reached[state][before]
    begins = _automaton()[1][states, cls[:n]]
    begins[ends[ends < n]] = False
    return np.flatnonzero(begins), int(reached[state][table[before[-1], elements[-1]]])


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] ... first[i] + size[i] - 1 of all i, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


class PairMerges:
    """Merges many slices at once: in each round every open slice joins its adjacent pair of lowest rank, the
    leftmost of equal ones. Pairs of ids are looked up in a sorted table of all pairs whose bytes are a token."""

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        get, pairs = ranks.get, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.values = np.append(keys, -1), np.append([pairs[k] for k in keys.tolist()], self.NONE).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each piece has."""
        size = np.ones(len(pieces), np.int64)
        whole = [self.ranks.get(p, -1) for p in pieces]
        long = {i: _merge_long([p[j : j + 1] for j in range(len(p))], self.ranks) for i, p in enumerate(pieces) if whole[i] < 0 and len(p) > 128}
        short = np.array([i for i, r in enumerate(whole) if r < 0 and i not in long], np.int64)
        owner, merged = self._short([pieces[i] for i in short.tolist()])
        size[short] = np.bincount(owner, minlength=len(short))
        size[list(long)] = [len(x) for x in long.values()]
        first = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int32)
        ids[first] = whole
        ids[ragged(first[short], size[short])] = merged
        for i, x in long.items():
            ids[first[i] : first[i] + len(x)] = x
        return ids, size

    def _short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the piece, id) of every token, in order."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), list(map(len, pieces)))
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(ids))
            here = np.repeat(low, size)
            still = here < self.NONE
            if not still.all():
                done.append((owner[~still], ids[~still]))
                ids, owner, rank, here = ids[still], owner[still], rank[still], here[still]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == here)
            at = at[np.diff(owner[at], prepend=-1) != 0]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = self.NONE
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self.rank(ids[i], ids[i + 1])
        owner, ids = np.concatenate([o for o, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over a linked list, for slices of thousands of bytes."""
    n, get = len(parts), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return tuple(ranks[p] for p in parts if p)


class Codec:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        if pattern != PATTERN:
            raise ValueError("the automaton stands for another pattern")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.size = np.array(list(map(len, tokens)), np.int64)  # bytes of each token, which stand one after the other in flat
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i) for i in range(len(tokens))]
        self.merges = PairMerges(self.ranks)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # slice -> its number; the ids of the slices stand one after the other
        self.sizes, self.ids, self.held = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, upto, _ = self.encode_block(texts)
        return [ids[a:b].tolist() for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, tokens up to each text's end, byte at which each token begins in all texts together)."""
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = slice_starts(joined, ends)
        cuts = np.searchsorted(starts, ends)
        stops = np.append(starts[1:], len(joined))
        filled = np.diff(cuts, prepend=0) > 0
        stops[cuts[filled] - 1] = ends[filled]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in range(0, len(starts), 65_536):
            pieces = list(map(joined.__getitem__, map(slice, starts[i : i + 65_536].tolist(), stops[i : i + 65_536].tolist())))
            more, size = self._looked_up(pieces)
            ids.append(more)
            sizes.append(size)
        ids, upto = np.concatenate(ids), np.cumsum(np.concatenate(sizes), dtype=np.int64)
        length = self.size[ids]
        return ids, np.append(0, upto)[cuts], np.cumsum(length) - length

    def _looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slices and how many each has. A full cache starts afresh; long slices leave it at once."""
        if self.held > CACHE_BYTES:
            self._clear()
        new = sorted(set(pieces).difference(self.known), key=len)
        at, n_ids = len(self.sizes), len(self.ids)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        ids, sizes = self.merges([p.encode("utf-8", "surrogatepass") for p in new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        size = self.sizes[number]
        out = self.ids[ragged(first[number], size.astype(np.int64))]
        kept = sum(len(p) <= CACHE_CHARS for p in new)  # they are sorted by length
        for p in new[kept:]:
            del self.known[p]
        self.sizes = self.sizes[: at + kept]
        self.ids = self.ids[: n_ids + int(sizes[:kept].sum())]
        self.held += sum(160 + 2 * len(p) for p in new[:kept])
        return out, size

    def decode_block(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of consecutive tokens: the byte at ``i`` is that of the token whose start is the last one up to i."""
        size = self.size[ids]
        return self.flat[np.repeat(self.first[ids] - starts, size) + np.arange(size.sum())].tobytes()

    def decode(self, ids: list[int]) -> bytes:
        x = np.asarray(ids, np.int64)
        return self.flat[ragged(self.first[x], self.size[x])].tobytes()

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids.tolist())).encode()).hexdigest()


@cache
def codec(path: str, pattern: str = PATTERN) -> Codec:
    """One codec a Python worker. Where the file isn't on this machine, a copy shipped by addFile is used."""
    try:
        return Codec(path, pattern)
    except FileNotFoundError:
        return Codec(SparkFiles.get(path.rpartition("/")[2]), pattern)


def encode(df: DataFrame, path: str, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``df`` with ``ids`` (token ids) and ``starts`` (byte offset of each token in the UTF-8 text).

    Null and empty texts get empty arrays. Texts are encoded whole, whatever their length; repeated rows stay
    repeated; existing columns ``ids`` and ``starts`` are replaced; an empty table stays empty. Another pattern than
    ``PATTERN`` is an error."""

    def make():
        c = codec(path, pattern)

        def work(texts):
            ids, upto, starts = c.encode_block(texts)
            spans = list(zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True))
            return [[ids[a:b] for a, b in spans], [starts[a:b] - starts[a] if a < b else starts[:0] for a, b in spans]]

        return work

    return blocks.add_columns(df, text_col, {"ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.LongType())}, make, limit=BLOCK_CHARS)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids; null ids count as none."""
    columns = [f for f in df.schema.fields if f.name != out]
    src = df.select(*[df[f.name] for f in columns], df[ids_col].alias("__ids"))

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            made = pa.array([c.decode(x or []) for x in b.column(len(columns)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[f.name for f in columns] + [out])

    return src.mapInArrow(run, T.StructType([*columns, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, pattern: str = PATTERN) -> DataFrame:
    """Encode, and decode by the tokens' offsets, in one pass: n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256. Null, empty and very long texts, repeated rows, empty tables and clashing names as in ``encode``."""

    def make():
        c = codec(path, pattern)

        def work(texts):
            ids, upto, starts = c.encode_block(texts)
            raw, at = c.decode_block(ids, starts), np.append(starts, starts[-1] + c.size[ids[-1]] if len(ids) else 0)
            spans = list(zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True))
            return [
                [b - a for a, b in spans],
                [c.digest(ids[a:b]) for a, b in spans],
                [hashlib.sha256(memoryview(raw)[at[a] : at[b]]).hexdigest() for a, b in spans],
            ]

        return work

    return blocks.add_columns(df, text_col, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, make, keep, BLOCK_CHARS)
