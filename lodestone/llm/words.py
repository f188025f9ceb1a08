"""Word and shingle hashes of blocks of texts, computed over the bytes of a whole block at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
SPAN = 1 << 19  # bytes hashed at once
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a span and its last word can need."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(2 * SPAN, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, A-Z lower-cased and white space as blanks, each text followed by a blank; their ends."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" ").translate(_LOWER), np.uint8)
    return data, np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words before the end of each text)."""
    data, ends = folded(texts)
    blank = data == 32
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    first, last = turn[::2], turn[1::2]
    return data, first, last, np.searchsorted(first, ends)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and the number of words up to each text's end."""
    data, first, last, upto = spans(texts)
    return span_hashes(data, first, last), upto


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which follow one another, some of the bytes at a time whatever their lengths."""
    out = np.empty(len(first), np.uint64)
    up, down = _powers()
    long = np.flatnonzero(last - first > SPAN)
    for i in long.tolist():
        total = np.zeros(1, np.uint64)
        for a in range(int(first[i]), int(last[i]), SPAN):
            part = _letters()[data[a : min(a + SPAN, int(last[i]))]]
            total += (part * up[: len(part)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(_BASE, a - int(first[i]), 1 << 64))
        out[i] = total[0]
    rest = np.flatnonzero(last - first <= SPAN)
    starts, stops = first[rest], last[rest]
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), SPAN)), len(rest)))
    for i, j in zip([0, *cuts], cuts, strict=False):
        if i == j:
            continue
        begin, end = int(starts[i]), int(stops[j - 1])
        if end - begin >= 2 * SPAN:  # words left out for their length lie between
            parts = [(k, k + 1) for k in range(i, j)]
        else:
            parts = [(i, j)]
        for a, b in parts:
            begin, end = int(starts[a]), int(stops[b - 1])
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_letters()[data[begin:end]] * up[: end - begin], dtype=np.uint64, out=sums[1:])
            out[rest[a:b]] = (sums[stops[a:b] - begin] - sums[starts[a:b] - begin]) * down[starts[a:b] - begin]
    return mix(out ^ ((last - first).astype(np.uint64) << np.uint64(48)))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; fewer words make one run of them all."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + words[i : len(words) - k + 1 + i])
    return out
