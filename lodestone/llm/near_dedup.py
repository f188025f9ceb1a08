"""Near-duplicate detection: a signature-coordinate inverted join over MinHash signatures, confirmed on full sets.

1. A document's set holds the hashes of its distinct five-word shingles (64 bits, over lower-cased words).
   Documents with the same set form a class; one representative per class goes on, so copies never multiply.
2. A signature of ``COORDS`` coordinates is taken of each set. Sets that are similar enough agree in at least
   ``matches(percent)`` coordinates (at the similarity of the threshold itself all but one pair in 30,000 do).
3. Representatives are posted under each (coordinate, value). A value that occurs once can't match anything. Of
   the others a document needs only its rarest: two signatures with m = matches(percent) common values share one among the
   COORDS - m + 1 rarest of each (prefix filter). A document with that many unique values is done.
4. Collisions within a posting list are first counted against the list's smallest member only, which is linear.
   Pairs with enough matching coordinates are confirmed on the full sets, the most promising pair of each
   document first; a pair whose ends are connected by then is skipped.
5. Posting lists whose members lie in one component are done. The members of the others, gathered by smallest
   member, are compared across components in pairs of blocks, each a task of its own; a block has at most
   ``BLOCK_ROWS`` members and about ``BLOCK_SHINGLES`` shingles. First only the signatures meet: a pair must collide in
   one of COORDS - m + 1 coordinates, those with the most values in the block (prefix), and counting goes on only
   while the collisions so far and the coordinates left can still make m (skip). Then the full sets of the members
   that have such a partner follow, and pairs are confirmed. Only links that join components leave a block, so pairs are
   compared but never written out, and no link between different texts is lost. Such members are documents that share
   much with a near copy without being one; comparing them costs the square of their number within a group, in
   blocks that any number of executors can share.

No task holds a whole posting list, and no list is cut.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import blocks, words
from lodestone.llm.components import components
from lodestone.llm.shared import Scratch, fresh, written

SHINGLE, COORDS = 5, 64
PERCENT = 85  # by default links have 100 * intersection >= PERCENT * union
MISSED = 1 / 30_000  # share of the pairs at the threshold itself that may agree in too few coordinates
BROADCAST_IDS = 2_000_000  # ids (16 MB) up to which the documents to confirm are broadcast; more are shuffled
BLOCK_CHARS = 1_000_000
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 1 << 20
HOT_SHARE, HOT_MIN = 2_048, 200  # a class is hot with more than a 2,048th of all rows, so at most 2,048 are


@cache
def matches(percent: int) -> int:
    """In how many coordinates a pair must agree: the most that at most ``MISSED`` of the pairs of such similarity stay below."""
    p, below = percent / 100, 0.0
    for m in range(COORDS + 1):
        below += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if below > MISSED:
            return m
    return COORDS


@cache
def _multipliers() -> np.ndarray:
    return words.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _sets(texts: list[str]) -> list[np.ndarray]:
    hashes, upto = words.word_hashes(texts)
    return [np.unique(words.shingle_hashes(hashes[a:b], SHINGLE)) for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, coordinate]: smallest of the set's hashes in each of COORDS orders (upper 32 bits)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * m, starts) >> np.uint64(32) for m in _multipliers()], axis=1).astype(np.uint32)


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, cls, sig): size of the set, its digest and its signature, both null for empty sets."""

    def make():
        def work(texts):
            sets = _sets(texts)
            full = [s for s in sets if len(s)]
            sig = iter(_signatures(full).astype("<u4")) if full else iter(())
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(sig).view(np.int32)) if len(s) else (0, None, None) for s in sets]
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    new = {"n": T.LongType(), "cls": T.BinaryType(), "sig": T.ArrayType(T.IntegerType())}
    return blocks.add_columns(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", new, make, ["id"], BLOCK_CHARS)


def shingle_sets(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, set) of the documents (id, text) whose ids are given; the ids are broadcast if they are few."""
    few = ids.count() <= BROADCAST_IDS

    def make():
        def work(texts):
            sets = _sets(texts)
            return [[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [s.view(np.int64) for s in sets]]

        return work

    some = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    found = blocks.add_columns(some, "text", {"cls": T.BinaryType(), "set": T.ArrayType(T.LongType())}, make, ["id"], BLOCK_CHARS)
    return scratch.written(found.dropDuplicates(["cls"]).select("cls", "set"), "sets")


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``matches(percent)`` coordinates or more, with that number."""
    side = lambda c: reps.select(F.col("cls").alias(c), F.col("id").alias(f"{c}_id"), F.col("n").alias(f"{c}_n"), F.col("sig").alias(f"{c}_sig"))
    same: Column = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return both.withColumn("same", same).filter(F.col("same") >= matches(percent)).select("a", "b", "a_id", "b_id", "same")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that are links on their full sets, as edges (u, v) between representatives' ids."""
    ids = scratch.written(pairs.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct(), "ids")
    sets = shingle_sets(docs, ids, scratch)
    joined = pairs.join(sets.withColumnsRenamed({"cls": "a", "set": "a_set"}), "a").join(sets.withColumnsRenamed({"cls": "b", "set": "b_set"}), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    linked = 100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)
    return joined.filter(linked).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends aren't connected yet."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.withColumnsRenamed({"node": f"{c}_id", "root": f"{c}_root"}), f"{c}_id", "left")
    return pairs.filter(F.coalesce("a_root", "a_id") != F.coalesce("b_root", "b_id")).drop("a_root", "b_root")


def links(sketched: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, root) for the ids of representatives that are linked, directly or not, with a smaller one."""
    scratch = Scratch()
    reps = sketched.filter("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = scratch.written(reps, "reps")
    token = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32) + F.pmod(v.cast("long"), F.lit(1 << 32)))
    tokens = reps.select("cls", "id", F.explode(token).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("freq", "token"))
    unique = COORDS - F.count(F.lit(1)).over(Window.partitionBy("cls"))
    posted = tokens.join(often, "token").withColumns({"nth": nth, "unique": unique}).filter(F.col("nth") <= COORDS - matches(percent) + 1 - F.col("unique"))
    posted = scratch.written(posted.select("token", "cls", "id"), "posted")

    head = posted.groupBy("token").agg(F.min(F.struct("id", "cls")).alias("head"))
    starred = posted.join(head, "token").select(F.col("cls").alias("a"), F.col("head.cls").alias("b")).filter("a <> b").distinct()
    starred = scratch.written(_agreeing(starred, reps, percent), "starred")
    best = starred.groupBy("a").agg(F.max_by(F.struct("b", "a_id", "b_id"), F.struct("same", -F.col("b_id"))).alias("x")).select("a", "x.*")
    edges = scratch.written(_confirmed(best, docs, percent, scratch), "edges")
    roots = scratch.keep(components(edges))
    edges = scratch.written(edges.unionByName(_confirmed(_rooted(starred, roots), docs, percent, scratch)), "edges")
    roots = scratch.keep(components(edges))
    out = components(edges.unionByName(_across(posted, roots, reps, docs, percent, scratch)))
    scratch.drop()
    return out


def _across(posted: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between members of one posting list that lie in different components so far."""
    rooted = posted.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lists = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("head")).filter("lo < hi").select("token", "head")
    members = rooted.join(lists, "token").select("head", "cls", "id", "root").distinct()
    members = scratch.written(members.join(reps.select("cls", "n", "sig"), "cls"), "members")
    blocks_ = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    dealt = members.join(members.groupBy("head").agg(blocks_.alias("blocks")), "head").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("head", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "id", "root", "n", "sig")
    dealt = dealt.repartition("head", "i", "j")  # else the join's partitioning by head is enough, and a group's blocks share a task
    near = dealt.groupBy("head", "i", "j").applyInArrow(lambda t: _with_partner(t, percent), "head long, i int, j int, block int, cls binary, id long, root long, sig array<int>")
    near = scratch.written(near, "near")
    sets = shingle_sets(docs, near.select("id").distinct(), scratch)
    return scratch.written(near.join(sets, "cls").groupBy("head", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "u long, v long"), "edges")


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array column one after the other, and where each row's begin; one more at the end."""
    one = column.combine_chunks()
    return one.flatten().to_numpy(), one.offsets.to_numpy() - one.offsets[0].as_py()


def _colliding(sig: np.ndarray, size: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """(x, y, collisions) of the pairs between left and right, 256 left rows at a time, that collide in ``matches(percent)``
    coordinates or more, have similar sizes and lie in different components."""
    m = matches(percent)
    order = np.argsort([-len(np.unique(sig[right, k])) for k in range(COORDS)], kind="stable")
    sorted_ = [(k, np.argsort(sig[right, k], kind="stable")) for k in order[: COORDS - m + 1].tolist()]
    for part in (left[k : k + 256] for k in range(0, len(left), 256)):
        met = np.zeros((len(part), len(right)), bool)
        for k, by in sorted_:  # prefix: pairs that collide here
            values = sig[right[by], k]
            a, b = (np.searchsorted(values, sig[part, k], side) for side in ("left", "right"))
            rows = np.repeat(np.arange(len(part)), b - a)
            met[rows, by[np.arange(len(rows)) - np.repeat(np.cumsum(b - a) - b, b - a)]] = True
        a, b = size[part][:, None], size[right][None, :]
        met &= (root[part][:, None] != root[right][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        rows, cols = np.nonzero(met)
        x, y, same = part[rows], right[cols], np.zeros(len(rows), np.int16)
        for n, k in enumerate(order.tolist()):
            same += sig[x, k] == sig[y, k]
            if n % 8 == 7:  # skip those that can't come to m any more
                fit = same + (COORDS - 1 - n) >= m
                x, y, same = x[fit], y[fit], same[fit]
        yield x, y, same


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(roots, signatures, rows of block i, rows of block j)."""
    root, block = (table.column(c).to_numpy() for c in ("root", "block"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return root, _rows_of(table.column("sig"))[0].reshape(-1, COORDS), np.flatnonzero(block == i), np.flatnonzero(block == j)


def _with_partner(table: pa.Table, percent: int) -> pa.Table:
    """The members of blocks i and j that have a partner by signatures; where i = j, every pair is seen twice."""
    root, sig, left, right = _block(table)
    found = np.zeros(len(root), bool)
    if len(np.unique(root)) > 1:
        size = table.column("n").to_numpy()
        for x, y, _ in _colliding(sig, size, root, left, right, percent):
            found[x] = found[y] = True
    return table.select(["head", "i", "j", "block", "cls", "id", "root", "sig"]).filter(pa.array(found))


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links that join components, between the members of blocks i and j of a group."""
    root, sig, left, right = _block(table)
    ids = table.column("id").to_numpy()
    flat, cuts = _rows_of(table.column("set"))
    flat, size = flat.view(np.uint64), np.diff(cuts)
    sets = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    found: list[tuple[int, int]] = []
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for x, y, same in _colliding(sig, size, root, left, right, percent):
        for n in np.argsort(-same, kind="stable").tolist():
            a, b = int(x[n]), int(y[n])
            p, q = top(int(root[a])), top(int(root[b]))
            if p == q:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= percent * (size[a] + size[b] - common):
                up[max(p, q)] = min(p, q)
                found.append((int(ids[a]), int(ids[b])))
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept (the id is the smallest of its component).

    Documents are linked at a similarity of ``percent`` or more.
    Null and empty texts and texts without words have an empty set and are linked with nothing. Rows that share
    an id are one document with several texts. Rows without an id are linked with nothing: component_id is null
    and they are kept. Repeated rows are equal sets of one class. Very long texts are whole sets like any other. An empty table
    gives an empty result. Other columns of the input are ignored."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(sketches(docs, "id", "text"), "sketches")
    roots = links(sketched, docs, percent)
    total = sketched.count()
    classes = sketched.filter("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    rooted = classes.join(roots, classes.rep == roots.node, "left").select("cls", F.coalesce("root", "rep").alias("root"), "rows")
    is_hot = F.col("rows") > max(HOT_MIN, total // HOT_SHARE)
    hot = rooted.filter(is_hot).select("cls", F.col("root").alias("hot_root"))  # at most HOT_SHARE classes
    named = sketched.filter("id is not null").select("id", "n", "cls").join(F.broadcast(hot), "cls", "left")
    rest = named.filter("hot_root is null").join(rooted.filter(~is_hot).select("cls", "root"), "cls", "left")
    member = rest.select("id", "n", "root").unionByName(named.filter("hot_root is not null").select("id", "n", F.col("hot_root").alias("root")))
    out = member.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    nameless = sketched.filter("id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group of near copies, with the input's columns, whatever their
    names. Rows without an id stay; of rows that share an id all stay or none; the other cases as in ``near_duplicates``."""
    name = fresh(df, "gone")
    gone = near_duplicates(df, id_col, text_col, percent).filter("not kept").select(F.col(id_col).alias(name))
    gone = written(gone.distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(gone, df[id_col] == gone[name], "left_anti")
