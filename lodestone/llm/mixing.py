"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code point order (null last) get the weights in turn and share all words; a target stops
   at ``cap`` times its source's words and the excess goes to the others by weight. Sorting sources by
   (cap * words / weight) turns that repeated re-sharing into one pass of running sums.
2. Permuted streams. A keyed hash orders the documents of each source. The top bits of the hash name a bucket,
   so positions (running sums of words) come from bucket sums plus a window inside a bucket: no task holds a
   whole source, however hot.
3. Block quotas. A stream is cut into blocks of ``block_words`` (a document belongs to the block in which it
   begins). A target of f whole passes and a remainder of R words lets every block be drawn f times and the first
   blocks once more, up to word R.
4. Splitting tree. The root holds each source's number of draws. A node gives its left child the share that its
   shards make up, drawn without replacement: source after source, the number that goes left is a hypergeometric
   number, found by inverting its distribution function within eight standard deviations of the mode. So every
   source's quota is split by the multivariate hypergeometric law, at a cost that grows with the root of the number
   of blocks. The leaves are the output shards with whole quotas for each source.
5. Disjoint permuted blocks. A keyed affine permutation numbers a source's draws; shard after shard takes its quota
   of them. A block's documents are taken once for each draw of the block, by the shard that drew it, and are
   ordered inside the shard by another hash. What no shard draws isn't in the mix.

Words are counted once, into a narrow table in the shared folder; texts are moved only to where their copies go. Only
DataFrame operations are used. Everything is a function of the data and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12  # 4,096 buckets a source: a billion documents make buckets of about 250,000 narrow rows
STEP = 2_654_435_761  # a prime, so it has no factor in common with a smaller number of draws
SHARD_WORDS = 1 << 22  # words of a shard, on average


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """From (source, source_size): weight and target of each source. One row per source goes in and out."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # these windows see one narrow row per source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    sized = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = sized.withColumn("level", rest / rest_weight).withColumn("capped", F.col("limit") <= F.col("level") * F.col("weight"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    left_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    shared = F.try_divide(left, left_weight) * F.col("weight")
    return capped.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("limit")).otherwise(shared).alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11) / F.lit(float(2**53))


def hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``good`` ones, by the inverse distribution function.

    Chances are relative to that of the smallest number looked at, so no factorials are needed."""
    d = lambda c: c.cast("double")
    params = F.struct(good.cast("long").alias("k"), total.cast("long").alias("n"), draws.cast("long").alias("m"), uniform.alias("u"))

    def spread(p: Column) -> Column:
        share = F.try_divide(d(p["k"]), d(p["n"]))
        sd = F.sqrt(F.greatest(F.lit(0.0), d(p["m"]) * share * (1 - share) * F.coalesce(F.try_divide(d(p["n"] - p["m"]), d(p["n"] - 1)), F.lit(0.0))))
        mode = F.floor(d(p["m"] + 1) * d(p["k"] + 1) / d(p["n"] + 2)).cast("long")
        reach = F.coalesce(F.ceil(8 * sd).cast("long"), F.lit(0).cast("long")) + 8
        least, most = F.greatest(F.lit(0).cast("long"), p["m"] - (p["n"] - p["k"])), F.least(p["m"], p["k"])
        return F.struct(p["k"].alias("k"), p["n"].alias("n"), p["m"].alias("m"), p["u"].alias("u"), F.greatest(least, F.least(most, mode - reach)).alias("lo"), F.least(most, F.greatest(least, mode + reach)).alias("hi"))

    def drawn(p: Column) -> Column:
        ratio = lambda i: d(p["k"] - i) * d(p["m"] - i) / (d(i + 1) * F.greatest(F.lit(1.0), d(p["n"] - p["k"] - p["m"] + i + 1)))
        every = F.sequence(p["lo"], p["hi"])
        whole = F.aggregate(every, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda t, i: F.struct((t["w"] * ratio(i)).alias("w"), (t["sum"] + t["w"]).alias("sum")), lambda t: t["sum"])

        def found(aim: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), p["lo"].alias("at"))
            step = lambda t, i: F.struct((t["w"] * ratio(i)).alias("w"), (t["sum"] + t["w"]).alias("sum"), F.when(t["sum"] + t["w"] <= aim, i + 1).otherwise(t["at"]).alias("at"))
            return F.aggregate(every, start, step, lambda t: F.least(t["at"], p["hi"]))

        return _let(whole * p["u"], found)

    return _let(_let(params, spread), drawn)


def _split(quotas: Column, left_draws: Column, node: Column, seed: int) -> Column:
    """How many draws of each source go left: ``left_draws`` of all, without replacement."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["blocks"])
    state = F.struct(total.alias("rest"), left_draws.alias("open"), F.array().cast("array<long>").alias("left"))

    def one_source(st: Column, q: Column) -> Column:
        here = hypergeometric(q["blocks"], st["rest"], st["open"], _uniform(F.xxhash64(F.lit(seed), node, q["source"])))
        return _let(here, lambda k: F.struct((st["rest"] - q["blocks"]).alias("rest"), (st["open"] - k).alias("open"), F.concat(st["left"], F.array(k)).alias("left")))

    return F.aggregate(quotas, state, one_source, lambda st: st["left"])


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """From (source, blocks): one row (source, shard, blocks, first) per shard and source that it draws, ``first`` being
    where the shard's draws of that source begin. The tree halves the range of shards until each node is one shard;
    sources that a node doesn't draw leave it, and from a few hundred nodes on tasks share them."""
    pair = "struct<source:string,blocks:bigint>"
    nodes = quotas.filter("blocks > 0").agg(F.sort_array(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), "blocks"))).cast(f"array<{pair}>").alias("q"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "q")
    for level in range(max(0, (n_shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, q: a + q["blocks"])
        share = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        drawn = nodes.withColumn("left", _split(F.col("q"), share, F.struct("lo", "hi"), seed))
        some = lambda q: F.filter(q, lambda x: x["blocks"] > 0)
        to_left = some(F.zip_with("q", "left", lambda q, k: F.struct(q["source"].alias("source"), k.alias("blocks"))).cast(f"array<{pair}>"))
        to_right = some(F.zip_with("q", "left", lambda q, k: F.struct(q["source"].alias("source"), (q["blocks"] - k).alias("blocks"))).cast(f"array<{pair}>"))
        children = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi"), to_left.alias("q")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"), to_right.alias("q")))
        nodes = drawn.select(F.explode(children).alias("n")).select("n.*").filter("hi > lo")
        if level == 8:
            nodes = nodes.repartition("lo")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("q")).select("shard", "q.source", "q.blocks")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long")))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(rid, id, source, s, size, k, tie, h, bucket), written; s is the source as a key that is never null."""
    source = F.col(source_col).cast("string")
    base = df.select(F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("s"), n_words(F.col(text_col)).alias("size"), _key(id_col, source_col), _tie(text_col))
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "k", "tie")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
    return written(base.withColumn("rid", F.monotonically_increasing_id()), "sized")


def _key(id_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(17), F.col(id_col), F.col(source_col)).alias("k")


def _tie(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col)).alias("tie")


def _dealt(base: DataFrame, weights: Sequence[float], cap: int, block_words: int, n_shards: int | None, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(copies: a row (rid, copy, words, shard, place) for each copy in the mix; plan: a row for each source; shards)."""
    zero = F.lit(0).cast("long")
    buckets = base.groupBy("s", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("s", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), zero).alias("bucket_start"))
    sizes = buckets.groupBy("s").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    passes = F.least(F.lit(cap), F.floor(F.try_divide(F.col("target"), F.col("source_size")))).cast("long")
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    plan = (
        source_targets(sizes.select("source", "source_size"), weights, cap)
        .withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("passes", F.coalesce(passes, zero))
        .withColumn("extra", F.least(F.col("source_size"), F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size")))).cast("long"))
        .withColumn("extra", F.when(F.col("passes") >= cap, 0).otherwise(F.col("extra")))
        .withColumn("n_blocks", blocks)
        .withColumn("draws", F.col("passes") * blocks + F.ceil(F.col("extra") / F.lit(block_words)).cast("long"))
    )
    plan = written(plan, "plan")
    if n_shards is None:
        n_shards = max(1, -(-(plan.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS))
    upto = lambda first, n: F.explode(F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<long>")))
    quotas = shard_quotas(plan.select(F.col("s").alias("source"), F.col("draws").alias("blocks")), n_shards, seed)
    draws = quotas.select(F.col("source").alias("s"), "shard", upto(F.col("first"), F.col("blocks")).alias("slot"))
    # the draw's number in the permuted order names the block and the pass
    slot = F.pmod(F.col("number") * F.lit(STEP) + F.pmod(F.xxhash64(F.lit(seed + 1), "s"), F.col("draws")), F.col("draws"))
    numbers = plan.select("s", "passes", "extra", "n_blocks", "draws", upto(zero, F.col("draws")).alias("number")).withColumn("slot", slot)
    drawn = numbers.join(draws, ["s", "slot"]).select("s", "passes", "extra", "shard", (F.col("number") % F.col("n_blocks")).alias("block"), F.floor(F.col("number") / F.col("n_blocks")).alias("copy"))

    order = Window.partitionBy("s", "bucket").orderBy("h", "rid")  # rid tells only equal rows apart
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)
    placed = base.filter("size > 0").select("rid", "s", "size", "bucket", "h", F.row_number().over(order).alias("nth"), inside.alias("inside"))
    placed = placed.join(starts, ["s", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("inside")).withColumn("block", F.floor(F.col("start") / F.lit(block_words)))
    part = F.greatest(zero, F.least(F.col("size"), F.col("extra") - F.col("start")))
    copies = placed.join(drawn, ["s", "block"]).withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(part))
    return copies.filter("words > 0").select("rid", "copy", "words", "shard", F.xxhash64(F.lit(seed + 2), "h", "nth", "copy").alias("place")), plan, n_shards


def mix_digest(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_words: int = 16_384, n_shards: int | None = None, seed: int = 20_24,
) -> DataFrame:
    """Per row: id, size, source_size, target, ``taken``, the words of all its copies in the mix, and ``copies``, which
    shards drew them: (copy, words, shard, place) by copy.

    ``words`` of a copy are all its document's but for the document at which a source's target falls: so many count
    there that the target is met. Null texts have no words and are never taken; neither are texts without words. Null is
    a source of its own, the last in order. Repeated rows are mixed each for itself; texts of any length are whole; other
    columns are ignored. An empty table gives an empty result. Without ``n_shards`` shards have ``SHARD_WORDS`` words on
    average."""
    base = _sized(df, id_col, text_col, source_col, seed)
    copies, plan, _ = _dealt(base, weights, cap, block_words, n_shards, seed)
    found = copies.groupBy("rid").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("copy", "words", "shard", "place"))).alias("copies"))
    rows = base.select("rid", "id", "s", "size").join(plan.select("s", "source_size", "target"), "s").join(found, "rid", "left")
    none = F.array().cast("array<struct<copy:bigint,words:bigint,shard:int,place:bigint>>")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", none).alias("copies"))


def mixed_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, length_col: str | None = None, whole: bool = False,
    weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_words: int = 16_384, n_shards: int | None = None, seed: int = 20_24,
) -> DataFrame:
    """The mix itself with the input's columns, whatever their names: a row per copy, shard after shard in the order of
    places; a cut copy holds the leading words that count.

    With ``whole`` no document is cut: the one at the target's end comes whole, so a source may pass its target by less
    than that document. ``length_col`` names a column of text lengths to bring up to date in cut copies. Null, empty and
    very long texts, repeated rows and empty tables as in ``mix_digest``; rows that agree in id, source and text are
    interchangeable, and meet in one task."""
    base = _sized(df, id_col, text_col, source_col, seed)
    copies, _, shards = _dealt(base, weights, cap, block_words, n_shards, seed)
    nth = F.row_number().over(Window.partitionBy("k", "tie").orderBy("k"))
    keyed = base.select("rid", "k", "tie", "size").withColumn("nth", F.row_number().over(Window.partitionBy("k", "tie").orderBy("rid")))
    found = copies.join(keyed, "rid").groupBy("k", "tie").agg(F.collect_list(F.struct("nth", "shard", "place", "words", "size")).alias("found"))
    rows = df.select(F.struct("*").alias("row"), _key(id_col, source_col), _tie(text_col)).withColumn("nth", nth).join(found, ["k", "tie"])
    mine = F.filter("found", lambda c: c["nth"] == F.col("nth"))
    mixed = rows.select("row", F.explode(mine).alias("c")).repartition(shards, "c.shard").sortWithinPartitions("c.shard", "c.place")
    field = lambda c: F.col("row").getField(c)
    if whole:
        return mixed.select(*[field(c).alias(c) for c in df.columns])
    head = F.array_join(F.slice(F.regexp_extract_all(field(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("c.words").cast("int")), "")
    cut = F.col("c.words") < F.col("c.size")
    kept = F.when(cut, head).otherwise(field(text_col))
    new = {text_col: kept} | ({length_col: F.when(cut, F.length(kept).cast("long")).otherwise(field(length_col))} if length_col else {})
    return mixed.select(*[new.get(c, field(c)).alias(c) for c in df.columns])
