"""Matching of names to attributes: equi-joins whose small side the optimizer broadcasts if its size allows, or scored pairs
with an argmax over the schema's aliases, a list of at most ``MAX_LISTED``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lookup_key
from lodestone.functions.units import header_unit


MAX_LISTED = 20_000


def _listed(aliases: DataFrame, *columns: str):
    """The alias table as one literal array: its length is the schema's, whatever the data. Too long a list is an error."""
    rows = aliases.select(*columns).limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"a schema has at most {MAX_LISTED} aliases")
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in columns]) for r in rows])


def exact_alias(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``attribute``: equal names after normalisation; the first alias of a key counts."""
    table = aliases.groupBy(lookup_key(F.col("alias")).alias("_k")).agg(F.min_by("attribute", "ordinal").alias("attribute"))
    return df.join(table, lookup_key(F.col(name_col)) == F.col("_k"), "left").drop("_k")


def fuzzy_alias(df: DataFrame, name_col: str, aliases: DataFrame, least: float = 0.5) -> DataFrame:
    """``df`` with ``attribute`` and ``match``: the largest share of an alias' words (longer than three letters) that the
    name has; the first alias wins ties; null below ``least``."""
    long_words = lambda c: F.filter(F.split(lookup_key(c), " "), lambda w: F.length(w) > 3)
    mine = long_words(F.col(name_col))
    scored = F.transform(
        _listed(aliases, "alias", "attribute", "ordinal"),
        lambda a: F.struct(
            F.coalesce(F.try_divide(F.size(F.array_intersect(mine, long_words(a["alias"]))).cast("double"), F.size(F.array_distinct(long_words(a["alias"]))).cast("double")), F.lit(0.0)).alias("match"),
            (-a["ordinal"]).alias("first"), a["attribute"].alias("attribute"),
        ),
    )
    best = F.array_max(scored)
    return df.withColumn("_b", best).withColumns({"attribute": F.when(F.col("_b.match") >= least, F.col("_b.attribute")), "match": F.col("_b.match")}).drop("_b")


def header_match(df: DataFrame, header_col: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``attribute`` and ``match``: aliases contained in the header score by their share of its length."""
    low = F.lower(header_col)
    inside = F.filter(_listed(aliases, "alias", "attribute", "ordinal"), lambda a: low.contains(F.lower(a["alias"])))
    scored = F.transform(inside, lambda a: F.struct((F.try_divide(F.length(a["alias"]), F.length(low))).alias("match"), (-a["ordinal"]).alias("first"), a["attribute"].alias("attribute")))
    return df.withColumn("_b", F.array_max(scored)).withColumns({"attribute": F.col("_b.attribute"), "match": F.col("_b.match")}).drop("_b")


def header_attribute(df: DataFrame, header_col: str, schema: DataFrame) -> DataFrame:
    """``df`` with attribute, unit and confidence of a table's header.

    Of the attributes' names and aliases, the best counts: contained in the header, by its share of the header's length; or
    by the share of its words that the header has and that have more than three letters, if these are half of its words
    and at least one. The first in schema order wins ties. The unit is the header's own, else the attribute's first; it adds
    .2 to the confidence, which is 1 at most. ``schema`` is (attribute, aliases, units, ordinal)."""
    header = F.trim(F.regexp_replace(header_col, r"\s+", " "))
    low, words = F.lower(header), F.split(F.lower(header), " ")
    names = schema.select("attribute", "ordinal", F.get("units", F.lit(0)).alias("own"), F.posexplode(F.concat(F.array("attribute"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "alias"))

    def scored(a):
        alias = F.lower(a["alias"])
        parts = F.split(alias, " ")
        found = F.size(F.filter(parts, lambda w: (F.length(w) > 3) & F.array_contains(words, w)))
        whole = F.when(low.contains(alias), F.coalesce(F.try_divide(F.length(alias), F.length(low)), F.lit(0.0))).otherwise(F.lit(0.0))
        share = F.when(found >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)), found / F.size(parts)).otherwise(F.lit(0.0))
        return F.struct(F.greatest(whole, share).alias("score"), (-a["ordinal"]).alias("first"), (-a["nth"]).alias("then"), a["attribute"].alias("attribute"), a["own"].alias("own"))

    best = F.array_max(F.transform(_listed(names, "attribute", "ordinal", "own", "nth", "alias"), scored))
    made = df.withColumn("_b", best).withColumn("_b", F.when(F.col("_b.score") > 0, F.col("_b"))).withColumn("_u", F.coalesce(header_unit(header), F.col("_b.own")))
    confidence = F.least(F.lit(1.0), F.coalesce("_b.score", F.lit(0.0)) + F.when(F.col("_u").isNotNull(), 0.2).otherwise(0.0))
    return made.withColumns({"attribute": F.col("_b.attribute"), "unit": F.col("_u"), "confidence": confidence}).drop("_b", "_u")


def axis_match(df: DataFrame, title_col: str, unit_col: str, aliases: DataFrame, owners: DataFrame) -> DataFrame:
    """``df`` with ``attribute``: the longest alias in an axis title, short ones (up to three letters) only as words, others
    whole or with all their words of more than three letters;
    attributes are passed over where the axis' unit belongs to another. ``owners`` is (unit, owner)."""
    low = F.lower(title_col)

    def all_long_words(alias):
        long = F.filter(F.split(alias, r"\s+"), lambda w: F.length(w) > 3)
        return (F.size(long) > 0) & F.forall(long, lambda w: low.contains(w))

    owned = df.join(owners, F.lower(unit_col) == F.col("unit"), "left") if "unit" != unit_col else df.join(owners.withColumnRenamed("unit", "_u"), F.lower(unit_col) == F.col("_u"), "left")
    fits = F.filter(
        _listed(aliases, "alias", "attribute", "ordinal"),
        lambda a: F.when(F.length(a["alias"]) <= 3, F.array_contains(F.split(low, "[^a-z0-9]+"), a["alias"])).otherwise(low.contains(a["alias"]) | all_long_words(a["alias"]))
        & F.coalesce(F.col("owner") == a["attribute"], F.lit(True)),
    )
    best = F.array_max(F.transform(fits, lambda a: F.struct(F.length(a["alias"]).alias("l"), (-a["ordinal"]).alias("first"), a["attribute"].alias("attribute"))))
    return owned.withColumn("attribute", best["attribute"]).select(*df.columns, "attribute")


def first_attribute_of(df: DataFrame, key: str, owners: DataFrame, owner_key: str) -> DataFrame:
    """``df`` with the first attribute, in schema order, that has the row's unit or dimension."""
    first = owners.groupBy(F.col(owner_key).alias("_k")).agg(F.min_by("attribute", "ordinal").alias("attribute"))
    return df.join(first, F.col(key) == F.col("_k"), "left").drop("_k")
