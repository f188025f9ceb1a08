"""The attribute schema of a run: inferred types, dimensions, ranges and rules, and its lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lookup_key
from lodestone.functions.units import slash_form, with_dimension

# fixed values: words that name a category, and the plausible range of a dimension in its base unit
CATEGORY_WORDS = ("type", "method", "material", "name", "species", "category", "grade")
DIMENSION_RANGES = {
    "percentage": (0.0, 100.0), "temperature": (0.0, 5000.0), "voltage": (-100.0, 1000.0), "length": (0.0, 1000.0), "mass": (0.0, 10000.0), "time": (0.0, 1e8),
    "capacitance_per_mass": (0.0, 5e6), "energy_per_mass": (0.0, 1e7), "power_per_mass": (0.0, 1e8), "current_per_mass": (0.0, 1e6), "area_per_mass": (0.0, 5e6),
}


def attribute_type(name: Column, units: Column) -> Column:
    """"string" without units or for a category's name, else "float"."""
    category = F.lower(name).rlike("|".join(CATEGORY_WORDS))
    return F.when((F.coalesce(F.size(units), F.lit(0)) <= 0) | category, "string").otherwise("float")


def validation_rules(name: Column, units: Column) -> Column:
    kind = attribute_type(name, units)
    share = F.coalesce(F.exists(units, lambda u: u.contains("%")), F.lit(False)) | F.lower(name).contains("ratio")
    rules = F.array(F.when(kind == "string", "not_numeric").otherwise("unit_required"), F.when(share & (kind == "float"), "range_0_100"))
    return F.filter(rules, lambda r: r.isNotNull())


def infer(attributes: DataFrame) -> DataFrame:
    """(attribute, units, low, high) with type, dimension, rules and range; a given range goes before the inferred one.

    The dimension is that of the first unit that has one."""
    units = attributes.select("attribute", F.posexplode("units").alias("pos", "unit"))
    known = with_dimension(units, "unit").filter("dimension is not null")
    first = known.groupBy("attribute").agg(F.min_by("dimension", "pos").alias("dimension"))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for d, (a, b) in DIMENSION_RANGES.items():
        low, high = F.when(F.col("dimension") == d, a).otherwise(low), F.when(F.col("dimension") == d, b).otherwise(high)
    name, listed = F.col("attribute"), F.col("units")
    return attributes.join(first, "attribute", "left").select(
        "attribute", "units", attribute_type(name, listed).alias("type"), "dimension", validation_rules(name, listed).alias("rules"),
        F.coalesce("low", low).alias("low"), F.coalesce("high", high).alias("high"),
    )


def alias_index(attributes: DataFrame) -> DataFrame:
    """(key, attribute, ordinal): every alias and the attribute's own name; the first attribute of a key counts."""
    names = attributes.select("attribute", "ordinal", F.explode(F.concat(F.array("attribute"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return names.groupBy(lookup_key(F.col("alias")).alias("key")).agg(F.min_by("attribute", "ordinal").alias("attribute"), F.min("ordinal").alias("ordinal"))


def valid_type(value: Column, kind: Column) -> Column:
    return F.when(kind == "float", value.try_cast("double").isNotNull()).when(kind == "int", value.try_cast("bigint").isNotNull()).otherwise(value.isNotNull())


def compatible(left: DataFrame, a: str, b: str) -> DataFrame:
    """``left`` with ``compatible``: both units have a dimension, and it is the same; equal units always are."""
    one = with_dimension(left, a).withColumnRenamed("dimension", "_da").drop("factor", "offset", "base_unit")
    two = with_dimension(one, b).withColumnRenamed("dimension", "_db").drop("factor", "offset", "base_unit")
    same = (slash_form(F.col(a)) == slash_form(F.col(b))) | (F.col("_da") == F.col("_db"))
    return two.withColumn("compatible", F.coalesce(same, F.lit(False))).drop("_da", "_db")


def refined_query(query: Column, primary: Column) -> Column:
    """A search text with the two first keywords that it lacks."""
    more = F.slice(F.filter(primary, lambda k: ~F.lower(query).contains(F.lower(k))), 1, 2)
    return F.concat_ws(" ", query, more)


def words_at(starts: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """(key, pos, word): the last word that starts at or before each offset; ``starts`` is (key, word, pos)."""
    both = starts.select(key, "pos", "word", F.lit(0).alias("_o")).unionByName(offsets.select(key, "pos", F.lit(None).cast("int").alias("word"), F.lit(1).alias("_o")))
    so_far = Window.partitionBy(key).orderBy("pos", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("word", F.max("word").over(so_far)).filter("_o = 1").select(key, "pos", "word")
