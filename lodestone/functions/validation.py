"""Four-layer validation of a data point as Column expressions: type, unit, range, context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID, AMBIGUOUS = 0.9, 0.7


def likely_header(text: Column) -> Column:
    return (F.length(text) < 60) & text.rlike(r"[(\[][^)\]]+[)\]]") & ~text.rlike(r"^\s*[-+]?\d")


def likely_caption(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:fig(?:ure)?|table|scheme)\.?\s*\d+") | ((F.length(text) > 50) & (F.regexp_count(text, F.lit(r"\.")) > 2))


def type_factor(kind: Column, value: Column, raw: Column) -> Column:
    """1, .5 for a number where a category is expected, 0 for headers, captions and text where a number is."""
    return F.when(likely_header(raw) | likely_caption(raw), 0.0).when((kind == "float") & value.isNull(), 0.0).when((kind == "string") & value.isNotNull(), 0.5).otherwise(1.0)


def unit_score(unit: Column, dimension: Column, expected: Column, expected_dimension: Column, compatible: Column | None = None) -> Column:
    """1 for an expected unit, whatever its case, .7 for one of the attribute's dimension, .6 for one of the dimension of an
    expected unit (``compatible``: these units' dimensions), .2 without a unit (.5 if none is expected), else 0."""
    same = F.coalesce(F.array_contains(compatible, dimension), F.lit(False)) if compatible is not None else F.lit(False)
    none = F.coalesce(F.size(expected), F.lit(0)) <= 0
    blank = unit.isNull() | (F.trim(unit) == "")
    return (
        F.when(blank & none, 0.5).when(blank, 0.2).when(none, 0.5).when(F.array_contains(F.transform(expected, F.lower), F.lower(F.trim(unit))), 1.0)
        .when(F.coalesce(dimension == expected_dimension, F.lit(False)), 0.7).when(same, 0.6).otherwise(0.0)
    )


def range_factor(value: Column, low: Column, high: Column) -> Column:
    """-1 rejects: negative where the range isn't, below a tenth of the minimum or above ten times the maximum;
    .7 outside the range; 1.1 stands for the bonus inside; 1 without a value or range."""
    unknown = value.isNull() | low.isNull() | high.isNull()
    far = ((value < 0) & (low >= 0)) | ((low > 0) & (value < low * 0.1)) | (value > high * 10)
    return F.when(unknown, 1.0).when(far, -1.0).when(value.between(low, high), 1.1).otherwise(0.7)


def context_factor(context: Column) -> Column:
    """0 for header cells, very long texts and reference numbers, .6 for captions, else 1."""
    return F.when(context.isNull(), 1.0).when(likely_header(context) | (F.length(context) > 100) | context.rlike(r"^\s*\[\d+\]"), 0.0).when(likely_caption(context), 0.6).otherwise(1.0)


def confidence(type_: Column, unit: Column, range_: Column, context: Column) -> Column:
    """Confidence of the four layers together, 0 where one rejects, rounded to three digits."""
    base = type_ * (F.lit(0.4) + F.lit(0.6) * unit)
    ranged = F.when(range_ == 1.1, F.least(F.lit(1.0), base + 0.1)).otherwise(base * range_)
    rejected = (type_ == 0) | (unit == 0) | (range_ < 0) | (context == 0)
    return F.when(rejected, 0.0).otherwise(F.round(ranged * context, 3))


def status(conf: Column, unit: Column, veritas: bool = True) -> Column:
    """VALID from .9, AMBIGUOUS from .7 (rejected under veritas), INVALID_UNIT for a foreign unit, else REJECTED."""
    return F.when(unit == 0, "INVALID_UNIT").when(conf >= VALID, "VALID").when((conf >= AMBIGUOUS) & F.lit(not veritas), "AMBIGUOUS").otherwise("REJECTED")


def attribute_match(unit: Column, expected: Column, compatible: Column, dimensionless: Column, context: Column, aliases: Column, value: Column, low: Column, high: Column) -> Column:
    """How well a value with a unit in a context fits an attribute, rounded to three digits: six tenths for the unit (1 if
    expected, .8 if compatible, .5 without one where the attribute has no dimension; else the whole is 0), three for the
    context (1 with an alias in it, .7 with half of an alias' words, those of more than three letters), one for the range."""
    blank, text = F.coalesce(F.trim(unit) == "", F.lit(True)), F.lower(F.coalesce(context, F.lit("")))
    by_unit = F.when(blank, F.when(dimensionless, 0.5).otherwise(0.0)).when(F.array_contains(F.transform(expected, F.lower), F.lower(F.trim(unit))), 1.0).when(compatible, 0.8).otherwise(0.0)

    def half(alias: Column) -> Column:
        words = F.split(F.lower(alias), r"\s+")
        return F.size(F.filter(words, lambda w: (F.length(w) > 3) & text.contains(w))) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))

    by_context = F.when(F.exists(aliases, lambda a: text.contains(F.lower(a))), 1.0).when(F.exists(aliases, half), 0.7).otherwise(0.0)
    inside = 1.0 - F.try_divide(F.abs(value - (low + high) / 2), high - low) * 0.3
    below = F.when(low > 0, F.greatest(F.lit(0.0), 1.0 - F.try_divide(low - value, low))).otherwise(0.0)
    above = F.greatest(F.lit(0.0), 1.0 - F.try_divide(value - high, high))
    by_range = F.coalesce(F.when(value.between(low, high), inside).when(value < low, below).otherwise(above), F.lit(0.0))
    return F.when(by_unit == 0, 0.0).otherwise(F.round(0.6 * by_unit + 0.3 * by_context + 0.1 * by_range, 3))
