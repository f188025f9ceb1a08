"""Units and measured values as Column expressions.

The ontology is built from a rule: units with SI prefixes, and quotients of such units. Each unit has a factor to
its dimension's base unit; temperatures also have an offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: SI prefixes and the units that take them
PREFIXES = {"": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "m": 1e-3, "µ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}
SCALED = {  # dimension: {unit: factor}
    "energy": {"J": 1.0, "Wh": 3600.0, "eV": 1.602e-19}, "power": {"W": 1.0}, "voltage": {"V": 1.0}, "current": {"A": 1.0},
    "resistance": {"Ω": 1.0, "ohm": 1.0}, "capacitance": {"F": 1.0}, "charge": {"C": 1.0, "Ah": 3600.0}, "magnetic_field": {"T": 1.0},
    "frequency": {"Hz": 1.0}, "mass": {"g": 1e-3}, "length": {"m": 1.0}, "pressure": {"Pa": 1.0, "bar": 1e5}, "activity": {"Bq": 1.0, "Ci": 3.7e10},
    "concentration": {"M": 1000.0}, "conductance": {"S": 1.0}, "time": {"s": 1.0},
}
SINGLE = {
    "length": {"cm": 1e-2, "Å": 1e-10, "angstrom": 1e-10, "inch": 0.0254, "ft": 0.3048}, "area": {"m²": 1.0, "cm²": 1e-4, "mm²": 1e-6, "nm²": 1e-18},
    "volume": {"m³": 1.0, "L": 1e-3, "mL": 1e-6, "cm³": 1e-6, "cc": 1e-6}, "energy": {"cal": 4.184, "kcal": 4184.0}, "power": {"hp": 745.7},
    "pressure": {"atm": 101325.0, "torr": 133.322, "mmHg": 133.322, "psi": 6894.76}, "percentage": {"%": 1.0, "wt%": 1.0, "at%": 1.0, "vol%": 1.0, "mol%": 1.0, "percent": 1.0},
    "time": {"sec": 1.0, "min": 60.0, "h": 3600.0, "hr": 3600.0, "day": 86400.0, "week": 604800.0}, "angle": {"rad": 1.0, "deg": 0.017453292519943295, "°": 0.017453292519943295},
    "magnetic_field": {"G": 1e-4, "gauss": 1e-4}, "mass": {"ton": 1000.0, "lb": 0.45359237}, "irradiance": {"sun": 1000.0}, "temperature": {"K": 1.0, "°C": 1.0, "°F": 5 / 9},
    "magnetic_field_strength": {"Oe": 79.577},
}
OFFSETS = {"°C": 273.15, "°F": 459.67 * 5 / 9}
QUOTIENTS = {  # dimension: (numerator dimension, denominators with their factors)
    "energy_per_mass": ("energy", {"kg": 1.0, "g": 1e-3}), "energy_per_volume": ("energy", {"m³": 1.0, "L": 1e-3, "cm³": 1e-6, "mL": 1e-6}),
    "power_per_mass": ("power", {"kg": 1.0, "g": 1e-3}), "current_per_mass": ("current", {"kg": 1.0, "g": 1e-3, "mg": 1e-6}),
    "current_per_area": ("current", {"m²": 1.0, "cm²": 1e-4, "mm²": 1e-6}), "capacitance_per_mass": ("capacitance", {"kg": 1.0, "g": 1e-3}),
    "capacitance_per_area": ("capacitance", {"cm²": 1e-4, "m²": 1.0}), "charge_per_mass": ("charge", {"kg": 1.0, "g": 1e-3}),
    "conductivity": ("conductance", {"m": 1.0, "cm": 1e-2}), "electric_field": ("voltage", {"m": 1.0, "cm": 1e-2, "mm": 1e-3}),
    "voltage_per_time": ("voltage", {"s": 1.0}), "area_per_mass": ("area", {"kg": 1.0, "g": 1e-3}), "volume_per_mass": ("volume", {"kg": 1.0, "g": 1e-3}),
    "density": ("mass", {"m³": 1.0, "cm³": 1e-6, "mL": 1e-6, "L": 1e-3}), "irradiance": ("power", {"m²": 1.0, "cm²": 1e-4}),
}
BASE_UNITS = {
    "energy": "J", "power": "W", "voltage": "V", "current": "A", "resistance": "Ω", "capacitance": "F", "charge": "C", "magnetic_field": "T", "frequency": "Hz", "mass": "kg",
    "length": "m", "pressure": "Pa", "activity": "Bq", "concentration": "mol/m³", "conductance": "S", "time": "s", "area": "m²", "volume": "m³", "percentage": "%", "angle": "rad",
    "irradiance": "W/m²", "temperature": "K", "energy_per_mass": "J/kg", "energy_per_volume": "J/m³", "power_per_mass": "W/kg", "current_per_mass": "A/kg", "current_per_area": "A/m²",
    "capacitance_per_mass": "F/kg", "capacitance_per_area": "F/m²", "charge_per_mass": "C/kg", "conductivity": "S/m", "electric_field": "V/m", "voltage_per_time": "V/s",
    "area_per_mass": "m²/kg", "volume_per_mass": "m³/kg", "density": "kg/m³", "magnetic_field_strength": "A/m",
}
# fixed values: written variants of units
VARIANTS = {
    "f/g": ["f g-1", "f·g-1", "fg-1", "f per g"], "mf/g": ["mf g-1"], "mf/cm²": ["mf/cm2", "mf cm-2", "mfcm-2"], "f/cm³": ["f/cm3", "f cm-3"],
    "wh/kg": ["wh kg-1", "wh·kg-1"], "w/kg": ["w kg-1", "w·kg-1"], "a/g": ["a g-1", "a·g-1"], "mah/g": ["mah g-1", "mah·g-1"],
    "m²/g": ["m2/g", "m2 g-1", "m²g-1", "m2g-1"], "ω": ["ohm"], "ω·cm": ["ohm.cm"],
}
# fixed values: words of a cell that describes instead of measuring
DESCRIPTION_WORDS = (
    "synthesis", "preparation", "fabrication", "method", "process", "procedure", "carbonization", "pyrolysis", "annealing", "hydrothermal", "sol-gel", "material",
    "sample", "specimen", "composite", "substrate", "growth", "treatment", "reduction", "dispersed", "washed", "prepared",
)
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+|\s*[×xX·]\s*10\^?[-−]?\d+)?"


@cache
def ontology() -> tuple[tuple[str, str, float, float], ...]:
    """(dimension, unit, factor, offset) in a fixed order; a unit's first dimension counts."""
    rows: dict[str, dict[str, float]] = {}
    for dim, units in SCALED.items():
        rows[dim] = {p + u: s * f for u, f in units.items() for p, s in PREFIXES.items()}
    for dim, units in SINGLE.items():
        rows.setdefault(dim, {}).update(units)
    for dim, (top, bottoms) in QUOTIENTS.items():
        new = {f"{u}/{b}": f / g for u, f in rows[top].items() for b, g in bottoms.items()}
        rows.setdefault(dim, {}).update(new)
    return tuple((d, u, f, OFFSETS.get(u, 0.0)) for d, units in rows.items() for u, f in units.items())


def unit_table(spark: SparkSession) -> DataFrame:
    """(dimension, unit, factor, offset, base_unit, ordinal): a fixed, small table that may be broadcast."""
    rows = [(d, u, f, o, BASE_UNITS[d], i) for i, (d, u, f, o) in enumerate(ontology())]
    return spark.createDataFrame(rows, "dimension string, unit string, factor double, offset double, base_unit string, ordinal int")


def _map(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def plain_unit(unit: Column) -> Column:
    """Trimmed, white space collapsed, superscripts as digits and all dashes as "-"."""
    return F.translate(F.regexp_replace(F.trim(unit), r"\s+", " "), "−⁻–—¹²³⁰⁴⁵⁶⁷⁸⁹", "----1230456789")


def normalize_unit(unit: Column) -> Column:
    """Lower case, trimmed, and the canonical form of known written variants."""
    low = F.lower(F.trim(unit))
    dashes = F.translate(low, "−⁻", "--")
    return F.coalesce(F.element_at(_map((v, c) for c, vs in VARIANTS.items() for v in vs), dashes), low)


def slash_form(unit: Column) -> Column:
    """"F g-1" and "m2 g⁻¹" as "F/g" and "m²/g"."""
    flat = plain_unit(unit)
    quotient = F.regexp_replace(flat, r"^(\S+?)[ ·]([a-zA-Z]+)-1$", "$1/$2")
    return F.regexp_replace(F.regexp_replace(quotient, r"m2(?=$|/)", "m²"), r"m3(?=$|/)", "m³")


def with_dimension(df: DataFrame, unit_col: str) -> DataFrame:
    """``df`` with dimension, factor, offset and base_unit: by the exact unit first, then whatever its case."""
    units = unit_table(df.sparkSession)
    pick = lambda key: units.groupBy(key.alias("_k")).agg(F.min_by(F.struct("dimension", "factor", "offset", "base_unit"), "ordinal").alias("_u"))
    exact, folded = pick(F.col("unit")), pick(F.lower("unit")).withColumnsRenamed({"_k": "_k2", "_u": "_u2"})
    form = df.withColumn("_f", slash_form(F.col(unit_col)))
    found = form.join(F.broadcast(exact), F.col("_f") == F.col("_k"), "left").join(F.broadcast(folded), F.lower("_f") == F.col("_k2"), "left")
    return found.withColumn("_x", F.coalesce("_u", "_u2")).select(*df.columns, "_x.dimension", "_x.factor", "_x.offset", "_x.base_unit")


def to_base(value: Column, factor: Column, offset: Column) -> Column:
    return value * factor + offset


def number(text: Column) -> Column:
    """A written number as double: integers, decimals, exponents and "a × 10^n"."""
    flat = F.translate(F.trim(text), "−⁻", "--")
    return F.regexp_replace(flat, r"\s*[×xX·]\s*10\^?", "e").try_cast("double")


def parse_value(text: Column) -> Column:
    """struct(value, confidence, value_type): a range (its middle, .7), a value with error (.8), a single value (1),
    or the first number of a text (.4)."""
    s = F.trim(text)
    part = lambda p, i: number(F.regexp_extract(s, p, i))
    span = rf"^({NUMBER})\s*[-–—~∼≈]+\s*({NUMBER})$"
    error = rf"^({NUMBER})\s*(?:±|\+/-)\s*({NUMBER})$"
    single, some = rf"^({NUMBER})$", rf"({NUMBER})"
    made = lambda v, c, t: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(t).alias("value_type"))
    return (
        F.when(s.rlike(error), made(part(error, 1), 0.8, "with_error"))
        .when(s.rlike(span) & ~s.rlike(single), made((part(span, 1) + part(span, 2)) / 2, 0.7, "range"))
        .when(s.rlike(single), made(part(single, 1), 1.0, "single"))
        .when(s.rlike(some), made(part(some, 1), 0.4, "extracted"))
    )


def value_unit_pairs(text: Column) -> Column:
    """array<struct<value, unit>> of all numbers with a unit behind them, in order of appearance."""
    p = r"(\d+(?:\.\d+)?)\s*([a-zA-Z%/µ·²³Ω°]+)"
    values, units = (F.regexp_extract_all(text, F.lit(p), F.lit(i)) for i in (1, 2))
    return F.zip_with(values, units, lambda v, u: F.struct(v.alias("value"), u.alias("unit")))


def known_value_units(text: Column, known: Iterable[str] | None = None) -> Column:
    """array<struct<value, unit>>: numbers with something in brackets behind them, then numbers with a known unit, which ends
    where no letter or digit follows. Case doesn't count. Without a list all units of the ontology are known."""
    names = sorted(set(known) if known is not None else {u for _, u, _, _ in ontology()}, key=lambda u: (-len(u), u))
    in_brackets = r"(\d+\.?\d*)\s*[(\[]([^)\]]+)[)\]]"
    behind = rf"(?i)(\d+\.?\d*(?:e[-+]?\d+)?)\s*({'|'.join(re.escape(u) for u in names)})(?![A-Za-z0-9])"
    pairs = lambda p: F.zip_with(*(F.regexp_extract_all(text, F.lit(p), F.lit(i)) for i in (1, 2)), lambda v, u: F.struct(v.alias("value"), F.trim(u).alias("unit")))
    return F.concat(pairs(in_brackets), pairs(behind))


def cell_value(cell: Column, header: Column, known: Iterable[str] | None = None) -> Column:
    """struct(value, confidence, value_type, unit) of a table's cell: by its own first unit, else by its header's."""
    own = F.get(known_value_units(cell, known), F.lit(0))
    parsed = parse_value(F.coalesce(own["value"], F.trim(cell)))
    return F.struct(parsed["value"].alias("value"), parsed["confidence"].alias("confidence"), parsed["value_type"].alias("value_type"), F.coalesce(own["unit"], header).alias("unit"))


def header_unit(header: Column) -> Column:
    """The unit in a header's brackets, by the first form that occurs: a quotient or power ("F/g", "Wh kg-1"), one with a
    power, degree or per cent sign, a length, second or hertz as a word of its own. Null without one."""
    forms = (
        r"(?i)[(\[]([^)\]]+(?:/|g-|kg-|cm-|m-)[^)\]]*)[)\]]", r"[(\[]([^)\]]*[²³°%][^)\]]*)[)\]]",
        r"(?i)[(\[]((?:[^)\]]*[^A-Za-z)\]])?(?:nm|[μµ]m|um|mm|cm|m|s|Hz)(?:[^A-Za-z)\]][^)\]]*)?)[)\]]",
    )
    return slash_form(F.coalesce(*(F.nullif(F.regexp_extract(header, p, 1), F.lit("")) for p in forms)))


def validate_cell(cell: Column, units: Column, low: Column, high: Column) -> Column:
    """The cell as "value unit" in canonical form, or null if it is blank, a description, a year, or has no pair of
    the attribute's unit within its range. A bare number or range takes the first unit."""
    s = F.trim(cell)
    text = s.rlike(rf"(?i)\b(?:{'|'.join(DESCRIPTION_WORDS)})\b")
    year = s.rlike(r"^(?:19|20)\d{2}$")
    inside = lambda v: F.coalesce(v.between(low, high), F.lit(True))
    pairs = F.transform(value_unit_pairs(s), lambda p: F.struct(p["value"].alias("value"), normalize_unit(p["unit"]).alias("unit")))
    fits = F.filter(pairs, lambda p: (F.coalesce(F.size(units), F.lit(0)) <= 0) | F.array_contains(units, p["unit"]))
    fits = F.get(F.filter(fits, lambda p: inside(p["value"].cast("double"))), F.lit(0))
    first = F.coalesce(F.get(units, F.lit(0)), F.lit(""))
    bare = s.rlike(r"^\d+(?:\.\d+)?$") & inside(F.regexp_extract(s, r"^(\d+(?:\.\d+)?)$", 1).try_cast("double"))
    r = r"^(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)$"
    span = s.rlike(r) & inside(F.regexp_extract(s, r, 1).try_cast("double")) & inside(F.regexp_extract(s, r, 2).try_cast("double"))
    missing = s.isNull() | s.isin("", "nan", "None")
    return (
        F.when(missing | text | year, F.lit(None).cast("string"))
        .when(F.size(pairs) > 0, F.concat(fits["value"], F.lit(" "), fits["unit"]))
        .when(bare | span, F.trim(F.concat(s, F.lit(" "), first)))
    )
