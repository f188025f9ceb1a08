"""Every query with SQL gives DuckDB's result; the others run and are held against loops elsewhere."""

from __future__ import annotations

import pytest
from compare import connect, same

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_anchored_filter_against_loop(spark):
    from statistics import median

    from lodestone.plans.curve_queries import ticks

    rows = [tuple(r) for r in ticks(spark, SF).collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES["anchored_tick_filter"](spark, SF).collect())
    want = []
    for axis in {r[0] for r in rows}:
        pts = sorted((px, v) for a, px, v in rows if a == axis)
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(pts, pts[1:])]
        kept = pts[:1]
        for px, v in pts[1:]:
            expected = (px - kept[-1][0]) * median(slopes)
            if abs(v - kept[-1][1] - expected) <= max(abs(expected) * 0.2, 0.1):
                kept.append((px, v))
        want += [(axis, *p) for p in kept]
    assert got == sorted(want)


def test_greedy_matching_against_loop(spark):
    from lodestone.operators.candidates import greedy_matching

    rows = [(1, "a", 5.0, 9.0, 1), (1, "b", 5.0, 8.0, 2), (1, "b", 6.0, 7.0, 3), (1, "a", 6.0, 8.5, 4), (2, "a", 5.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "file int, attr string, number double, score double, seq long")
    assert sorted(tuple(r) for r in greedy_matching(df).collect()) == [rows[0], rows[2], rows[4]]


def test_smoothing_stays_within_the_points(spark):
    out = catalog.QUERIES["curve_smoothing"](spark, SF)
    assert out.groupBy("curve").count().filter("count > 50").count() == 0


def test_smoothing_equals_the_dense_solution():
    import numpy as np
    from lodestone.operators import curves

    for n in (4, 5, 9, 200):
        y = np.random.default_rng(n).normal(size=n)
        d = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(curves.second_difference_fit(y), np.linalg.solve(np.eye(n) + 0.5 * d.T @ d, y))


def test_islands_do_not_depend_on_the_bucket(spark):
    import random

    from lodestone.operators import curves

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randrange(3_000)) for _ in range(300)], "g string, pos long")
    found = [sorted(map(tuple, curves.islands(df, "g", "pos", 10, b).select("g", "first", "last", "n").collect())) for b in (7, 100, 1 << 16)]
    assert found[0] == found[1] == found[2]


def test_greedy_matching_and_json_equal_loops(spark):
    import json
    import random

    from lodestone.functions.text import _first_json
    from lodestone.operators import candidates

    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice("xyz"), float(rng.randrange(6)), float(rng.randrange(9)), i) for i in range(120)]
    got = {tuple(r) for r in candidates.greedy_matching(spark.createDataFrame(rows, "file long, attr string, number double, score double, seq long")).collect()}
    want, seen = set(), set()
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if (r[0], "n", r[2]) not in seen and (r[0], "a", r[1]) not in seen:
            seen |= {(r[0], "n", r[2]), (r[0], "a", r[1])}
            want.add(r)
    assert got == want
    for _ in range(300):
        value = {rng.choice('a"\\{') * rng.randint(0, 3): [rng.choice(['x', '}"', '[\\', 1, None, {"k": "]"}]) for _ in range(rng.randint(0, 3))] for _ in range(2)}
        assert json.loads(_first_json("so: " + json.dumps(value) + " } done")) == value
    assert _first_json("no") is None and _first_json("{]") is None and _first_json('{"a": "}') is None


def test_docs_parse_samples(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import units

    cells = ["123.5", "10-20", "1.5e-3", "10.5 ± 0.3", "none", "-4", "3 × 10^2", "about 7 of them", None]
    got = [tuple(r[0]) if r[0] else None for r in spark.createDataFrame([(c,) for c in cells], "c string").select(units.parse_value(F.col("c"))).collect()]
    assert got == [(123.5, 1.0, "single"), (15.0, 0.7, "range"), (0.0015, 1.0, "single"), (10.5, 0.8, "with_error"), None, (-4.0, 1.0, "single"), (300.0, 1.0, "single"), (7.0, 0.4, "extracted"), None]


def test_conversion_factors(spark):
    from lodestone.functions import units

    rows = [("mWh/g", 3600.0, 0.0), ("mA/mg", 1000.0, 0.0), ("cm²/g", 0.1, 0.0), ("cm³/g", 1e-3, 0.0), ("mWh/cm³", 3.6e6, 0.0), ("°C", 1.0, 273.15), ("kJ", 1000.0, 0.0), ("zz", None, None)]
    df = spark.createDataFrame([(u,) for u, _, _ in rows], "unit string")
    got = {r["unit"]: (r["factor"], r["offset"]) for r in units.with_dimension(df, "unit").collect()}
    for unit, factor, offset in rows:
        assert got[unit] == (pytest.approx(factor), pytest.approx(offset)) if factor else got[unit] == (None, None)


def test_consolidation_micro_fixtures(spark):
    from lodestone.operators import merge

    rows = [
        ("single table", "table", "1200", None), ("low table", "table", "1200", 0.6), ("table conflict", "table", "1200", None), ("table conflict", "table", "1300", None),
        ("agreeing", "table", "1200", None), ("agreeing", "text", "1200", None), ("unit text differs", "table", "1200", None), ("unit text differs", "text", "1200 m²/g", None),
        ("plot only", "plot", "5 nm", None), ("confident text", "text", "5 nm", 0.97),
    ]
    df = spark.createDataFrame([(f, "a", s, v, c, i) for i, (f, s, v, c) in enumerate(rows)], "file string, attr string, source string, value string, confidence double, seq int")
    got = {r["file"]: r["value"] for r in merge.consolidate(df, ["seq"]).collect()}
    assert got == {"single table": "1200", "low table": "1200", "table conflict": None, "agreeing": "1200", "unit text differs": None, "plot only": None, "confident text": "5 nm"}


def test_token_batches_against_loop(spark):
    from lodestone.operators.models import token_batches

    sizes = [300, 300, 10, 600, 100, 399, 1, 0, 500]
    df = spark.createDataFrame([(k, i, t) for k in ("a", "b") for i, t in enumerate(sizes)], "k string, i int, t int")
    want, total, batch = [], 0, 0
    for t in sizes:
        if total and total + t > 500:
            total, batch = 0, batch + 1
        total += t
        want.append(batch)
    for k in ("a", "b"):
        assert [r["batch"] for r in token_batches(df, "k", "i", "t", 500).filter(f"k = '{k}'").orderBy("i").collect()] == want


def test_clustered_boxes(spark):
    from lodestone.operators.figures import clustered_boxes

    boxes = [(1, i, x, y, x + 10.0, y + 10.0) for i, (x, y) in enumerate([(0.0, 0.0), (400.0, 0.0), (200.0, 0.0), (100.0, 0.0), (300.0, 0.0), (0.0, 900.0)])]
    df = spark.createDataFrame(boxes, "page int, box int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in clustered_boxes(df, ["page"], 100.0).collect())
    assert got == [(1, 0.0, 0.0, 410.0, 10.0, 5), (1, 0.0, 900.0, 10.0, 910.0, 1)]


def test_text_score_gives_each_measurement_its_own_window(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import pages

    far = "x" * 81
    texts = ["capacitance of 200 f/g, 210 f/g, 220 f/g and 230 f/g", f"5 f/g {far} capacitance", "5 f/g" + " " * 69 + "capacitance", "5 f/g" + " " * 70 + "capacitance", "1 f/g " * 4, "1 f/g " * 5, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(pages.text_score(F.col("t"), "f/g", "capacitance")).collect()]
    assert got == [0.75, 0.0, 0.4, 0.0, 0.0, 0.4, 0.0, 0.0]


def test_term_hits_finds_whole_phrases(spark):
    from lodestone.operators.screening import term_hits

    names = ["specific capacitance", "surface-area", "capacité", "électrode", "BET", "a b a", "°C"]
    terms = spark.createDataFrame([(t, "primary", "x") for t in names], "term string, strength string, attribute string")
    texts = ["The Specific capacitance, not specific  capacitance or unspecific capacitance", "surface-area; surface area, surface-areas", "l'électrode à capacité, capacités", "by BET a b a b a at 25 °C or 25°C", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = sorted((r["i"], r["term"], r["word"]) for r in term_hits(df, "i", "t", terms).collect())
    assert got == [(0, "specific capacitance", 1), (1, "surface-area", 0), (2, "capacité", 2), (2, "électrode", 1), (3, "BET", 1), (3, "a b a", 2), (3, "a b a", 4), (3, "°C", 9), (3, "°C", 12)]


def test_title_dedup_reads_whole_texts_of_all_documents(spark, tmp_path):
    """Texts that share 40 leading characters stay apart, and every even id is stored."""
    import duckdb

    head = "the same forty leading characters of all "
    rows = [(1, head + "one"), (2, head + "Two"), (3, head + "two"), (5, head + "five"), (7, head + "FIVE."), (10, "ten")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r[0] for r in catalog.QUERIES["title_dedup"](spark, str(tmp_path)).collect()) == [1, 5]
    same(catalog.QUERIES["title_dedup"](spark, str(tmp_path)), duckdb.sql(catalog.ORACLE_SQL["title_dedup"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")))


def test_every_offset_and_every_event_takes_part(spark, con):
    words = con.sql("select sum(len(string_split(text, ' '))) from benchmark").fetchall()[0][0]
    assert catalog.QUERIES["offset_to_word"](spark, SF).count() == words
    islands = catalog.QUERIES["gaps_islands"](spark, SF).collect()
    assert sum(r["n"] for r in islands) == con.sql("select count(*) from events").fetchall()[0][0] and len(islands) > 100


def test_empty_tables(spark):
    """Operators give empty results for empty tables."""
    from lodestone.operators import candidates, curves, merge, pages

    points = spark.createDataFrame([], "curve int, x double, y double")
    assert curves.rolling_median_filter(points, "curve").count() == curves.neighbour_filter(points, "curve").count() == curves.smoothed(points, "curve").count() == 0
    rows = spark.createDataFrame([], "file string, attr string, source string, value string, confidence double, proof string, seq int")
    assert merge.wide(merge.consolidate(rows, ["seq"]), merge.joined_proofs(rows, ["seq"]), ["a"]).count() == 0
    assert candidates.best_or_largest(rows.withColumn("score", rows.confidence), ["seq"], ["a"]).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert pages.lines(docs, "id", "text").count() == 1


def test_false_positive_rules_hold_for_their_attributes_only(spark):
    from lodestone.operators import candidates
    from pyspark.sql import functions as F

    rows = [
        ("a potential window of -1.2 V was found", "-1.2", "potential window", ["V"], None),
        ("a potential window of -6 V was found", "-6", "potential window", ["V"], "range"),
        ("the current density was held below 5 A/g here", "5", "current density", ["A/g"], None),
        ("pores below 5 nm were found", "5", "pore size", ["nm"], "bound"),
        ("in 2010 it was 2010 F/g", "2010", "specific capacitance", ["F/g"], "year"),
        ("it was 2010 F/g", "2010", "colour", ["F/g"], None),
        ("ms of 0.005 emu/g was measured", "0.005", "saturation magnetization", ["emu/g"], "range"),
        ("frequency (300 kHz)", "300", "AMF frequency", ["kHz"], "axis label"),
        ("a voltage of 12 V was applied", "12", "voltage", ["V"], "impossible"),
        ("the carbon content was 80 % with PVDF", "80", "carbon content", ["%"], "binder"),
        (None, "5", "colour", ["nm"], "no unit"),
    ]
    df = spark.createDataFrame(rows, "line string, value string, attr string, units array<string>, want string")
    got = df.withColumn("got", candidates.text_false_positive(F.coalesce("line", F.lit("")), F.col("value"), F.col("attr"), F.col("units"))).collect()
    assert [(r["line"], r["got"]) for r in got] == [(r["line"], r["want"]) for r in got]


def test_too_many_aliases_are_an_error(spark, monkeypatch):
    import pytest
    from lodestone.operators import matching

    monkeypatch.setattr(matching, "MAX_LISTED", 2)
    schema = spark.createDataFrame([("a", ["b", "c"], ["g"], 0)], "attribute string, aliases array<string>, units array<string>, ordinal int")
    with pytest.raises(ValueError):
        matching.header_attribute(spark.createDataFrame([("a (g)",)], "h string"), "h", schema)


def test_answers_on_headers_that_say_nothing_leave_the_match_by_rules(spark):
    from lodestone.operators import models

    headers = spark.createDataFrame([(i, "h", "rule", "g", 0.5) for i in range(6)], "k int, header string, attribute string, unit string, confidence double")
    answers = [(0, "not json"), (1, '{"headers": []}'), (2, '[{"original_header": "H", "mapped_attribute": "a"}]'), (3, '[{"original_header": "h", "mapped_attribute": ""}]'), (4, None), (5, '[{"original_header": "h", "mapped_attribute": "a"}]')]
    got = models.reviewed_headers(headers, spark.createDataFrame(answers, "k int, answer string"), "k").orderBy("k").collect()
    assert [(r["attribute"], r["unit"], r["confidence"]) for r in got] == [("rule", "g", 0.5)] * 5 + [("a", None, 0.0)]


def test_folds_begin_anew_with_each_key(spark):
    from lodestone.operators.curves import anchored_filter
    from lodestone.operators.models import token_batches

    df = spark.createDataFrame([(k, i, n) for k in (None, "a", "b") for i, n in enumerate([300, 300, None, 200, 600, 1])], "k string, i int, t int")
    got = token_batches(df.repartition(3), "k", "i", "t", 500).orderBy("k", "i").collect()
    assert [r["batch"] for r in got] == [0, 1, 1, 1, 2, 3] * 3
    ticks = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 1, 9.0), ("c", 0, 0.0), ("c", 1, 1.0), ("c", 2, 7.0), ("c", 3, 3.0), ("c", 4, None)], "axis string, px int, v double")
    kept = sorted(tuple(r) for r in anchored_filter(ticks, "axis", "px", "v").collect())
    assert kept == [("a", 1.0, 5.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 1.0, 1.0), ("c", 3.0, 3.0)]


def test_zero_ticks_lone_points_and_empty_headers_are_no_errors(spark):
    from lodestone.operators import curves, matching

    ticks = spark.createDataFrame([("zero", 0, 0.0), ("zero", 1, 10.0), ("zero", 2, 20.0), ("log", 0, 1.0), ("log", 1, 10.0), ("log", 2, 100.0), ("one", 0, 0.0)], "axis string, px int, v double")
    assert {r["axis"]: r["is_log"] for r in curves.log_scale(ticks, "axis", "px", "v").collect()} == {"zero": False, "log": True, "one": False}
    lone = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 9.0)], "curve string, x double, y double")
    assert sorted((r["curve"], r["outlier"]) for r in curves.neighbour_filter(lone, "curve").collect()) == [("a", False), ("b", True), ("b", True)]
    aliases = spark.createDataFrame([("", "a", 0), ("x", "b", 1)], "alias string, attribute string, ordinal int")
    headers = spark.createDataFrame([("",), (None,), ("x",)], "h string")
    assert {r["h"]: r["match"] for r in matching.header_match(headers, "h", aliases).collect()} == {"": None, None: None, "x": 1.0}
    schema = spark.createDataFrame([("", [""], ["g"], 0)], "attribute string, aliases array<string>, units array<string>, ordinal int")
    assert [r["attribute"] for r in matching.header_attribute(headers, "h", schema).collect()] == [None] * 3
