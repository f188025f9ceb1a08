"""Cases of the third round's findings."""

from __future__ import annotations

from compare import same

from lodestone.plans import catalog


def against_sql(spark, tmp_path, name, **tables):
    """The query and its SQL on small tables of one's own: name=(rows, schema)."""
    import duckdb

    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same(catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLE_SQL[name]))


def test_points_off_by_exactly_the_limit_are_judged_as_by_sql(spark, tmp_path):
    from datetime import datetime

    curves = [[3.0, 2.4, 0.0, 0.8, 3.0], [0.9, 0.1, 0.5], [1.7, 1.4, 2.0], [0.6, 1.0, 0.2], [0.92, 0.68, 0.8], [0.0, -0.7, 1.1, -1.6, -1.9], [0.2, 1.0, 1.8], [None, 1.0, 1.0, 5.0], [2.0]]
    rows = [(u * 10 + i, datetime(2024, 1, 1), u, y) for u, ys in enumerate(curves) for i, y in enumerate(ys)]
    against_sql(spark, tmp_path, "neighbour_outliers", events=(rows, "event_id long, ts timestamp, user_id long, value double"))


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path):
    texts = ["the ä undßbebe", "the enung undüber", "the éund", "the und", "thé the_ 7 ofé", "ßthe 5 ofé", "the 5\x0bof", "thatßand", "that é è ê ë and", "the bund ation", "", None]
    against_sql(spark, tmp_path, "relevance_score", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_words_of_measured_lines_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["5 nm éhigher", "5 nm higherß", "5 nm bhigher", "5 nm _mixed", "5 nm ümodeledü", "5 nm"]
    against_sql(spark, tmp_path, "measured_lines", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_terms_with_other_characters_at_their_ends_keep_their_boundaries(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import screening

    df = spark.createDataFrame([("électrode",), ("photoélectrode",), ("at 5 %x",)], "t string")
    assert [r[0] > 0 for r in df.select(screening.relevance(F.col("t"), ["électrode"], [])).collect()] == [True, False, False]


def test_greedy_matching_calls_python_by_the_batch_and_not_by_the_file(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from lodestone.operators.candidates import greedy_matching

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", None)
    nan = float("nan")
    rows = [
        (1, "a", 5.0, 9.0, 1), (1, "b", 5.0, 8.0, 2), (1, "b", None, 7.0, 3), (1, "c", None, 7.0, 4), (1, "d", nan, 6.0, 5), (1, "e", nan, 6.0, 6),
        (2, "a", 5.0, nan, 1), (2, "b", 5.0, None, 0), (2, "c", 6.0, -1.0, 9), (2, "d", 6.0, nan, None), (None, "a", 0.0, 1.0, 1), (None, "b", -0.0, 1.0, 2), (None, None, 1.0, 0.0, 3), (None, None, 2.0, 0.0, 4),
    ]
    got = greedy_matching(spark.createDataFrame(rows, "file long, attr string, number double, score double, seq long").repartition(4)).collect()
    kept = {(r["file"], r["attr"], r["seq"]) for r in got}
    assert kept == {(1, "a", 1), (1, "b", 3), (1, "c", 4), (1, "d", 5), (1, "e", 6), (2, "b", 0), (2, "c", 9), (None, "a", 1), (None, None, 3)} and len(got) == len(kept)


def test_exploded_ticks_are_not_broadcast(spark):
    for name in ("tick_values", "label_nearest_tick", "proximity_pairs"):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_words_without_a_term_go_nowhere(spark):
    """Terms without a hint are broadcast too, and only runs that begin with a term's first word are made for the join."""
    from lodestone.operators import screening

    for names, first in ((["the", "und"], "('the','und')"), (["of the", "°C", "the"], None)):
        terms = spark.createDataFrame([(t, "primary", "x") for t in names], "term string, strength string, attribute string")
        df = screening.term_hits(spark.createDataFrame([(1, "all of the und 5 °C")], "i int, t string"), "i", "t", terms)
        assert df.count() == len(names)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and ("filter(sequence(" in plan or first and " IN (the,und)" in plan)


def test_term_hits_are_the_same_beyond_the_listed_terms(spark, monkeypatch):
    from lodestone.operators import screening

    texts = ["The of the, of  the of-the and THE", "°C the°C 5 °C", "of", "", None, "the of the of the"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for names in (["the", "of the", "°C", "the of the"], ["the", "of"]):
        terms = spark.createDataFrame([(t, "primary", "x", o) for o, t in enumerate(names)], "term string, strength string, attribute string, ordinal int")
        found = []
        for most in (20_000, 1):
            monkeypatch.setattr(screening, "MAX_TERMS", most)
            found.append(sorted(tuple(r) for r in screening.term_hits(df, "i", "t", terms).collect()))
        assert found[0] == found[1] and len(found[0]) > 9


def test_aliases_and_proximity_equal_sql_on_odd_documents(spark, tmp_path):
    texts = ["the and was die und", "and license und", "licensed and", "the", "", None, "The THE and the licensed", "die und was"]
    docs = [(i % 7, t) for i, t in enumerate(texts)] + [(None, "the and licensed"), (None, "with x by by with"), (9, "with " * 50 + "by " * 50)]
    for name in ("triggered_aliases", "keyword_measurement_proximity"):
        against_sql(spark, tmp_path / name, name, documents=(docs, "doc_id long, text string"))


def test_documents_are_read_once_for_keywords_and_once_for_aliases(spark):
    df = catalog.QUERIES["triggered_aliases"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
