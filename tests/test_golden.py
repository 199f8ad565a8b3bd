"""Hand-computed tables."""

from pyspark.sql import functions as F

from tallybook.functions import scales, text
from tallybook.operators import clean, disclose, link, totals, uptake

TRIPLE = ("a", "b", "p")


def triples(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a long, b long")
    return df.withColumn("p", F.round(F.try_divide(100.0 * F.col("b"), "a"), 4))


def cells(df):
    return [(r["a"], r["b"], r["p"]) for r in df.orderBy("id").collect()]


def test_masks_to_text_keeps_null(spark):
    table = spark.createDataFrame([(0, None), (-1, -1.0), (-2, -2.0), (10, 12.5)], "part long, per double")
    got = {tuple(r) for r in disclose.masks_to_text(table, ["part"], ["per"]).collect()}
    assert got == {("0", None), ("X", "X"), ("Y", "Y"), ("10", "12.5")}


def test_suppress_triple_masks_the_whole_first(spark):
    got = cells(disclose.suppress_triple(triples(spark, [(100, 97), (100, 3), (5, 5), (12, 6), (12, 8), (6, 0), (103, 97)]), TRIPLE))
    assert got == [
        (100, -2, -2.0), (100, -1, -1.0), (-1, -1, -1.0), (12, 6, 50.0), (12, -2, -2.0), (6, 0, 0.0), (103, 97, 94.2),
    ]


def test_round_to_five(spark):
    got = cells(disclose.round_to_five(triples(spark, [(7, 6), (8, 3), (12, 0), (0, 0), (13, 12), (-1, -1), (103, -2)]), TRIPLE))
    assert got == [(6, 6, 100.0), (10, 3, 30.0), (10, 0, 0.0), (0, 0, 0.0), (15, 10, 66.7), (-1, -1, -1.0), (105, -2, -2.0)]


def test_suppress_cross(spark):
    df = spark.createDataFrame(
        [(0, 100, 97, 97.0, 98, 95, 96.9), (1, 100, 50, 50.0, 40, 47, 1.0), (2, 10, 9, 1.0, 10, 3, 30.0)],
        "id int, a long, b long, c double, x long, y long, z double",
    )
    out = disclose.suppress_cross(df, ("a", "b", "c"), ("x", "y", "z")).orderBy("id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in out] == [(-2, -2, -2.0), (40, -2, -2.0), (10, 3, 30.0)]


def test_suppress_by_providers(spark):
    df = triples(spark, [(20, 12), (9, 4)]).withColumn("schools", F.lit(5))
    assert cells(disclose.suppress_triple_by_providers(df, TRIPLE, "schools")) == [(20, -2, -2.0), (-1, -1, -1.0)]


def test_suppress_small_and_mask_le_five(spark):
    df = spark.createDataFrame([(5, 20.0), (6, 30.0)], "total long, per double")
    out = disclose.suppress_small(df, "total", "per").orderBy("total").collect()
    assert [tuple(r) for r in out] == [(0, 0.0, "X"), (6, 30.0, "")]
    counts = spark.createDataFrame([(n,) for n in (0, 5, 6, 8, 12)], "n long").select(disclose.mask_le_five(F.col("n")).alias("n"))
    assert [r["n"] for r in counts.collect()] == ["X", "X", "5", "10", "10"]


def test_anonymise_table_totals_come_from_rounded_values(spark):
    df = spark.createDataFrame(
        [("x", "1", 13, 12, 92.3), ("y", "2", 40, 3, 7.5), (None, "3", 50, 20, 40.0)], "l string, m string, a long, b long, p double"
    )
    out = {r["l"]: tuple(r) for r in disclose.anonymise_table(df, disclose.layout("five", df.columns)).collect()}
    assert out == {
        "x": ("x", "1", "15", "Y", "Y"), "y": ("y", "2", "40", "X", "X"), "TOTAL": ("TOTAL", "", "55", "13", "23.6"),
    }


def test_round_if_any_small(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (2, 48)], "schools long, students long")
    out = disclose.round_if_any_small(df, "students", "schools").collect()
    assert [r["students"] for r in out] == [5, 0, 50]
    calm = spark.createDataFrame([(1, 33), (2, 48)], "schools long, students long")
    assert [r["students"] for r in disclose.round_if_any_small(calm, "students", "schools").collect()] == [33, 48]


def test_mask_small_groups(spark):
    df = spark.createDataFrame([("g", 3, 4), ("h", 2, 0), ("i", 1, 30), ("Totals", 6, 6)], "g string, schools long, n long")
    out = disclose.mask_small_groups(df, [("n", "schools", "n")], F.col("g") == "Totals")
    assert [r["n"] for r in out.collect()] == ["X", "0", "30", "6"]


def test_grade_scales(spark):
    df = spark.createDataFrame([(float(p),) for p in [0, 1, 4, 8, 16, 40, 58, 99]], "p double")
    letters = [r[0] for r in df.select(scales.points_to_letter(F.col("p"))).collect()]
    assert letters == ["U", "G", "D", "*", "G", "C", "*", None]
    back = spark.createDataFrame([("*",), ("E",), ("?",)], "g string")
    assert [tuple(r) for r in back.select(scales.letter_to_points(F.col("g")), scales.letter_to_points(F.col("g"), "Alevel"), scales.letter_to_points(F.col("g"), "tariff")).collect()] == [
        (8.0, 300.0, 70.0), (3.0, 150.0, 20.0), (None, None, None)]
    new = spark.createDataFrame([("1", 8.5), ("1", 1.5), ("1", 6.0), ("2210", 8.5)], "subject string, points double")
    assert [r["points"] for r in clean.rescale_points(new).collect()] == [8.0, 2.0, 6.0, 8.5]
    averages = spark.createDataFrame([(7.6,), (7.5,), (0.2,), (0.0,), (None,)], "a double")
    assert [r[0] for r in averages.select(scales.average_to_band(F.col("a"))).collect()] == ["A*", "A", "U", "X", "X"]


def test_labels_and_classes(spark):
    df = spark.createDataFrame([("WHIT",), ("",), ("ZZ",), (None,)], "e string")
    assert [r[0] for r in df.select(scales.decode(F.col("e"), scales.ETHNICITY_MAJOR, "ERROR")).collect()] == ["White", "Missing", "ERROR", "ERROR"]
    kinds = spark.createDataFrame([("Community special school", None), ("Other independent school", None), ("Academy", "Selective"), ("Academy", None), ("Special", "Non-selective")], "t string, s string")
    assert [r[0] for r in kinds.select(scales.provider_class(F.col("t"), F.col("s"))).collect()] == ["Special", "Independent", "Grammar", "Comprehensive", "Comprehensive"]
    p = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.07,), (0.5,)], "p double")
    assert [r[0] for r in p.select(scales.stars(F.col("p"))).collect()] == ["***", "** ", "*  ", ".  ", "   "]
    titles = spark.createDataFrame([("Computing",), ("Fashion and Media",), ("Work in IT",), ("Maths",)], "t string")
    assert [r["t"] for r in clean.keyword_filter(titles, "t", text.INCLUDE_TITLES, text.EXCLUDE_TITLES).collect()] == ["Computing", "Work in IT"]


def test_attempts(spark):
    schema = "year int, pupil string, provider long, level int, subject string, qualification string, grade string, points double"
    df = spark.createDataFrame([
        (2017, "p", 1, 310, "s", "q", "X", 0.0), (2017, "p", 1, 310, "s", "q", "U", 0.0), (2017, "p", 2, 310, "s", "r", "A", 7.0),
        (2017, "p", 1, 310, "s", "r", "B", 6.0), (2016, "p", 1, 310, "s", "q", "A", 7.0), (2017, "o", 1, 111, "s", "q", "A", 7.0),
    ], schema)
    out = {(r["pupil"], r["provider"], r["qualification"], r["points"]) for r in clean.best_attempt(df, 2017, [310]).collect()}
    assert out == {("p", 1, "q", 0.0), ("p", 2, "r", 7.0)}
    people = spark.createDataFrame([("a", "M"), ("a", "M"), ("b", "M"), ("b", "F"), ("c", None)], "pupil string, gender string")
    assert sorted(r["pupil"] for r in clean.drop_ambiguous_keys(people, "pupil").collect()) == ["a", "c"]


def test_backfill(spark, rows):
    destination = spark.createDataFrame([("1", ""), ("2", None), ("3", "own"), ("4", " ")], "pupil string, eth string")
    history = spark.createDataFrame(
        [("1", 2014, "old"), ("1", 2015, ""), ("2", 2013, "x"), ("2", 2015, "y"), ("3", 2015, "z"), ("2", 2015, "y")],
        "pupil string, year int, v string",
    )
    out = rows(link.backfill_across_years(destination, history, {"v": "eth"}), "pupil")
    assert {k: r["eth"] for k, r in out.items()} == {"1": "old", "2": "y", "3": "own", "4": None}
    assert link.backfill_column(destination, history, "missing", "eth").collect() == destination.collect()
    assert link.backfill_column(destination, history, "v", "eth").count() == 4
    assert "new" in link.backfill_column(destination, history, "v", "new").columns


def test_criteria_leave_out_unlabelled_groups(spark):
    df = spark.createDataFrame(
        [("p1", 10, 1, 30.0, 8, 40.0, 40.0), (None, 9, 1, 1.0, 9, 1.0, 1.0), ("Not applicable", 9, 1, 1.0, 9, 1.0, 1.0), ("none", 20, 0, 100.0, 0, None, None)],
        "label string, students long, sub_schools long, total_grade double, sub_students long, sub_all_grades double, sub_grade double",
    ).withColumn("schools", F.lit(1).cast("long"))
    out = {r["label"]: r for r in uptake.provision_by_criteria(df, ["label"]).collect()}
    assert set(out) == {"p1", "none", "Totals"}
    assert (out["p1"]["students"], out["p1"]["sub_students"], out["none"]["sub_students"]) == ("10", "8", "0")
    assert out["Totals"]["sub_students"] == "8" and out["Totals"]["pc_schools"] == 50.0 and out["none"]["grade_avg_subject"] == "0"


def test_total_row_tells_null_label_from_total(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, n long")
    out = totals.total_row(df, ["g"], ["n"]).collect()
    assert sorted((r["g"] or "", r["is_total"], r["n"]) for r in out) == [("", False, 2), ("Totals", True, 3), ("a", False, 1)]


def test_criteria_report_keeps_years_and_criteria_apart(spark):
    df = spark.createDataFrame(
        [(2014, "p1", "a", "Mixed", 10, 8), (2014, "p2", "b", None, 40, 20), (2015, "p1", "a", "Mixed", 40, 33), (2015, "p2", "", "Boys", 30, 22)],
        "year int, provider string, area string, sex string, students long, sub_students long",
    ).withColumns({
        "schools": F.lit(1).cast("long"), "sub_schools": F.lit(1).cast("long"), "criterion": F.lit("clash"), "label": F.lit("clash"),
        **{c: F.lit(60.0) for c in ("total_grade", "sub_all_grades", "sub_grade")},
    })
    close = df.withColumn("sub_students", F.when((F.col("year") == 2014) & (F.col("provider") == "p1"), 3).otherwise(F.col("sub_students")))
    tables = {"area": {"area": F.col("area")}, "both": {"sex": F.col("sex"), "area": F.col("area")}}
    out = {tuple(r)[:4]: r for r in uptake.criteria_report(close, tables, ["year"]).collect()}
    assert set(out) == {
        (2014, "area", "a", ""), (2014, "area", "b", ""), (2014, "area", "Totals", ""), (2014, "both", "Mixed", "a"), (2014, "both", "Totals", ""),
        (2015, "area", "a", ""), (2015, "area", "Totals", ""), (2015, "both", "Mixed", "a"), (2015, "both", "Boys", ""), (2015, "both", "Totals", ""),
    }
    # One close group of 2014 rounds that year's takers only: 3 to 5 (still masked below), 33 stays.
    assert out[(2014, "area", "Totals", "")]["sub_students"] == "25" and out[(2015, "area", "a", "")]["sub_students"] == "33"
    assert out[(2015, "both", "Totals", "")]["sub_students"] == "55"
    assert uptake.criteria_report(df.limit(0), tables, ["year"]).collect() == []
