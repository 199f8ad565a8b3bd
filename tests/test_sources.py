"""Readers and writers on small files."""

import json

import pytest

from tallybook.operators import link, uptake
from tallybook.sources import fields, pipeline, scan, sink


def test_field_spec_and_pattern_selection(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"KS4": {"2016": {"_GENDER": "GENDER", " _QAN ": " QAN", "NOPE": "EAL"}, "2017": {"_X": "X"}}}))
    spec = fields.read_field_spec(spark, str(path))
    assert spec.count() == 4
    pairs = fields.fields_of(spec, "KS4", 2016)
    assert sorted(pairs) == [("NOPE", "EAL"), ("_GENDER", "GENDER"), ("_QAN", "QAN")]
    df = spark.createDataFrame([("m", " ", "1")], "KS4_GENDER string, KS4_QAN string, OTHER string")
    out = fields.select_by_pattern(df, pairs, {"EAL": "int"})
    assert dict(out.dtypes)["EAL"] == "int" and out.first().asDict() == {"GENDER": "m", "QAN": None, "EAL": None}
    with pytest.raises(fields.AmbiguousPattern):
        fields.select_by_pattern(df, [("KS4_", "X")])


def test_pupils_are_cleaned_on_the_way_in(spark, tmp_path):
    path = tmp_path / "pupils.txt"
    path.write_text(
        "KS5_PupilMatchingRefAnonymous\tKS5_RECTYPE\tKS5_GENDER\tKS5_URN\tKS4_FSM\tEVERFSM_6_S\tEVERFSM_3_S\tFSMeligible_S\n"
        "a\t1\tf\t10\t\t\t1\t0\n" "a\t1\tf\t11\t\t\t1\t0\n" "a\t2\tm\t10\t\t\t\t\n" "b\t1\tM\t10\t0\t1\t1\t1\n" "c\t1\tM\t10\t\t\t\t\n" "c\t1\tF\t10\t\t\t\t\n"
    )
    pairs = [("PupilMatchingRef", "PupilMatchingRefAnonymous"), ("_RECTYPE", "RECTYPE"), ("_GENDER", "GENDER"), ("KS5_URN$", "URN"),
             ("KS4_FSM", "KS4_FSM"), ("EVERFSM_6", "EVERFSM_6"), ("EVERFSM_3", "EVERFSM_3"), ("FSMeligible", "FSMeligible")]
    out = {r["PupilMatchingRefAnonymous"]: r for r in scan.scan_pupils(spark, str(path), pairs, "KS5").collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["GENDER"], out["a"]["EVERFSM_6"], out["b"]["EVERFSM_6"]) == ("F", 1, 0)


def test_sheets_with_drifting_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\n\nLA,URN,Name,Type of provider,Subject,Qualification,Entries\nx,1,\"A, B\",Academy,CS,GCSE,12\n")
    (tmp_path / "b.csv").write_text("LA,URN,Name,Provider Type,Subject,Qualification,Award,Number of entries\nx,2,C,College,IT,Cert,L2,x\n")
    (tmp_path / "c.csv").write_text("Notes\nnothing here\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    with pytest.raises(LookupError, match="c.csv"):  # a sheet without entries is an error unless it may be left out
        scan.union_drifted_sources(spark, paths)
    out = scan.union_drifted_sources(spark, paths, skip=True)
    assert sorted((r["URN"], r["Name"], r["Provider Type"], r["Entries"]) for r in out.collect()) == [
        ("1", "A, B", "Academy", 12.0), ("2", "C", "College", None)]
    with pytest.raises(LookupError):
        scan.union_drifted_sources(spark, [str(tmp_path / "c.csv")])


def test_clean_run_and_registration(spark, tmp_path):
    schema = "stage string, year int, exam_year int, pupil string, provider long, level int, subject string, qualification string, points double"
    results = spark.createDataFrame([
        ("KS4", 2017, 2017, "a", 1, 310, "2610", "q", 8.5), ("KS4", 2017, 2017, "a", 1, 310, "2610", "r", 4.0), ("KS4", 2017, 2016, "a", 1, 310, "9", "q", 7.0),
        ("KS4", 2017, 2017, "a", 1, 310, "2210", "q", 3.0), ("KS4", 2017, 2017, "a", 1, 391, "2210", "q9", 7.0), ("KS4", 2017, 2017, "z", 1, 310, "2610", "q", 4.0),
    ], schema)
    cleaned = pipeline.clean_results(results, [310, 391], rescale_from=2017)
    assert sorted((r["pupil"], r["level"], r["subject"], r["points"]) for r in cleaned.collect()) == [
        ("a", 310, "2210", 3.0), ("a", 310, "2610", 8.0), ("a", 391, "2210", 7.0), ("z", 310, "2610", 5.0)]
    pupils = pipeline.clean_pupils(spark.createDataFrame([("KS4", 2017, "a", "f")], "stage string, year int, pupil string, gender string"))
    folder = str(tmp_path / "cleaned")
    pipeline.run(pupils, cleaned, folder, supersede=(391, 310))
    found = scan.register_cohorts(spark, folder, "KS4", 2017)
    assert found["spread"].count() == 2 and spark.table("results_KS4_2017").count() == 4
    with pytest.raises(LookupError):
        scan.register_cohorts(spark, folder, "KS4", 2011)
    plan = found["results"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan


def test_subset_and_report(spark, tmp_path):
    df = spark.createDataFrame([("1", 5), ("2", 6), ("TOTAL", 11)], "URN string, n int")
    ids = spark.createDataFrame([(1,)], "URN long")
    subset = scan.scan_subset(df, ids, "URN")
    path = sink.write_report(subset, str(tmp_path / "report"))
    assert sorted((r["URN"], r["n"]) for r in scan.read_delimited(spark, path, ",").collect()) == [("1", "5"), ("TOTAL", "11")]


def test_level_change_keeps_other_years(spark):
    schema = "stage string, year int, pupil string, provider long, level int, subject string, points double"
    results = spark.createDataFrame([
        ("KS4", 2014, "a", 1, 310, "2210", 5.0), ("KS4", 2017, "a", 1, 391, "2210", 7.0), ("KS4", 2017, "a", 1, 310, "2210", 8.0),
        ("KS4", 2017, "a", 1, 310, "2610", 6.0), ("KS5", 2017, "a", 1, 310, "2210", 3.0),
    ], schema)
    pupils = results.select("stage", "year", "pupil").distinct()
    spread = pipeline.spread_of(pupils, results, (391, 310))
    assert sorted((r.stage, r.year, r.subject, r.points) for r in spread.collect()) == [
        ("KS4", 2014, "2210", 5.0), ("KS4", 2017, "2210", 7.0), ("KS4", 2017, "2610", 6.0), ("KS5", 2017, "2210", 3.0)]


def test_back_fill_keeps_types(spark):
    now = spark.createDataFrame([("a", None, " "), ("b", 3.0, "x")], "pupil string, mark double, eth string")
    past = spark.createDataFrame([("a", 2014, 9.0, "p"), ("a", 2015, 27.0, ""), ("b", 2015, 1.0, "q")], "pupil string, year int, mark double, eth string")
    for out in (link.backfill_across_years(now, past, {"mark": "mark", "eth": "eth"}), link.backfill_column(link.backfill_column(now, past, "mark", "mark"), past, "eth", "eth")):
        assert dict(out.dtypes)["mark"] == "double"
        assert sorted((r.pupil, r.mark, r.eth) for r in out.collect()) == [("a", 27.0, "p"), ("b", 3.0, "x")]


def test_back_fill_within_years(spark):
    """A newer value from outside the range is not used; the newest inside it is, blanks left out."""
    now = spark.createDataFrame([("a", 2017, None), ("a", 2015, None), ("b", 2017, "x"), ("c", None, None), (None, 2017, None)], "pupil string, year int, eth string")
    past = spark.createDataFrame([("a", 2017, "own"), ("a", 2016, "  "), ("a", 2014, "p"), ("a", 2013, "o"), ("a", 2010, "old"), ("b", 2016, "q"), ("c", 2016, "z"), (None, 2016, "n")], "pupil string, year int, eth string")

    def fill(**limits):
        out = link.backfill_across_years(now, past, {"eth": "eth"}, **limits)
        return sorted((r.pupil or "", r.year or 0, r.eth) for r in out.collect())

    assert fill(before=(1, 3)) == [("", 2017, None), ("a", 2015, "p"), ("a", 2017, "p"), ("b", 2017, "x"), ("c", 0, None)]
    assert fill(before=(2, 2)) == [("", 2017, None), ("a", 2015, "o"), ("a", 2017, None), ("b", 2017, "x"), ("c", 0, None)]
    assert fill(years=(2010, 2013)) == [("", 2017, None), ("a", 2015, "o"), ("a", 2017, "o"), ("b", 2017, "x"), ("c", 0, None)]
    assert fill(years=(2010, 2013), before=(3, 9)) == [("", 2017, None), ("a", 2015, "old"), ("a", 2017, "o"), ("b", 2017, "x"), ("c", 0, None)]


def test_run_from_files(spark, tmp_path):
    spec = tmp_path / "spec.json"
    people = {"_PupilMatchingRefAnonymous": "PupilMatchingRefAnonymous", "_GENDER": "GENDER", "_URN": "URN", "KS2MAT": "KS2Mat"}
    marks = {"EXAMYEAR": "EXAMYEAR", "SUBLEVNO": "SUBLEVNO", " QAN": " QAN", "MAPPING": "MAPPING", "GRADE": "GRADE", "POINTS": "POINTS"}
    late = {**people, **marks, "KS4_FSM": "KS4_FSM", "EVERFSM_6": "EVERFSM_6", "EVERFSM_3": "EVERFSM_3", "FSMeligible": "FSMeligible"}
    spec.write_text(json.dumps({"KS4": {"2014": {**people, **marks}, "2017": {**people, **marks}}, "KS5": {"2017": late}}))
    header = "X_PupilMatchingRefAnonymous\tX_URN\tEXAMYEAR\tSUBLEVNO\t{}QAN\tMAPPING\tGRADE\tPOINTS\n".replace("{}", "")
    files = {}
    for name, text in {
        "p14": "X_PupilMatchingRefAnonymous\tX_GENDER\tX_URN\tKS2MAT\na\tf\t1\t4.5\n", "r14": header + "a\t1\t2014\t310\tq\t2210\tB\t5\n",
        "p17": "X_URN\tX_PupilMatchingRefAnonymous\tX_GENDER\n1\tb\tm\n", "r17": header + "b\t1\t2017\t391\tq\t2210\tA\t7\nb\t1\t2017\t310\tr\t2210\tA\t4\n",
        "p5": "X_PupilMatchingRefAnonymous\tX_GENDER\tX_URN\tKS2MAT\tKS4_FSM\tEVERFSM_6\tEVERFSM_3\tFSMeligible\na\tf\t9\t\t1\t\t\t\n",
        "r5": header + "a\t9\t2017\t111\tq\t2610\tA\t50\n",
    }.items():
        files[name] = str(tmp_path / f"{name}.txt")
        (tmp_path / f"{name}.txt").write_text(text)
    sources = [{"stage": s, "year": y, "pupils": files[p], "results": files[r]} for s, y, p, r in (
        ("KS4", 2014, "p14", "r14"), ("KS4", 2017, "p17", "r17"), ("KS5", 2017, "p5", "r5"))]
    folder = str(tmp_path / "out")
    pipeline.run_from_files(
        spark, sources, fields.read_field_spec(spark, str(spec)), folder, {"KS4": [310, 391], "KS5": [111]}, {"KS4": (391, 310)}, 2017,
        backfill={"KS2Mat": "KS2Mat"}, prior_subjects={"2210": "maths"},
    )
    spread = spark.read.parquet(f"{folder}/KS4/spread")
    assert sorted((r.year, r.pupil, r.points) for r in spread.collect()) == [(2014, "a", 5.0), (2017, "b", 7.0)]
    late = spark.read.parquet(f"{folder}/KS5/pupils").first()
    assert (late.pupil, late.KS2Mat, late.maths, late.EVERFSM_6) == ("a", 4.5, 5.0, 1)
    assert spark.read.parquet(f"{folder}/KS5/spread").count() == 1
    # one year of one stage again, with another result: the rest stays, and the earlier stage is found in the folder
    (tmp_path / "r5.txt").write_text(header + "a\t9\t2017\t111\tq\t2610\tB\t40\na\t9\t2017\t111\tr\t2210\tB\t30\n")
    pipeline.run_from_files(spark, sources[2:], fields.read_field_spec(spark, str(spec)), folder, {"KS5": [111]}, backfill={"KS2Mat": "KS2Mat"}, prior_subjects={"2210": "maths"})
    assert sorted((r.subject, r.points) for r in spark.read.parquet(f"{folder}/KS5/spread").collect()) == [("2210", 30.0), ("2610", 40.0)]
    late = spark.read.parquet(f"{folder}/KS5/pupils").first()
    assert (late.KS2Mat, late.maths) == (4.5, 5.0) and spark.read.parquet(f"{folder}/KS4/spread").count() == 2


def test_a_year_written_again_leaves_the_others(spark, tmp_path):
    def rows(*years):
        return spark.createDataFrame([("KS4", y, f"p{y}-{n}", n) for y, n in years], "stage string, year int, pupil string, n int")

    sink.write_clean(rows((2014, 1), (2015, 1)), str(tmp_path), "t")
    path = sink.write_clean(rows((2015, 2), (2015, 3)), str(tmp_path), "t")
    assert sorted((r.year, r.n) for r in spark.read.parquet(path).collect()) == [(2014, 1), (2015, 2), (2015, 3)]


def test_body_line_like_the_header_stays(spark, tmp_path):
    head = "LA,URN,Name,Type of provider,Subject,Qualification,Entries"
    row = "x,1,A,Academy,CS,GCSE,12"
    (tmp_path / "a.csv").write_text(f"{row}\n{head}\n{row}\n{row}\n")
    assert scan.read_entry_sheet(spark, str(tmp_path / "a.csv")).count() == 2


def test_valid_providers_in_access(spark):
    facts = spark.createDataFrame([(1, 1, "s"), (2, 1, "t"), (3, 900000, "s")], "pupil long, provider long, subject string")
    got = {r.subject: (r.providers, r.takers) for r in uptake.subject_access_all(facts).collect()}
    assert got == {"s": (1, 1), "t": (1, 1)}
