"""Loader checks on hand-made frames (FIXTURES 6)."""
import pytest

from conftest import survey_df, survey_rows
from trustlens import schema as S
from trustlens.sources import survey as SV


def test_valid_frame_passes(spark):
    SV.validate(survey_df(spark, survey_rows()))


def test_likert_out_of_range(spark):
    rows = survey_rows()
    rows[3]["q_feel_secure"] = 6
    df = survey_df(spark, rows)
    bad = SV.check_likert_range(df).collect()
    assert [(r["column"], r["n_bad"], r["first_bad_id"]) for r in bad] == [("q_feel_secure", 1, 4)]
    with pytest.raises(ValueError, match="q_feel_secure"):
        SV.validate(df)


def test_likert_null(spark):
    rows = survey_rows()
    rows[5]["q_trust_platform"] = None
    bad = SV.check_likert_range(survey_df(spark, rows)).collect()
    assert [(r["column"], r["first_bad_id"]) for r in bad] == [("q_trust_platform", 6)]


def test_binary_value_two(spark):
    rows = survey_rows()
    rows[0]["has_mfa_enabled"] = 2
    df = survey_df(spark, rows)
    bad = SV.check_binary(df).collect()
    assert [r["column"] for r in bad] == ["has_mfa_enabled"]
    with pytest.raises(ValueError, match="binary"):
        SV.validate(df)


def test_missing_column(spark):
    df = survey_df(spark, survey_rows()).drop("q_saves_time", "gender")
    assert SV.check_required(df) == ["gender", "q_saves_time"]
    with pytest.raises(ValueError, match="missing required columns"):
        SV.validate(df)


def test_csv_round_trip_with_text_booleans(spark, tmp_path):
    from pyspark.sql import functions as F
    df = survey_df(spark, survey_rows())
    text = df.withColumns({c: F.when(F.col(c) == 1, "True").otherwise("False") for c in S.BINARY_FEATURES})
    path = str(tmp_path / "csv")
    SV.write_csv(text, path)
    back = SV.read_survey(spark, path, "csv").orderBy("respondent_id")
    assert back.collect() == df.orderBy("respondent_id").collect()


def test_legacy_profile(spark, tmp_path):
    df = survey_df(spark, survey_rows())
    path = str(tmp_path / "legacy")
    SV.write_csv(SV.legacy_projection(df), path)
    back = SV.read_survey(spark, path, "csv", profile="legacy")
    assert back.columns == S.LEGACY_COLUMNS
    assert back.where("uses_atm NOT IN (0, 1)").count() == 0


def test_text_in_likert_column_is_flagged(spark):
    from pyspark.sql import functions as F
    df = survey_df(spark, survey_rows(5)).withColumn(
        "q_saves_time", F.when(F.col("respondent_id") == 2, "abc").otherwise(F.col("q_saves_time").cast("string")))
    bad = SV.check_likert_range(df).collect()
    assert [(r["column"], r["first_bad_id"]) for r in bad] == [("q_saves_time", 2)]


def test_csv_columns_are_found_by_their_names(spark, tmp_path):
    """Swapped and further columns; missing ones are an error."""
    import pytest

    from tests.conftest import survey_df, survey_rows
    from trustlens import schema as S
    from trustlens.sources import survey as SV
    rows = survey_rows(12, q_feel_secure=1, q_trust_platform=4)
    df = survey_df(spark, rows)
    swapped = [c for c in reversed(df.columns)]
    path = SV.write_csv(df.selectExpr("'x' AS remark", *swapped), str(tmp_path / "a"))
    back = SV.read_survey(spark, path)
    assert back.columns == ["remark", *swapped]
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert {(r[0], r[1]) for r in back.select("q_feel_secure", "q_trust_platform").collect()} == {(1, 4)}
    last = SV.write_csv(df.drop(S.REQUIRED_COLUMNS[-1]), str(tmp_path / "b"))
    with pytest.raises(ValueError, match=S.REQUIRED_COLUMNS[-1]):
        SV.read_survey(spark, last)


def test_path_precedence(spark, tmp_path):
    import pytest

    from trustlens.sources import survey as SV
    a, b, c = (str(tmp_path / n) for n in "abc")
    for p in (b, c):
        with open(p, "w") as f:
            f.write("x")
    assert SV.find_survey(spark, b, c, a) == b
    assert SV.find_survey(spark, None, a, c) == c and SV.find_survey(spark, None, b, c) == b
    with pytest.raises(FileNotFoundError):
        SV.find_survey(spark, a, b, c)
    with pytest.raises(FileNotFoundError):
        SV.find_survey(spark)


DAMAGED = SV.DAMAGED


def test_damaged_lines_raise_or_go_to_quarantine(spark, tmp_path):
    good = survey_rows(6)
    text = [",".join(str(r[c]) for c in S.REQUIRED_COLUMNS) for r in good]
    bad = [text[0] + ",x,y", text[1].rsplit(",", 1)[0], text[2].rsplit(",", 1)[0] + ",often"]
    folder = tmp_path / "csv"
    folder.mkdir()
    header = ",".join(S.REQUIRED_COLUMNS)
    (folder / "a.csv").write_text("\n".join([header, bad[0], text[3], bad[1]]) + "\n")
    (folder / "b.csv").write_text("\n".join([header, text[4], bad[2], text[5]]) + "\n")
    with pytest.raises(ValueError, match="3 damaged lines"):
        SV.read_survey(spark, str(folder))
    rows = SV.read_survey(spark, str(folder), quarantine=str(tmp_path / "aside"))
    assert sorted(r["respondent_id"] for r in rows.collect()) == [4, 5, 6] and DAMAGED not in rows.columns
    aside = {(r["file"].rsplit("/", 1)[1], r["line"]) for r in spark.read.parquet(str(tmp_path / "aside")).collect()}
    assert aside == {("a.csv", bad[0]), ("a.csv", bad[1]), ("b.csv", bad[2])}
