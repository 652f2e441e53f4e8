"""The full run writes every non-ML result table."""
import os


def test_run_all_without_ml(spark, resp_small, tmp_path):
    from trustlens.plans.full_run import run_all
    out = str(tmp_path / "out")
    times = run_all(spark, resp_small, out, skip_ml=True, csv=False)
    assert "vulnerable_cohorts" in times and "statistical_tests" in times
    for name in times:
        assert os.path.isdir(os.path.join(out, "parquet", name))
    back = spark.read.parquet(os.path.join(out, "parquet", "scale_reliability"))
    assert back.count() == 6


def test_release_deletes_intermediate_tables(spark, monkeypatch, tmp_path):
    from trustlens import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: str(tmp_path))
    kept = session.materialize(spark.range(5), "some")
    assert kept.count() == 5 and os.listdir(tmp_path / "tables")
    session.release(spark)
    assert not os.path.exists(tmp_path / "tables")


def test_row_level_csv_has_many_parts(spark, monkeypatch, tmp_path):
    from trustlens.plans import full_run
    tables = {"anomaly_scores": spark.range(0, 100, 1, 4), "few": spark.range(0, 4, 1, 4)}
    monkeypatch.setattr(full_run, "result_tables", lambda *a: tables)
    full_run.run_all(spark, spark.range(1), str(tmp_path))
    for name, parts in (("anomaly_scores", 4), ("few", 1)):
        folder = tmp_path / "csv" / name
        assert len(list(folder.glob("part-*.csv"))) == parts
        assert spark.read.csv(str(folder), header=True).count() == tables[name].count()
