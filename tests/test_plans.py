"""Physical-plan properties the operators rely on at scale."""
from conftest import SMALL


def test_cohorts_prune_columns_and_aggregate_partially(spark, resp_small):
    from trustlens.operators.risk import vulnerable_cohorts
    df = vulnerable_cohorts(resp_small)
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(mode)
    assert "Expand" in formatted and "partial_sum" in formatted
    read = [l for l in formatted.splitlines() if l.startswith("ReadSchema")]
    assert read and "respondent_id" not in read[0] and "q_saves_time" not in read[0]


def test_respondent_derivation_pushes_filters_and_prunes(spark):
    from trustlens.sources.respondents import respondents
    df = respondents(spark, SMALL)
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(mode)
    schemas = [l for l in formatted.splitlines() if l.startswith("ReadSchema")]
    assert any("l_orderkey:bigint,l_returnflag:string>" in s for s in schemas)
    assert all("l_comment" not in s and "l_extendedprice" not in s for s in schemas)
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in formatted


def test_validators_do_not_expand_rows(spark, resp_small):
    from trustlens.sources.survey import check_likert_range
    df = check_likert_range(resp_small)
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(mode)
    assert "Expand" not in formatted


def _scans(df):
    """Parquet scans that ran, exchange and subquery reuse included."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("FileScan parquet")


def test_report_tables_read_the_respondents_few_times(spark, resp_small):
    from trustlens.operators import descriptive as D
    from trustlens.operators import report as RP
    from trustlens.operators import stats as ST
    assert _scans(D.spt_index_stats(resp_small)) == 1
    assert _scans(RP.key_insights(resp_small)) <= 4
    assert _scans(ST.kruskal(resp_small)) <= 2
    assert _scans(ST.mann_whitney(resp_small)) <= 2


def test_no_join_shuffles_rows_by_their_label(spark, resp_small):
    from trustlens import schema as S
    from trustlens.ml.pipeline import model_frame
    frame, _ = model_frame(resp_small, S.FRAUD_TARGET)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(label" not in plan.split("Subquery")[0]


def test_report_cube_is_one_scan_counted_before_the_shuffle(spark, resp_small):
    from trustlens.operators import stats as ST
    cube = ST.report_cube(resp_small)
    assert _scans(cube) == 1 and cube.count() < 400
    assert "partial_count" in cube._jdf.queryExecution().executedPlan().toString()
    source = resp_small.inputFiles()[0].rsplit("/", 1)[0]
    report = ST.stat_report(resp_small)
    assert not any(f.startswith(source) for f in report.inputFiles())  # only the cube is read


def test_scores_and_clusters_are_attached_without_a_join(spark):
    from trustlens.ml import anomaly as AN
    from trustlens.ml.cluster import CentreModel
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.col("id").alias("respondent_id"), array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"))
    rows = AN.isolation_forest(df, ["a", "b"], AN.ForestSettings(trees=5))["rows"]
    done = CentreModel(np.array([[0.2, 0.2], [0.8, 0.8]]), 0.0).transform(rows)
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString().split("Subquery")[0] and done.count() == 300
