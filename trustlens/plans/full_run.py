"""Run every analysis over one survey source and write all result tables.

The counterpart of the reference's full run: load (and validate) the survey
table, compute the descriptive, statistical, risk and ML results, and write
each result table as Parquet (and CSV) under ``out_dir``.  Every table is a
DataFrame computed by Spark; nothing row-level passes through the driver.

usage: python -m trustlens.plans.full_run --tpch /root/testdata/sf0.01 --out /tmp/out
       python -m trustlens.plans.full_run --survey data.csv --out /tmp/out [--skip-ml]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from trustlens.ml import anomaly as AN
from trustlens.ml import attribution as AT
from trustlens.ml import cluster as CL
from trustlens.ml import models as MD
from trustlens.ml import store
from trustlens.operators import descriptive as D
from trustlens.operators import report as RP
from trustlens.operators import risk as R
from trustlens.operators import stats as ST
from trustlens import schema as S
from trustlens.plans.catalog_ml import fraud_attributions
from trustlens.sources import survey as SV


#: Tables of one row per respondent: written as many parts.  The others have few rows.
ROW_LEVEL = {"anomaly_scores"}


def result_tables(df: DataFrame, skip_ml: bool = False, sizes: tuple | None = None) -> dict[str, DataFrame]:
    """Name -> result DataFrame, in the reference's output set."""
    spark = df.sparkSession
    t = {
        "service_adoption": D.service_adoption(df),
        "likert_summary": D.likert_summary(df),
        "spt_summary": D.spt_summary(df),
        "fraud_profile": D.fraud_profile(df),
        "fraud_type_breakdown": D.fraud_type_breakdown(df),
        "demographic_summary": D.demographic_summary(df),
        "spt_index_stats": D.spt_index_stats(df),
        "scale_reliability": ST.scale_reliability(df),
        "spt_correlation": ST.correlation_matrix(df, S.SPT_COLUMNS, "spearman"),
        "statistical_tests": ST.stat_report(df),
        "channel_risk_matrix": R.channel_risk_matrix(df),
        "attack_surface": R.attack_surface(df),
        "security_gap_matrix": R.security_gaps(df),
        "threat_actors": R.threat_actor_table(spark),
        "vulnerable_cohorts": R.vulnerable_cohorts(df),
        "key_insights": RP.key_insights(df),
        "policy_recommendations": RP.recommendations(df),
    }
    if skip_ml:
        return t
    ccfg, mcfg, fcfg = sizes or (CL.ClusterSettings(), MD.ModelSettings(), AN.ForestSettings())
    clus = CL.run_clustering(df, ccfg)
    t["cluster_profiles"] = clus["profiles"]
    t["silhouette_analysis"] = clus["silhouette"]
    fraud = MD.train_classifier(df, S.FRAUD_TARGET, mcfg)
    trust = MD.train_classifier(df, S.TRUST_TARGET, mcfg)
    t["fraud_classifier_metrics"] = fraud["metrics"].drop("ord")
    t["trust_classifier_metrics"] = trust["metrics"].drop("ord")
    t["fraud_feature_importance"] = MD.importance_frame(spark, fraud["feature_importance"])
    an = AN.isolation_forest(clus["scaled"], S.CLUSTER_FEATURES, fcfg)
    t["anomaly_summary"] = AN.anomaly_summary(an["scores"])
    t["anomaly_scores"] = an["scores"]
    t["fraud_attributions"] = AT.attribution_table(fraud_attributions(fraud))
    store.publish_clusters(spark, "kmeans", clus["model"], {"silhouette": clus["silhouette"]}, "full run")
    saved = [store.publish_classifier(spark, name, res, "full run") for name, res in (("fraud", fraud), ("trust", trust))]
    t["best_models"] = spark.createDataFrame([(m["name"], m["model"], m["folder"]) for m in saved], "task string, model string, path string")
    return t


def run_all(spark: SparkSession, df: DataFrame, out_dir: str, skip_ml: bool = False,
            sizes: tuple | None = None, csv: bool = True) -> dict[str, float]:
    """Write every result table; returns seconds per table."""
    times = {}
    for name, table in result_tables(df, skip_ml, sizes).items():
        t0 = time.time()
        SV.write_table(table, f"{out_dir.rstrip('/')}/parquet/{name}", "parquet")
        if csv:
            SV.write_table(table if name in ROW_LEVEL else table.coalesce(1), f"{out_dir.rstrip('/')}/csv/{name}", "csv")
        times[name] = round(time.time() - t0, 3)
    return times


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--survey", help="survey CSV (main profile)")
    src.add_argument("--tpch", help="folder of TPC-H parquet tables (derived respondents)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--skip-ml", action="store_true")
    a = ap.parse_args()
    from trustlens.session import get_session, release
    spark = get_session()
    if a.survey:
        df = SV.read_survey(spark, a.survey, "csv")
    else:
        from trustlens.sources.respondents import respondents_table
        df = respondents_table(spark, a.tpch)
    for name, sec in run_all(spark, df, a.out, a.skip_ml).items():
        print(f"{name:28s} {sec:8.2f}s")
    release(spark)


if __name__ == "__main__":
    main()
