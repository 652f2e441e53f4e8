"""The driver contract works from a plain session in another working directory
(workers import the package shipped by ``session.prepare``)."""
import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
    E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    assert len(E.entry(spark).collect()) == 25
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    n = q["isolation_forest"](spark, "/root/testdata/sf0.001").count()
    print("OK", n)
""")


def test_entry_and_python_workers_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "OK 150" in out.stdout, out.stderr[-3000:]
