import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from cohortloom.functions import dist
from cohortloom.operators.linmod import fit_ols
from cohortloom.shipping import ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ship(spark)
df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(9)], "x double, y double")
slope = fit_ols(df, [], "y", ["x"]).where("term = 'x'").first().estimate
p = spark.range(1).select(dist.t_p_value(F.lit(2.0), F.lit(10.0))).first()[0]
print("RESULT", round(slope, 9), round(p, 6))
"""


def test_python_steps_run_where_the_package_is_not_installed(tmp_path):
    """The workers start in an empty folder without PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=str(Path(__file__).resolve().parents[1])))
    work = tmp_path / "work"
    work.mkdir()
    out = subprocess.run([sys.executable, str(script)], cwd=work, env=env, capture_output=True, text=True, timeout=300)
    assert "RESULT 2.0 0.073388" in out.stdout, out.stderr[-2000:]
