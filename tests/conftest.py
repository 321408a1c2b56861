import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers (pandas UDFs, mapInPandas) import test-defined callables too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docprep.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)
    yield s


def one(spark, fn, *values, schema="v string"):
    """Apply a Column function to each value; return the outputs in order."""
    from pyspark.sql import functions as F

    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, " + schema)
    out = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in out]
