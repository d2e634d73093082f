import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pocketlens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

STRING_COLS = {"country", "material", "sales_designation", "sold_to", "corporate_group", "pso"}


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="pocketlens-tests")
    yield s


def _field(name):
    if name in STRING_COLS:
        return T.StructField(name, T.StringType(), True)
    if name == "year":
        return T.StructField(name, T.IntegerType(), True)
    if name == "_loaded_at":
        return T.StructField(name, T.TimestampNTZType(), True)
    return T.StructField(name, T.DoubleType(), True)


def make_df(spark, rows):
    """DataFrame from dicts with the analytic types (numbers as doubles)."""
    names = list(rows[0].keys())
    schema = T.StructType([_field(n) for n in names])
    data = []
    for r in rows:
        vals = []
        for n in names:
            v = r.get(n)
            if v is not None and n not in STRING_COLS and n not in ("year", "_loaded_at"):
                v = float(v)
            vals.append(v)
        data.append(tuple(vals))
    return spark.createDataFrame(data, schema)


@pytest.fixture
def df_of(spark):
    return lambda rows: make_df(spark, rows)


@pytest.fixture(scope="module", autouse=True)
def released(spark):
    """What a module's own fixtures cached is gone before the next module counts cached data."""
    yield
    spark.catalog.clearCache()
