"""Results do not depend on the session time zone (the driver tables hold zone-less timestamps)."""

import __spark_entry__ as E

from .conftest import SF_SMALL

TIME_QUERIES = ["bronze_transactions", "bronze_csv_roundtrip", "period_metrics", "margin_bridge"]


def collect_sorted(spark, name):
    return sorted(tuple(r) for r in E.queries()[name](spark, SF_SMALL).collect())


def test_results_independent_of_session_time_zone(spark):
    key = "spark.sql.session.timeZone"
    saved = spark.conf.get(key)
    try:
        spark.conf.set(key, "UTC")
        utc = {n: collect_sorted(spark, n) for n in TIME_QUERIES}
        spark.conf.set(key, "Pacific/Kiritimati")  # UTC+14
        for n in TIME_QUERIES:
            assert collect_sorted(spark, n) == utc[n], n
    finally:
        spark.conf.set(key, saved)
