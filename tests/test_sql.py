"""Read-only SQL guard over the registered views."""

import pytest
from pyspark.errors import ParseException

from pocketlens.plans.sql import VIEW_NAMES, ReadOnlyViolation, reader_session, register_views, run_readonly_sql
from pocketlens.session import local_session
from pocketlens.sources.adapter import transactions_from_orders

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def outer():
    return local_session(cores=4, shuffle_partitions=4, app="pocketlens-tests")


@pytest.fixture(scope="module")
def reader(outer):
    """The readers' own session; the caller's session and the catalog hold names that queries must not reach."""
    outer.sql("SELECT 1 AS x").createOrReplaceTempView("callers")
    reader = reader_session(outer)
    reader.sql("SELECT 1 AS x").createOrReplaceTempView("secret")
    reader.sql("SELECT 1 AS x").createOrReplaceGlobalTempView("shared_secret")
    register_views(reader, transactions_from_orders(reader, SF_SMALL))
    yield reader
    outer.catalog.dropTempView("callers")
    reader.catalog.dropGlobalTempView("shared_secret")


@pytest.fixture(scope="module")
def views(reader):
    return reader


@pytest.fixture(scope="module")
def spark(reader):  # the tests below ask the readers' session
    return reader


def test_select_and_with(spark, views):
    assert run_readonly_sql(spark, "SELECT country, count(*) AS n FROM transactions GROUP BY country").count() == 25
    q = "WITH t AS (SELECT pso FROM waterfall_fact) SELECT pso, count(*) AS n FROM t GROUP BY pso -- trailing"
    assert run_readonly_sql(spark, q).count() == 5


def test_cap_and_inner_order(spark, views):
    rows = run_readonly_sql(spark, "SELECT sold_to, wavg_margin_pct FROM customer_profitability "
                                   "ORDER BY wavg_margin_pct, sold_to", limit=7).collect()
    assert len(rows) == 7
    assert [r.wavg_margin_pct for r in rows] == sorted(r.wavg_margin_pct for r in rows)
    assert run_readonly_sql(spark, "SELECT * FROM transactions").count() > 30  # no cap unless asked for


@pytest.mark.parametrize("q", ["DROP TABLE transactions", "INSERT INTO t VALUES (1)", "  delete from x", ""])
def test_first_word_rejected(spark, views, q):
    with pytest.raises(ReadOnlyViolation):
        run_readonly_sql(spark, q)


@pytest.mark.parametrize(
    "q",
    [
        "WITH t AS (SELECT 1 AS a) INSERT INTO transactions SELECT * FROM t",
        "SELECT 1; DROP TABLE transactions",
        "SELECT 1) ; DROP TABLE transactions; (SELECT 1",
        "WITH x AS (SELECT 1) CREATE TABLE y AS SELECT 1",
    ],
)
def test_non_queries_do_not_parse(spark, views, q):
    with pytest.raises(ParseException):
        run_readonly_sql(spark, q)


def test_explain(spark, views):
    plan = run_readonly_sql(spark, "EXPLAIN SELECT count(*) FROM waterfall_alerts").first()[0]
    assert "Physical Plan" in plan or "HashAggregate" in plan


def test_views_registered(spark, views):
    names = {t.name for t in spark.catalog.listTables()}
    assert {"transactions", "waterfall_fact", "customer_profitability", "waterfall_alerts"} <= names


def test_explain_modes(spark, views):
    plan = run_readonly_sql(spark, "EXPLAIN FORMATTED SELECT count(*) FROM waterfall_alerts").first()[0]
    assert "Physical Plan" in plan and "(1)" in plan
    with pytest.raises(ParseException):
        run_readonly_sql(spark, "EXPLAIN FORMATTED DROP VIEW waterfall_alerts")


@pytest.mark.parametrize(
    "q",
    [
        "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')",
        "SELECT reflect('java.lang.System', 'getenv')",
        "EXPLAIN SELECT try_reflect('java.lang.System', 'getenv')",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM other_table",
        "SELECT t.* FROM transactions t JOIN csv.`/etc/passwd` p ON true",
        "SELECT * FROM range(10)",
        # names that look like common table expressions in a comment, a literal or another scope
        "SELECT * FROM secret /* secret AS ( */",
        "SELECT 'secret AS (' FROM secret",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) a, secret b",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "WITH t AS (SELECT * FROM secret) SELECT 1",
        # calls behind many columns, quoted, qualified or inside a lambda
        "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(40)) + ", `java_method`('java.lang.System', 'setProperty', 'a', 'b')",
        "SELECT builtin.reflect('java.lang.System', 'getenv')",
        "SELECT transform(array('a'), x -> `reflect`('java.lang.System', 'getProperty', x))",
        # relations inside expressions, and other kinds of sources
        "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)",
        "SELECT 1 FROM transactions ORDER BY (SELECT max(x) FROM secret)",
        "SELECT * FROM transactions t, LATERAL (SELECT * FROM secret) s",
        "SELECT * FROM global_temp.shared_secret",
        "SELECT * FROM callers",
        "SELECT * FROM default.transactions",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')",
        "SELECT * FROM transactions TIMESTAMP AS OF '2020-01-01'",
        "EXPLAIN SELECT * FROM secret",
    ],
)
def test_only_the_views_and_no_jvm_calls(spark, views, q):
    with pytest.raises(ReadOnlyViolation):
        run_readonly_sql(spark, q)
    assert spark._jvm.java.lang.System.getProperty("a") is None


@pytest.mark.parametrize(
    "q,rows",
    [
        ("SELECT * FROM VALUES (1, 2), (3, 4) AS v(a, b)", 2),
        ("WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a WHERE x IN (SELECT x FROM a)) SELECT * FROM b", 1),
        ("WITH transactions AS (SELECT 1 AS x) SELECT * FROM transactions", 1),
        ("WITH RECURSIVE r AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM r WHERE i < 4) SELECT * FROM r", 4),
        ("SELECT (SELECT max(year) FROM transactions) AS y, EXISTS (SELECT 1 FROM waterfall_alerts) AS e", 1),
        ("SELECT pso, x FROM waterfall_alerts LATERAL VIEW explode(array(1, 2)) e AS x LIMIT 3", 3),
        ("SELECT 'secret' AS `from`, transform(array(1), x -> x + 1) AS t, row_number() OVER (ORDER BY year) AS r FROM transactions LIMIT 1", 1),
    ],
)
def test_queries_over_the_views_are_free(spark, views, q, rows):
    assert run_readonly_sql(spark, q).count() == rows


def test_registered_functions_and_replaced_views_are_refused(spark, views):
    spark.udf.register("shout", lambda s: s.upper())
    with pytest.raises(ReadOnlyViolation):
        run_readonly_sql(spark, "SELECT shout(pso) FROM waterfall_alerts")


def test_sessions_stay_apart(outer, spark, views):
    assert not set(VIEW_NAMES) & {t.name for t in outer.catalog.listTables()}
    assert spark.conf.get("spark.sql.shuffle.partitions") == outer.conf.get("spark.sql.shuffle.partitions")
