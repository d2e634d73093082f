"""CSV ingest, type enforcement, bronze append, layer writes, source fallback."""

import datetime as dt
import os

import pytest

from pocketlens.schema import BRONZE_COLUMNS, TRANSACTION_SCHEMA
from pocketlens.session import scratch_path
from pocketlens.sources.adapter import transactions_from_orders
from pocketlens.sources.files import (
    conform,
    load_transactions,
    read_transactions_csv,
    write_bronze,
    write_layer,
    write_transactions_csv,
)

from .conftest import SF_SMALL

HEADER = ",".join(BRONZE_COLUMNS)


def local(path):
    """OS path of a local ``file:`` URI (the scratch folder is named as a URI)."""
    return path[len("file:"):] if path.startswith("file:") else path


def write_text(path, lines):
    path = local(path)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_csv_null_tokens_and_types(spark):
    path = scratch_path(spark, "csv-in")
    write_text(path, [
        HEADER,
        'USA,2025,HYD-001,OEM,C-1,"Komatsu, Inc",100,100.5,10,90.5,5,85.5,Americas,50,,2025-01-02 03:04:05',
        "USA,2025,HYD-001,OEM,C-2,NULL,100,100,10,90,5,85,Americas,null,30,2025-01-02 00:00:00",
    ])
    df = read_transactions_csv(spark, path)
    assert df.schema == TRANSACTION_SCHEMA or [f.dataType for f in df.schema] == [f.dataType for f in TRANSACTION_SCHEMA]
    rows = {r.sold_to: r for r in df.collect()}
    assert rows["C-1"].corporate_group == "Komatsu, Inc" and rows["C-1"].material_cost is None
    assert rows["C-1"]._loaded_at == dt.datetime(2025, 1, 2, 3, 4, 5)
    assert rows["C-2"].corporate_group is None and rows["C-2"].standard_cost is None


REQUIRED = {
    "country": "NO", "year": "2024", "material": "M1", "sales_designation": "D", "sold_to": "K1", "sales_qty": "7.5",
    "blue_jobber_price": "9", "invoice_price": "8", "pocket_price": "7", "pso": "NORTH",
}


def test_conform_defaults_and_lowercase(spark):
    df = spark.createDataFrame([tuple(REQUIRED.values())], [n.upper() for n in REQUIRED])
    r = conform(df).first()
    assert r.country == "NO" and r.year == 2024 and r.sales_qty == 7.5
    assert r.deductions == 0.0 and r.bonuses == 0.0 and r._loaded_at is not None and r.standard_cost is None


def test_conform_refuses_what_the_table_would(spark):
    with pytest.raises(ValueError, match="pso"):
        conform(spark.createDataFrame([tuple(REQUIRED.values())[:-1]], list(REQUIRED)[:-1]))
    for name in ("country", "sales_qty", "deductions"):
        row = REQUIRED | {"deductions": "1", name: "NULL"}
        with pytest.raises(Exception, match=f"NOT NULL column {name}"):
            conform(spark.createDataFrame([tuple(row.values())], list(row))).collect()


def test_csv_columns_are_found_by_name(spark):
    names = [*reversed(REQUIRED), "Bonuses"]
    path = scratch_path(spark, "csv-order")
    write_text(path, [",".join(names), ",".join([*reversed(REQUIRED.values()), "0.25"])])
    r = read_transactions_csv(spark, path).first()
    assert (r.country, r.pso, r.pocket_price, r.bonuses, r.deductions) == ("NO", "NORTH", 7.0, 0.25, 0.0)
    for header in (",".join([*REQUIRED, "extra"]), ",".join([*REQUIRED, "PSO"]), ",".join(list(REQUIRED)[1:])):
        path = scratch_path(spark, "csv-bad")
        write_text(path, [header, ",".join(["1"] * len(header.split(",")))])
        with pytest.raises(ValueError):
            read_transactions_csv(spark, path)


def test_csv_keeps_fractions_of_a_second(spark):
    row = tuple(REQUIRED.values()) + ("2024-05-06 07:08:09.789012",)
    df = conform(spark.createDataFrame([row], [*REQUIRED, "_loaded_at"]))
    path = scratch_path(spark, "csv-fraction")
    write_transactions_csv(df, path)
    assert read_transactions_csv(spark, path).first()._loaded_at == dt.datetime(2024, 5, 6, 7, 8, 9, 789012)


def test_csv_roundtrip_exact(spark):
    bronze = transactions_from_orders(spark, SF_SMALL)
    path = scratch_path(spark, "csv-rt")
    write_transactions_csv(bronze, path)
    back = read_transactions_csv(spark, path)
    assert back.exceptAll(bronze).count() == 0 and bronze.exceptAll(back).count() == 0


def test_bronze_append_and_truncate(spark):
    bronze = transactions_from_orders(spark, SF_SMALL).limit(100)
    path = scratch_path(spark, "bronze")
    assert write_bronze(bronze, path) == 100
    assert write_bronze(bronze, path) == 200
    assert write_bronze(bronze, path, truncate=True) == 100


def test_write_layer_partitioned(spark):
    bronze = transactions_from_orders(spark, SF_SMALL)
    path = scratch_path(spark, "layer")
    write_layer(bronze.drop("_loaded_at"), path, layer="silver")
    parts = sorted(p for p in os.listdir(local(path)) if p.startswith("year="))
    assert parts and all(p.startswith("year=") for p in parts)
    assert spark.read.parquet(path).count() == bronze.count()


def test_load_transactions_fallback(spark):
    bronze = transactions_from_orders(spark, SF_SMALL).limit(20)
    csv = scratch_path(spark, "fallback")
    write_transactions_csv(bronze, csv)
    df, label = load_transactions(spark, table_path=scratch_path(spark, "missing"), csv_path=csv)
    assert label == "csv" and df.count() == 20
    table = scratch_path(spark, "table")
    bronze.write.parquet(table)
    df, label = load_transactions(spark, table_path=table, csv_path=csv)
    assert label == "table" and df.count() == 20
    with pytest.raises(ValueError):
        load_transactions(spark, table_path=scratch_path(spark, "missing"))


def test_write_layer_splits_a_hot_key(spark):
    # one (year, country) holds every row: it is split by size
    df = spark.range(0, 4000, 1, 8).selectExpr("2025 AS year", "'HOT' AS country", "id", "CAST(id AS DOUBLE) AS sales_qty")
    path = scratch_path(spark, "hot")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "4KB")
    try:
        write_layer(df, path, partition_by="year", cluster_by=["year", "country"])
    finally:
        spark.conf.unset(size)
    files = [f for f in os.listdir(local(path) + "/year=2025") if f.endswith(".parquet")]
    assert len(files) >= 4
    assert spark.read.parquet(path).count() == 4000


def test_build_layers(spark):
    from pocketlens.plans.layers import build_layers

    bronze = transactions_from_orders(spark, SF_SMALL)
    built = build_layers(spark, bronze, scratch_path(spark, "layers"))
    assert set(built.paths) == {"silver", "waterfall_fact", "customer_profitability", "waterfall_alerts"}
    assert built.tables["silver"].count() == built.tables["waterfall_fact"].count() == 5343
    tiers = built.tables["customer_profitability"].groupBy("margin_tier").count().collect()
    assert sum(r["count"] for r in tiers) == built.tables["customer_profitability"].count()
    assert built.tables["waterfall_alerts"].filter("alert_type IS NULL").count() == 0
