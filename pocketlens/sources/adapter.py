"""Test adapter: derive bronze transactions from the TPC-H-shaped driver tables.

The driver tables carry no price waterfall, so each line item becomes one
transaction with a deterministic, row-local price chain:

==================  =========================================================
bronze column       derived from
==================  =========================================================
country             ``n_name`` of the customer's nation
pso                 ``r_name`` of the nation's region
corporate_group     ``c_mktsegment``
sold_to             ``c_name``
year                ``year(o_orderdate)``
material            ``p_brand``
sales_designation   ``o_orderpriority``
_loaded_at          ``l_shipdate``
sales_qty           ``l_quantity``
blue_jobber_price   r4(extendedprice / quantity)
deductions          r4(blue * discount * (4 if nation%5=0 else 2))
invoice_price       r4(blue - deductions + (0.05 if size=13 and line=7))
bonuses             r4(invoice * tax * (2.5 if nation%5=1 else 1))
pocket_price        r4(invoice - bonuses)
standard_cost       r4(pocket * (archetype[custkey%5] + 0.001*size + nation uplift))
material_cost       r4(standard_cost * (1.05 if size=50 else 0.6))
==================  =========================================================

(r4 = :func:`round_half_up` at 4 dp.)  The 0.05 invoice offset and the 1.05
material factor plant INVOICE_MISMATCH and MATERIAL_COST_EXCEEDS_STANDARD rows.

Plan: five equi-joins that shuffle the line items, the widest input, as few times and as
narrow as the tables allow.  While a dimension can be broadcast, the line items join orders, then customers, then
the nation/region geography, then parts: each right side is a plain scan (or the tiny
geography), so its size estimate comes from file statistics and Catalyst broadcasts
it only while it is under ``spark.sql.autoBroadcastJoinThreshold``, else sort-merges;
AQE can still switch at run time.  Beyond the threshold each such join would shuffle all line items, with
the attributes joined so far.  So larger parts are joined first, to the bare line items, and larger
customers are joined to the geography and the orders, which then meet the line items in one join.
(That side is estimated as a product, which Catalyst never broadcasts; so small tables keep
the chain.)  The geography is estimated as the product of its two inputs, an upper bound on a join's size, and is
under the threshold at any scale.  Filters on country or PSO reach the nation and region
scans.  Only the needed columns are read from each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round_half_up
from ..plans.broadcast import broadcast_bytes, estimated_bytes
from ..schema import BRONZE_COLUMNS

# Line items are joined in up to MAX_PARTS parts, as many as there are PART_BYTES.
MAX_PARTS = 4
PART_BYTES = 64 << 20

# Fixed adapter parameters (stated once, in natural order).
COST_ARCHETYPES = [0.45, 0.65, 0.75, 0.85, 0.95]  # share of pocket price, by custkey % 5
DEDUCTION_FACTOR_HOT = 4.0  # nation % 5 == 0
DEDUCTION_FACTOR = 2.0
BONUS_FACTOR_HOT = 2.5  # nation % 5 == 1
COST_UPLIFT = {2: 0.15, 3: 0.08}  # nation % 5 -> extra cost share
COST_PER_SIZE = 0.001
INVOICE_OFFSET = 0.05  # planted mismatch: size 13, line 7
MATERIAL_SHARE = 0.6
MATERIAL_SHARE_BAD = 1.05  # planted quality issue: size 50


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _r4(c):
    return round_half_up(c, 4)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )


def transactions_in_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Frames that together hold the rows of :func:`transactions_from_orders`, for a caller that stores them one by one.

    Each takes the orders of some hashes of the order key, so what its joins shuffle is that share of the line items.
    """
    parts = max(1, min(MAX_PARTS, -(-estimated_bytes(_lineitem(spark, sf_dir)) // PART_BYTES)))
    return [transactions_from_orders(spark, sf_dir, (i, parts)) for i in range(parts)]


def _of_part(df: DataFrame, key: str, part: tuple[int, int]) -> DataFrame:
    number, parts = part
    return df if parts == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == number)


def transactions_from_orders(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The 16-column bronze schema derived from the driver tables (one row per line item; ``part``: of some orders)."""
    lineitem = _of_part(_lineitem(spark, sf_dir), "l_orderkey", part)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    orders = _of_part(orders, "o_orderkey", part)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    bound = broadcast_bytes(lineitem)
    part_first, customer_first = (estimated_bytes(t) > bound for t in (part, customer))
    rows = lineitem
    if part_first:
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    if customer_first:
        buyers = customer.join(geo, customer.c_nationkey == geo.n_nationkey)
        sold = orders.join(buyers, orders.o_custkey == buyers.c_custkey)
        rows = rows.join(sold, rows.l_orderkey == sold.o_orderkey)
    else:
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
        rows = rows.join(customer, rows.o_custkey == customer.c_custkey)
        rows = rows.join(geo, rows.c_nationkey == geo.n_nationkey)
    if not part_first:
        rows = rows.join(part, rows.l_partkey == part.p_partkey)

    nk = F.col("n_nationkey") % 5
    ck = F.col("c_custkey") % 5
    archetype = F.element_at(F.array(*[F.lit(a) for a in COST_ARCHETYPES]), (ck + 1).cast("int"))
    uplift = F.when(nk == 2, F.lit(COST_UPLIFT[2])).when(nk == 3, F.lit(COST_UPLIFT[3])).otherwise(F.lit(0.0))

    blue = _r4(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
    out = rows.select(
        F.col("n_name").alias("country"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("p_brand").alias("material"),
        F.col("o_orderpriority").alias("sales_designation"),
        F.col("c_name").alias("sold_to"),
        F.col("c_mktsegment").alias("corporate_group"),
        F.col("l_quantity").cast("double").alias("sales_qty"),
        blue.alias("blue_jobber_price"),
        F.col("l_discount"),
        F.col("l_tax"),
        F.col("l_linenumber"),
        F.col("p_size"),
        nk.alias("_nk"),
        archetype.alias("_arch"),
        uplift.alias("_uplift"),
        F.col("r_name").alias("pso"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("_loaded_at"),
    )
    ded_factor = F.when(F.col("_nk") == 0, F.lit(DEDUCTION_FACTOR_HOT)).otherwise(F.lit(DEDUCTION_FACTOR))
    out = out.withColumn("deductions", _r4(F.col("blue_jobber_price") * F.col("l_discount") * ded_factor))
    offset = F.when((F.col("p_size") == 13) & (F.col("l_linenumber") == 7), F.lit(INVOICE_OFFSET)).otherwise(F.lit(0.0))
    out = out.withColumn("invoice_price", _r4(F.col("blue_jobber_price") - F.col("deductions") + offset))
    bon_factor = F.when(F.col("_nk") == 1, F.lit(BONUS_FACTOR_HOT)).otherwise(F.lit(1.0))
    out = out.withColumn("bonuses", _r4(F.col("invoice_price") * F.col("l_tax") * bon_factor))
    out = out.withColumn("pocket_price", _r4(F.col("invoice_price") - F.col("bonuses")))
    share = F.col("_arch") + F.lit(COST_PER_SIZE) * F.col("p_size") + F.col("_uplift")
    out = out.withColumn("standard_cost", _r4(F.col("pocket_price") * share))
    mat_share = F.when(F.col("p_size") == 50, F.lit(MATERIAL_SHARE_BAD)).otherwise(F.lit(MATERIAL_SHARE))
    out = out.withColumn("material_cost", _r4(F.col("standard_cost") * mat_share))
    return out.select(*BRONZE_COLUMNS)
