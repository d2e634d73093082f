"""Oracle SQL: the same queries written as plain SQL for DuckDB.

The tables ``lineitem orders customer nation region part`` are views in the
oracle session.  Each query is a chain of CTEs mirroring the layers.  The SQL
uses the same numeric forms as the Spark code so both engines produce the same
bits: ``floor(x * 10^k + 0.5) / 10^k`` rounding, ``e0`` (double) literals, and
sums of ``CAST(... AS DECIMAL(28,8))``.
"""

from __future__ import annotations

from . import catalog as C


def r(expr: str, dp: int) -> str:
    return f"(floor(({expr}) * {10 ** dp}e0 + 0.5e0) / {10 ** dp}e0)"


def xsum(expr: str) -> str:
    return f"sum(CAST(({expr}) AS DECIMAL(28,8)))"


def dbl(expr: str) -> str:
    return f"CAST(({expr}) AS DOUBLE)"


def nz(num: str, den: str) -> str:
    """Nonzero guard ratio * 100."""
    return f"(CASE WHEN ({den}) != 0 THEN ({num}) / ({den}) * 100e0 ELSE 0e0 END)"


def nullg(num: str, den: str) -> str:
    """NULL guard ratio * 100."""
    return f"(({num}) / nullif(({den}), 0) * 100e0)"


def pos(num: str, den: str) -> str:
    """Positive guard ratio * 100."""
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) * 100e0 ELSE 0e0 END)"


def sql_str(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


BRONZE_COLS = (
    "country, year, material, sales_designation, sold_to, corporate_group, sales_qty, blue_jobber_price, "
    "deductions, invoice_price, bonuses, pocket_price, pso, standard_cost, material_cost, _loaded_at"
)

TRANSACTIONS = f"""
t0 AS (
  SELECT n.n_name AS country,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         p.p_brand AS material,
         o.o_orderpriority AS sales_designation,
         c.c_name AS sold_to,
         c.c_mktsegment AS corporate_group,
         CAST(l.l_quantity AS DOUBLE) AS sales_qty,
         {r("l.l_extendedprice / nullif(l.l_quantity, 0e0)", 4)} AS blue_jobber_price,
         l.l_discount, l.l_tax, l.l_linenumber, p.p_size,
         n.n_nationkey % 5 AS nk,
         CASE c.c_custkey % 5 WHEN 0 THEN 0.45e0 WHEN 1 THEN 0.65e0 WHEN 2 THEN 0.75e0
                              WHEN 3 THEN 0.85e0 ELSE 0.95e0 END AS arch,
         CASE WHEN n.n_nationkey % 5 = 2 THEN 0.15e0 WHEN n.n_nationkey % 5 = 3 THEN 0.08e0 ELSE 0e0 END AS uplift,
         r.r_name AS pso,
         l.l_shipdate AS _loaded_at
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
t1 AS (SELECT *, {r("blue_jobber_price * l_discount * CASE WHEN nk = 0 THEN 4e0 ELSE 2e0 END", 4)} AS deductions FROM t0),
t2 AS (SELECT *, {r("blue_jobber_price - deductions + CASE WHEN p_size = 13 AND l_linenumber = 7 THEN 0.05e0 ELSE 0e0 END", 4)} AS invoice_price FROM t1),
t3 AS (SELECT *, {r("invoice_price * l_tax * CASE WHEN nk = 1 THEN 2.5e0 ELSE 1e0 END", 4)} AS bonuses FROM t2),
t4 AS (SELECT *, {r("invoice_price - bonuses", 4)} AS pocket_price FROM t3),
t5 AS (SELECT *, {r("pocket_price * (arch + 0.001e0 * p_size + uplift)", 4)} AS standard_cost FROM t4),
t6 AS (SELECT *, {r("standard_cost * CASE WHEN p_size = 50 THEN 1.05e0 ELSE 0.6e0 END", 4)} AS material_cost FROM t5),
transactions AS (SELECT {BRONZE_COLS} FROM t6)"""

DEDUP_ORDER = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in (
        "_loaded_at",
        "sales_qty",
        "blue_jobber_price",
        "deductions",
        "invoice_price",
        "bonuses",
        "pocket_price",
        "standard_cost",
        "material_cost",
        "corporate_group",
        "pso",
    )
)

QUALITY_FLAG = """CASE
      WHEN abs(invoice_price - (blue_jobber_price - deductions)) > 0.01e0 THEN 'INVOICE_MISMATCH'
      WHEN abs(pocket_price - (invoice_price - bonuses)) > 0.01e0 THEN 'POCKET_MISMATCH'
      WHEN material_cost > standard_cost THEN 'MATERIAL_COST_EXCEEDS_STANDARD'
      WHEN standard_cost <= 0 THEN 'ZERO_OR_NEGATIVE_COST'
      WHEN pocket_price < 0 THEN 'NEGATIVE_POCKET_PRICE'
      ELSE 'VALID' END"""

SILVER = f"""
deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY material, sold_to, year, country, sales_designation ORDER BY {DEDUP_ORDER}) AS rn
    FROM transactions
    WHERE sales_qty IS NOT NULL AND sales_qty > 0 AND blue_jobber_price IS NOT NULL AND blue_jobber_price > 0
  ) WHERE rn = 1
),
silver AS (
  SELECT country, year, material, sales_designation, sold_to, corporate_group, sales_qty, blue_jobber_price,
         deductions, invoice_price, bonuses, pocket_price, pso, standard_cost,
         coalesce(material_cost, 0e0) AS material_cost,
         {QUALITY_FLAG} AS data_quality_flag
  FROM deduped
)"""

FACT = f"""
fact AS (
  SELECT country, year, material, sales_designation, sold_to, corporate_group, pso,
         sales_qty, blue_jobber_price, deductions, invoice_price, bonuses, pocket_price, standard_cost, material_cost,
         pocket_price - standard_cost AS contribution_margin,
         {r(nullg("pocket_price - standard_cost", "pocket_price"), 2)} AS margin_pct,
         {r(nullg("deductions", "blue_jobber_price"), 2)} AS deduction_pct,
         {r(nullg("bonuses", "invoice_price"), 2)} AS bonus_pct,
         {r(nullg("pocket_price", "blue_jobber_price"), 2)} AS realization_pct,
         {r(nullg("blue_jobber_price - pocket_price", "blue_jobber_price"), 2)} AS leakage_pct,
         standard_cost - material_cost AS conversion_cost,
         pocket_price * sales_qty AS pocket_revenue,
         (pocket_price - standard_cost) * sales_qty AS margin_dollars
  FROM silver WHERE sales_qty > 0 AND blue_jobber_price > 0
)"""

TIER_CASE = """CASE WHEN wavg_margin_pct > 35e0 THEN 'Tier 1 - Premium'
       WHEN wavg_margin_pct > 25e0 THEN 'Tier 2 - Healthy'
       WHEN wavg_margin_pct > 15e0 THEN 'Tier 3 - Acceptable'
       WHEN wavg_margin_pct > 5e0 THEN 'Tier 4 - Low'
       ELSE 'Tier 5 - Destructive' END"""


def customers_cte(name: str = "customers", keys: str = "sold_to, corporate_group, country, pso, year") -> str:
    ratio = lambda n, d: r(f"{dbl(n)} / nullif({dbl(d)}, 0e0) * 100e0", 2)
    md, rev = xsum("margin_dollars"), xsum("pocket_revenue")
    blue = xsum("blue_jobber_price * sales_qty")
    return f"""
{name}_agg AS (
  SELECT {keys},
         {dbl(xsum("sales_qty"))} AS total_qty,
         {dbl(rev)} AS total_pocket_revenue,
         {dbl(md)} AS total_margin_dollars,
         {ratio(md, rev)} AS wavg_margin_pct,
         {ratio(rev, blue)} AS wavg_realization_pct,
         {ratio(xsum("deductions * sales_qty"), blue)} AS wavg_deduction_pct,
         {ratio(xsum("bonuses * sales_qty"), xsum("invoice_price * sales_qty"))} AS wavg_bonus_pct,
         count(*) AS transaction_count
  FROM fact GROUP BY {keys}
),
{name} AS (SELECT *, {TIER_CASE} AS margin_tier FROM {name}_agg)"""


def _avg2(c: str) -> str:
    return r(f"CASE WHEN count({c}) > 0 THEN CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}) END", 2)


ALERTS = f"""
segments AS (
  SELECT country, pso, year,
         {_avg2("deduction_pct")} AS avg_deduction_pct,
         {_avg2("bonus_pct")} AS avg_bonus_pct,
         {_avg2("margin_pct")} AS avg_margin_pct,
         {_avg2("realization_pct")} AS avg_realization_pct,
         count(*) AS transaction_count
  FROM fact GROUP BY country, pso, year
),
alerts AS (
  SELECT *,
    CASE WHEN avg_margin_pct < 10e0 THEN 'CRITICAL_MARGIN'
         WHEN avg_margin_pct < 20e0 THEN 'LOW_MARGIN'
         WHEN avg_deduction_pct > 18e0 THEN 'HIGH_DEDUCTIONS'
         WHEN avg_bonus_pct > 8e0 THEN 'HIGH_BONUSES'
         WHEN avg_realization_pct < 70e0 THEN 'LOW_REALIZATION' END AS alert_type,
    CASE WHEN avg_margin_pct < 10e0 THEN 'HIGH'
         WHEN avg_margin_pct < 20e0 THEN 'MEDIUM'
         WHEN avg_deduction_pct > 18e0 THEN 'HIGH'
         WHEN avg_bonus_pct > 8e0 THEN 'MEDIUM'
         WHEN avg_realization_pct < 70e0 THEN 'MEDIUM' END AS severity
  FROM segments
),
active AS (SELECT * FROM alerts WHERE alert_type IS NOT NULL)"""

WAVG_SPECS = [
    ("blue_price", "blue_jobber_price"),
    ("deductions", "deductions"),
    ("invoice_price", "invoice_price"),
    ("bonuses", "bonuses"),
    ("pocket_price", "pocket_price"),
    ("standard_cost", "standard_cost"),
    ("material_cost", "material_cost"),
]


def wavg(x: str) -> str:
    return f"{dbl(xsum(f'{x} * sales_qty'))} / nullif({dbl(xsum(f'CASE WHEN {x} IS NOT NULL THEN sales_qty END'))}, 0e0)"


def waterfall_sql(source: str, where: str = "", dims: list[str] | None = None) -> str:
    """Waterfall aggregate (A2 / A3) over ``source`` as a SELECT."""
    dims = dims or []
    dsel = "".join(f"{d}, " for d in dims)
    group = f"GROUP BY {', '.join(dims)}" if dims else ""
    cond = "sales_qty > 0" + (f" AND {where}" if where else "")
    inner = ",\n         ".join(f"{wavg(src)} AS w_{name}" for name, src in WAVG_SPECS)
    return f"""
SELECT {dsel}
       {r("w_blue_price", 4)} AS blue_price,
       {r("w_deductions", 4)} AS deductions,
       {r("w_invoice_price", 4)} AS invoice_price,
       {r("w_bonuses", 4)} AS bonuses,
       {r("w_pocket_price", 4)} AS pocket_price,
       {r("w_standard_cost", 4)} AS standard_cost,
       {r("w_material_cost", 4)} AS material_cost,
       {r("w_pocket_price - w_standard_cost", 4)} AS contribution_margin,
       {r(nz("w_pocket_price - w_standard_cost", "w_pocket_price"), 2)} AS margin_pct,
       {r(nz("w_deductions", "w_blue_price"), 2)} AS deduction_pct,
       {r(nz("w_bonuses", "w_invoice_price"), 2)} AS bonus_pct,
       {r(nz("w_pocket_price", "w_blue_price"), 2)} AS realization_pct,
       {r(nz("w_blue_price - w_pocket_price", "w_blue_price"), 2)} AS leakage_pct,
       {r("w_standard_cost - w_material_cost", 4)} AS conversion_cost,
       CAST(floor(q) AS BIGINT) AS total_qty,
       transaction_count,
       CAST(round(rev, 2) AS DOUBLE) AS total_pocket_revenue,
       CAST(round(md, 2) AS DOUBLE) AS total_margin_dollars
FROM (
  SELECT {dsel}
         {inner},
         {xsum("sales_qty")} AS q,
         count(*) AS transaction_count,
         {xsum("pocket_price * sales_qty")} AS rev,
         {xsum("(pocket_price - standard_cost) * sales_qty")} AS md
  FROM {source} WHERE {cond} {group}
) WHERE transaction_count > 0"""


PERIOD_FIELDS = [
    "wavg_blue_price",
    "wavg_deductions",
    "wavg_invoice_price",
    "wavg_bonuses",
    "wavg_pocket_price",
    "wavg_standard_cost",
    "wavg_margin_pct",
    "total_qty",
    "total_pocket_revenue",
    "total_margin_dollars",
    "transaction_count",
]


def periods_sql(source: str, where: str = "") -> str:
    cond = "sales_qty > 0" + (f" AND {where}" if where else "")
    return f"""
SELECT year,
       {r("w_blue", 4)} AS wavg_blue_price,
       {r("w_ded", 4)} AS wavg_deductions,
       {r("w_inv", 4)} AS wavg_invoice_price,
       {r("w_bon", 4)} AS wavg_bonuses,
       {r("w_pocket", 4)} AS wavg_pocket_price,
       {r("w_std", 4)} AS wavg_standard_cost,
       {r(nz("w_pocket - w_std", "w_pocket"), 2)} AS wavg_margin_pct,
       CAST(round(q, 4) AS DOUBLE) AS total_qty,
       CAST(round(rev, 2) AS DOUBLE) AS total_pocket_revenue,
       CAST(round(md, 2) AS DOUBLE) AS total_margin_dollars,
       transaction_count
FROM (
  SELECT year,
         {wavg("blue_jobber_price")} AS w_blue,
         {wavg("deductions")} AS w_ded,
         {wavg("invoice_price")} AS w_inv,
         {wavg("bonuses")} AS w_bon,
         {wavg("pocket_price")} AS w_pocket,
         {wavg("standard_cost")} AS w_std,
         {xsum("sales_qty")} AS q,
         {xsum("pocket_price * sales_qty")} AS rev,
         {xsum("(pocket_price - standard_cost) * sales_qty")} AS md,
         count(*) AS transaction_count
  FROM {source} WHERE {cond} GROUP BY year
)"""


def bridge_sql(source: str, y0: int, y1: int) -> str:
    price = "(c.wavg_blue_price - b.wavg_blue_price) * b.total_qty"
    ded = "-(c.wavg_deductions - b.wavg_deductions) * b.total_qty"
    bon = "-(c.wavg_bonuses - b.wavg_bonuses) * b.total_qty"
    cost = "-(c.wavg_standard_cost - b.wavg_standard_cost) * b.total_qty"
    vol = "(c.total_qty - b.total_qty) * (b.wavg_pocket_price - b.wavg_standard_cost)"
    total = "c.total_margin_dollars - b.total_margin_dollars"
    mix = f"({total}) - (((({price}) + ({ded})) + ({bon})) + ({cost}) + ({vol}))"
    cols = ",\n       ".join(
        [f"b.{f} AS base_{f}" for f in PERIOD_FIELDS] + [f"c.{f} AS current_{f}" for f in PERIOD_FIELDS]
    )
    return f"""
pm AS ({periods_sql(source, f"year IN ({y0}, {y1})")}),
bridge AS (
SELECT CAST({y0} AS INTEGER) AS base_year, CAST({y1} AS INTEGER) AS current_year,
       {cols},
       {r(price, 2)} AS price_effect,
       {r(ded, 2)} AS deduction_effect,
       {r(bon, 2)} AS bonus_effect,
       {r(cost, 2)} AS cost_effect,
       {r(vol, 2)} AS volume_effect,
       {r(mix, 2)} AS mix_effect,
       {r(total, 2)} AS total_margin_change
FROM (SELECT * FROM pm WHERE year = {y0}) b CROSS JOIN (SELECT * FROM pm WHERE year = {y1}) c
)"""


BOUNDS = """bounds AS (SELECT quantile_cont(sales_qty, 0.33) AS p33, quantile_cont(sales_qty, 0.67) AS p67 FROM {src})"""
BAND = """CASE WHEN sales_qty IS NULL THEN NULL WHEN p33 = p67 THEN 'MEDIUM' WHEN sales_qty <= p33 THEN 'LOW'
            WHEN sales_qty <= p67 THEN 'MEDIUM' ELSE 'HIGH' END"""

METRICS = [
    ("margin_pct", "low_is_bad", "pocket_price - standard_cost", "pocket_price"),
    ("deduction_pct", "high_is_bad", "deductions", "blue_jobber_price"),
    ("bonus_pct", "high_is_bad", "bonuses", "invoice_price"),
    ("realization_pct", "low_is_bad", "pocket_price", "blue_jobber_price"),
]


def outliers_ctes(source: str) -> str:
    metric_cols = ",\n         ".join(f"{nz(n, d)} AS {m}" for m, _, n, d in METRICS)
    stats = ",\n         ".join(
        f"avg({m}) AS mean_{m}, stddev_samp({m}) AS std_{m}, count({m}) AS n_{m}" for m, _, _, _ in METRICS
    )
    branches = []
    for m, direction, _, _ in METRICS:
        z = f"CASE WHEN s.n_{m} >= 3 AND s.std_{m} > 1e-9 THEN (r.{m} - s.mean_{m}) / s.std_{m} END"
        cmp = "z <= -1.8e0" if direction == "low_is_bad" else "z >= 1.8e0"
        branches.append(
            f"""SELECT sold_to, corporate_group, country, pso, material, year, sales_qty, volume_band, peer_group,
         '{m}' AS metric, {r("v", 4)} AS value, {r("mu", 4)} AS peer_mean, {r("sd", 4)} AS peer_std,
         {r("z", 4)} AS z_score, CASE WHEN abs(z) >= 2.5e0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         '{direction}' AS direction
  FROM (SELECT r.*, r.{m} AS v, s.mean_{m} AS mu, s.std_{m} AS sd, {z} AS z
        FROM orows r JOIN ostats s ON r.peer_group = s.peer_group)
  WHERE z IS NOT NULL AND {cmp}"""
        )
    union = "\n  UNION ALL\n  ".join(branches)
    return f"""
{BOUNDS.format(src=f"(SELECT * FROM {source} WHERE sales_qty > 0)")},
obase AS (
  SELECT sold_to, corporate_group, country, pso, material, year, sales_qty,
         {BAND} AS volume_band,
         {metric_cols}
  FROM {source} CROSS JOIN bounds WHERE sales_qty > 0
),
orows AS (SELECT *, material || '|' || country || '|' || volume_band AS peer_group FROM obase),
ostats AS (
  SELECT peer_group,
         {stats}
  FROM orows GROUP BY peer_group
),
flags AS (
  {union}
)"""


OUTLIER_ORDER = (
    "abs(z_score) DESC, sold_to, metric, material, country, year, sales_qty, value, pso, corporate_group"
)


def payload_sql(pso: str, y0: int | None = None, y1: int | None = None) -> str:
    """Insight payload over one PSO: waterfall + top-5 outliers of the slice + bridge (with two years)."""
    bridged = y0 is not None
    p4, p2, m2 = "DECIMAL(20,4)", "DECIMAL(20,2)", "DECIMAL(24,2)"
    wf_fields = [
        ("blue_price", p4), ("deductions", p4), ("invoice_price", p4), ("bonuses", p4), ("pocket_price", p4),
        ("standard_cost", p4), ("contribution_margin", p4), ("margin_pct", p2), ("deduction_pct", p2),
        ("bonus_pct", p2), ("realization_pct", p2), ("leakage_pct", p2), ("total_qty", None),
        ("transaction_count", None), ("total_pocket_revenue", m2), ("total_margin_dollars", m2),
    ]
    cast = lambda c, t: c if t is None else f"CAST({c} AS {t})"
    w_struct = ", ".join(f"{c} := {cast(c, t)}" for c, t in wf_fields)
    o_struct = (
        f"sold_to := sold_to, corporate_group := corporate_group, metric := metric, "
        f"value := CAST(value AS {p4}), peer_mean := CAST(peer_mean AS {p4}), "
        f"z_score := CAST(z_score AS {p4}), severity := severity"
    )
    effects = ["total_margin_change", "price_effect", "deduction_effect", "bonus_effect", "cost_effect",
               "volume_effect", "mix_effect"]
    b_struct = (
        "base_year := base_year, current_year := current_year, "
        f"base_margin_pct := CAST(base_wavg_margin_pct AS {p2}), "
        f"current_margin_pct := CAST(current_wavg_margin_pct AS {p2}), "
        + ", ".join(f"{e} := CAST({e} AS {m2})" for e in effects)
    )
    return (
        with_(
            TRANSACTIONS,
            f"\nslice AS (SELECT * FROM transactions WHERE pso = {sql_str(pso)})",
            f"\nwf AS ({waterfall_sql('slice')})",
            outliers_ctes("slice"),
            f"\ntop AS (SELECT * FROM flags ORDER BY {OUTLIER_ORDER} LIMIT 5)",
            *([bridge_sql("transactions", y0, y1)] if bridged else []),
        )
        + f"""SELECT '{{"waterfall":' || to_json(w) ||
       CASE WHEN o IS NULL THEN '' ELSE ',"top_outliers":' || to_json(o) END ||
       CASE WHEN b IS NULL THEN '' ELSE ',"yoy_bridge":' || to_json(b) END || '}}' AS payload
FROM (SELECT struct_pack({w_struct}) AS w FROM wf)
CROSS JOIN (SELECT list(struct_pack({o_struct}) ORDER BY {OUTLIER_ORDER}) AS o FROM top)
CROSS JOIN (SELECT {f"max(struct_pack({b_struct})) AS b FROM bridge" if bridged else "NULL AS b"})"""
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE = [TRANSACTIONS]
SILVER_CHAIN = [TRANSACTIONS, SILVER]
FACT_CHAIN = [TRANSACTIONS, SILVER, FACT]


def build() -> dict[str, str]:
    pso, year_f, country_f = sql_str(C.PSO), C.FILTER_YEAR, sql_str(C.FILTER_COUNTRY)
    y0, y1, qy = C.BASE_YEAR, C.CURRENT_YEAR, C.QUESTION_YEAR
    seg_wf = waterfall_sql("transactions", dims=["country", "pso", "year"])
    pso_wf = waterfall_sql("transactions", dims=["pso"])
    health = "CASE WHEN margin_pct >= 25e0 THEN 'green' WHEN margin_pct >= 15e0 THEN 'amber' ELSE 'red' END"
    zband = "CASE WHEN abs(z_score) >= 3e0 THEN 'red' WHEN abs(z_score) >= 2e0 THEN 'orange' ELSE 'gray' END"
    steps = " UNION ALL ".join(
        f"SELECT pso, {i} AS step, '{name}' AS name, CAST({base} AS DOUBLE) AS base, CAST({val} AS DOUBLE) AS value, "
        f"CAST({pct} AS DOUBLE) AS pct FROM wf"
        for i, (name, base, val, pct) in enumerate(
            [
                ("Blue Price", "0e0", "blue_price", "NULL"),
                ("Deductions", "invoice_price", "deductions", "deduction_pct"),
                ("Invoice", "0e0", "invoice_price", "NULL"),
                ("Bonuses", "pocket_price", "bonuses", "bonus_pct"),
                ("Pocket", "0e0", "pocket_price", "NULL"),
                ("Std Cost", "contribution_margin", "standard_cost", "NULL"),
                ("Margin", "0e0", "contribution_margin", "margin_pct"),
            ],
            start=1,
        )
    )
    bridge_steps = " UNION ALL ".join(
        f"SELECT base_year, current_year, {i} AS step, '{label}' AS label, {col} AS value FROM bridge"
        for i, (label, col) in enumerate(
            [
                ("Price", "price_effect"),
                ("Deduct", "deduction_effect"),
                ("Bonus", "bonus_effect"),
                ("Cost", "cost_effect"),
                ("Volume", "volume_effect"),
                ("Mix", "mix_effect"),
            ],
            start=1,
        )
    )
    accepted_years = "2023, 2024, 2025, 2026"
    checks_fact = [
        ("country", "not_null", None),
        ("year", "not_null", None),
        ("year", "accepted_values", accepted_years),
        ("material", "not_null", None),
        ("sold_to", "not_null", None),
        ("pso", "not_null", None),
        ("sales_qty", "not_null", None),
        ("margin_pct", "not_null", None),
        ("realization_pct", "not_null", None),
    ]
    tiers = "'Tier 1 - Premium', 'Tier 2 - Healthy', 'Tier 3 - Acceptable', 'Tier 4 - Low', 'Tier 5 - Destructive'"
    checks_cust = [
        ("sold_to", "not_null", None),
        ("margin_tier", "not_null", None),
        ("margin_tier", "accepted_values", tiers),
        ("wavg_margin_pct", "not_null", None),
        ("total_qty", "not_null", None),
    ]

    def check_sel(table, src, col, check, values):
        cond = f"{col} IS NULL" if values is None else f"NOT ({col} IN ({values}))"
        return (
            f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{check}' AS check_name, "
            f"CAST(count_if({cond}) AS BIGINT) AS failures FROM {src}"
        )

    checks_sql = " UNION ALL ".join(
        [check_sel("waterfall_fact", "fact", *c) for c in checks_fact]
        + [check_sel("customer_profitability", "customers", *c) for c in checks_cust]
    )
    prices = ["sales_qty", "blue_jobber_price", "deductions", "invoice_price", "bonuses", "pocket_price", "standard_cost"]
    names = ["sold_to", "corporate_group", "country", "pso", "material", "year"]
    required = {"waterfall": [*prices, "material_cost"], "period_metrics": ["year", *prices], "outliers": names + prices}
    required_sql = " UNION ALL ".join(
        f"SELECT '{operator}' AS operator, '{c}' AS column_name, true AS present, "
        f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_rows FROM transactions"
        for operator, columns in required.items()
        for c in columns
    )
    fact_slice_cols = (
        "country, year, material, sales_designation, sold_to, corporate_group, pso, sales_qty, blue_jobber_price, "
        "deductions, invoice_price, bonuses, pocket_price, standard_cost, material_cost, contribution_margin, "
        "margin_pct, deduction_pct, bonus_pct, realization_pct, leakage_pct"
    )
    view_cols = (
        f"*, pocket_price - standard_cost AS contribution_margin, "
        f"{pos('pocket_price - standard_cost', 'pocket_price')} AS margin_pct, "
        f"{pos('deductions', 'blue_jobber_price')} AS deduction_pct, "
        f"{pos('bonuses', 'invoice_price')} AS bonus_pct, "
        f"{pos('pocket_price', 'blue_jobber_price')} AS realization_pct, "
        f"{pos('blue_jobber_price - pocket_price', 'blue_jobber_price')} AS leakage_pct"
    )
    metric_cols = ", ".join(f"{nz(n, d)} AS {m}" for m, _, n, d in METRICS)
    cust = customers_cte()
    active_cols = "country, pso, year, alert_type, severity, avg_margin_pct, avg_deduction_pct, avg_bonus_pct"

    row_pcts = (
        "\npcts AS (SELECT (pocket_price - standard_cost) / nullif(pocket_price, 0e0) * 100e0 AS m, "
        "pocket_price / nullif(blue_jobber_price, 0e0) * 100e0 AS rl, "
        "deductions / nullif(blue_jobber_price, 0e0) * 100e0 AS d, material_cost > standard_cost AS dq "
        "FROM transactions)"
    )
    mean = lambda c: r(f"{dbl(xsum(c))} / count({c})", 4)
    tier_bins = [(-999, 5, "Tier 5 Destructive"), (5, 15, "Tier 4 Low"), (15, 25, "Tier 3 Acceptable"),
                 (25, 35, "Tier 2 Healthy"), (35, 999, "Tier 1 Premium")]
    tier_case = "CASE " + " ".join(f"WHEN m > {lo}e0 AND m <= {hi}e0 THEN '{t}'" for lo, hi, t in tier_bins) + " END"
    return {
        "profile_transactions": with_(*BASE, row_pcts)
        + f"""SELECT count(*) AS rows, {mean("m")} AS avg_margin_pct, {mean("rl")} AS avg_realization_pct,
       {mean("d")} AS avg_deduction_pct, CAST(count_if(dq) AS BIGINT) AS dq_rows,
       CAST(count_if(d > 25) AS BIGINT) AS high_deduction_rows, CAST(count_if(m < 10) AS BIGINT) AS critical_margin_rows
FROM pcts""",
        "tier_histogram": with_(*BASE, row_pcts) + f"SELECT {tier_case} AS tier, count(*) AS rows FROM pcts GROUP BY 1",
        "bronze_transactions": with_(*BASE) + "SELECT * FROM transactions",
        "bronze_csv_roundtrip": with_(*BASE) + "SELECT * FROM transactions",
        "bronze_batch_table": with_(*BASE) + "SELECT * FROM transactions",
        "bronze_table_append": with_(*BASE) + "SELECT * FROM transactions UNION ALL SELECT * FROM transactions",
        "silver_layer_table": with_(*SILVER_CHAIN) + "SELECT * FROM silver",
        "price_percentiles": "SELECT round(quantile_cont(l_extendedprice, 0.33), 4) AS p33, "
        "round(quantile_cont(l_extendedprice, 0.67), 4) AS p67 FROM lineitem",
        "silver_transactions": with_(*SILVER_CHAIN) + "SELECT * FROM silver",
        "quality_flag_counts": with_(*SILVER_CHAIN)
        + "SELECT data_quality_flag, count(*) AS rows FROM silver GROUP BY data_quality_flag",
        "waterfall_fact": with_(*FACT_CHAIN) + "SELECT * FROM fact",
        "waterfall_fact_view": with_(*BASE) + f"SELECT {view_cols} FROM transactions WHERE sales_qty > 0",
        "outlier_metric_columns": with_(*BASE) + f"SELECT *, {metric_cols} FROM transactions",
        "fact_slice": with_(*FACT_CHAIN)
        + f"SELECT {fact_slice_cols} FROM fact WHERE year = {year_f} AND pso = {pso}",
        "customer_profitability": with_(*FACT_CHAIN, cust) + "SELECT * FROM customers",
        "customer_layer_refreshed": with_(*FACT_CHAIN, cust) + "SELECT * FROM customers",
        "customers_by_margin": with_(*FACT_CHAIN, cust)
        + "SELECT sold_to, corporate_group, country, pso, year, total_qty, total_pocket_revenue, total_margin_dollars, "
        "wavg_margin_pct, wavg_realization_pct, margin_tier FROM customers "
        "ORDER BY wavg_margin_pct ASC NULLS LAST, sold_to, country, year",
        "waterfall_alerts": with_(*FACT_CHAIN, ALERTS) + "SELECT * FROM active",
        "active_alerts": with_(*FACT_CHAIN, ALERTS)
        + f"SELECT {active_cols} FROM active "
        "ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, country, pso, year",
        "data_checks": with_(*FACT_CHAIN, cust) + checks_sql,
        "data_checks_years": with_(*FACT_CHAIN, cust)
        + checks_sql.replace(f"NOT (year IN ({accepted_years}))", "year NOT BETWEEN 1995 AND 2000"),
        "stored_status": with_(*BASE)
        + "SELECT 'ok' AS status, 'bronze layer' AS data_source, count(*) AS row_count FROM transactions",
        "stored_coverage": with_(*BASE)
        + "SELECT year, count(*) AS row_count, CAST(count_if(standard_cost IS NULL) AS BIGINT) AS rows_without_cost, "
        "min(sales_qty) AS min_qty, max(sales_qty) AS max_qty FROM transactions GROUP BY year",
        "required_columns": with_(*BASE) + required_sql,
        "dataset_status": with_(*BASE)
        + "SELECT 'ok' AS status, 'driver tables' AS data_source, count(*) AS row_count FROM transactions",
        "compute_waterfall": with_(*BASE) + waterfall_sql("transactions"),
        "compute_waterfall_filtered": with_(*BASE)
        + waterfall_sql("transactions", where=f"country = {country_f} AND year = {year_f}"),
        "waterfall_by_segment": with_(*BASE) + f"SELECT *, {health} AS margin_health FROM ({seg_wf})",
        "waterfall_steps": with_(*BASE, f"\nwf AS ({pso_wf})") + steps,
        "period_metrics": with_(*BASE) + periods_sql("transactions"),
        "margin_bridge": with_(*BASE, bridge_sql("transactions", y0, y1)) + "SELECT * FROM bridge",
        "volume_bands": with_(*BASE, "\n" + BOUNDS.format(src="transactions"))
        + f"SELECT transactions.*, {BAND} AS volume_band FROM transactions CROSS JOIN bounds",
        "detect_outliers": with_(*SILVER_CHAIN, outliers_ctes("silver")) + "SELECT * FROM flags",
        "outlier_summary": with_(*SILVER_CHAIN, outliers_ctes("silver"))
        + "SELECT sold_to, corporate_group, country, pso, material, year, metric, value, peer_mean, z_score, "
        f"severity, peer_group, {zband} AS z_band FROM flags ORDER BY {OUTLIER_ORDER}",
        "top_outliers": with_(*SILVER_CHAIN, outliers_ctes("silver"))
        + f"SELECT * FROM flags ORDER BY {OUTLIER_ORDER} LIMIT 5",
        "readonly_sql": with_(*FACT_CHAIN, customers_cte("customer_profitability"))
        + f"SELECT pso, margin_tier, customers, CAST(transactions AS BIGINT) AS transactions "
        f"FROM ({C.READONLY_QUERY})",
        "q_overall_waterfall": with_(*BASE) + waterfall_sql("transactions"),
        "q_margin_by_country": with_(*BASE)
        + f"SELECT country, margin_pct, {health} AS margin_health, total_qty, total_pocket_revenue, "
        f"total_margin_dollars, transaction_count FROM ({waterfall_sql('transactions', dims=['country'])})",
        "q_low_margin_customers": with_(*FACT_CHAIN, cust)
        + "SELECT sold_to, corporate_group, country, year, wavg_margin_pct, total_pocket_revenue, margin_tier "
        f"FROM customers WHERE pso = {pso} AND wavg_margin_pct < {C.LOW_MARGIN_THRESHOLD}e0 "
        "ORDER BY wavg_margin_pct, sold_to, country, year",
        "q_margin_change": with_(*BASE, bridge_sql("transactions", y0, y1)) + bridge_steps,
        "q_deduction_by_material": with_(*BASE)
        + f"""SELECT material, {r(f"{dbl('ded')} / nullif({dbl('blue')}, 0e0) * 100e0", 2)} AS deduction_rate_pct,
       CAST(round(ded, 2) AS DOUBLE) AS total_deduction_dollars, transaction_count
FROM (SELECT material, {xsum("deductions * sales_qty")} AS ded, {xsum("blue_jobber_price * sales_qty")} AS blue,
             count(*) AS transaction_count
      FROM transactions WHERE sales_qty > 0 GROUP BY material)
ORDER BY deduction_rate_pct DESC NULLS LAST, material LIMIT 1""",
        "q_top_customers_revenue": with_(*FACT_CHAIN)
        + f"""SELECT sold_to, corporate_group, CAST(round(rev, 2) AS DOUBLE) AS total_pocket_revenue,
       {r(f"{dbl('md')} / nullif({dbl('rev')}, 0e0) * 100e0", 2)} AS wavg_margin_pct, transaction_count
FROM (SELECT sold_to, corporate_group, {xsum("pocket_revenue")} AS rev, {xsum("margin_dollars")} AS md,
             count(*) AS transaction_count FROM fact GROUP BY sold_to, corporate_group)
ORDER BY total_pocket_revenue DESC, sold_to, corporate_group LIMIT 5""",
        "q_active_alerts": with_(*FACT_CHAIN, ALERTS)
        + f"SELECT {active_cols} FROM active "
        "ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, country, pso, year",
        "q_realization_by_pso": with_(*BASE)
        + "SELECT pso, realization_pct, leakage_pct, blue_price, pocket_price, transaction_count FROM ("
        + waterfall_sql("transactions", where=f"year = {qy}", dims=["pso"])
        + ")",
        "q_low_tier_groups": with_(*FACT_CHAIN, customers_cte("groups", "corporate_group, country"))
        + "SELECT corporate_group, country, wavg_margin_pct, total_pocket_revenue, transaction_count, margin_tier "
        "FROM groups WHERE margin_tier IN ('Tier 4 - Low', 'Tier 5 - Destructive')",
        "q_full_analysis": payload_sql(C.PSO, y0, y1),
        "analyze_waterfall": with_(*BASE) + waterfall_sql("transactions", where=f"pso = {pso}"),
        "analyze_outliers": with_(*BASE, f"\nslice AS (SELECT * FROM transactions WHERE pso = {pso})", outliers_ctes("slice"))
        + "SELECT * FROM flags",
        "analyze_trends": with_(*BASE, bridge_sql("transactions", y0, y1)) + "SELECT * FROM bridge",
        "analyze_narrative": payload_sql(C.PSO),
        "q_bonus_by_material": with_(*BASE)
        + f"""SELECT material, CAST(round(bon, 2) AS DOUBLE) AS total_bonus_dollars,
       {r(f"{dbl('bon')} / nullif({dbl('inv')}, 0e0) * 100e0", 2)} AS wavg_bonus_pct, transaction_count
FROM (SELECT material, {xsum("bonuses * sales_qty")} AS bon, {xsum("invoice_price * sales_qty")} AS inv,
             count(*) AS transaction_count FROM transactions WHERE sales_qty > 0 GROUP BY material)
ORDER BY total_bonus_dollars DESC, material LIMIT 5""",
        "q_deduction_by_pso": with_(*BASE)
        + "SELECT pso, deduction_pct, deductions, blue_price, transaction_count FROM ("
        + waterfall_sql("transactions", where=f"year = {qy}", dims=["pso"])
        + ")",
        "q_outlier_customers": with_(*SILVER_CHAIN, outliers_ctes("silver"))
        + """SELECT sold_to, corporate_group,
       CAST(count_if(metric = 'deduction_pct') AS BIGINT) AS deduction_flags,
       CAST(count_if(metric = 'margin_pct') AS BIGINT) AS margin_flags,
       CAST(count_if(severity = 'HIGH') AS BIGINT) AS high_flags,
       max(abs(z_score)) AS max_abs_z
FROM flags WHERE metric IN ('deduction_pct', 'margin_pct') GROUP BY sold_to, corporate_group""",
    }


ORACLE_SQL = build()
