"""The star-schema tables read as a household panel.

Orders are households, line items are their members, the part of the head's
line is its dwelling, and the customer's nation is its region. The order year
is the wave; the last wave takes every later year, so no row is left out.
Questions that a household skips give the missing answers: a household without
members has no head, and some answers are only asked after another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import assemble

WAVES = (1, 2, 3, 4, 5)

# Order that decides a household's first member.
MEMBER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# Electricity is asked in dwellings larger than this, per wave.
ELECTRICITY_ASKED_ABOVE = {1: 39, 2: 37, 3: 36, 4: 31, 5: 15}

CATEGORICAL = ["head_sex", "housing_tenure", "floor_material", "electricity_source", "water_source", "rural_urban"]
NUMERIC = ["head_age", "rooms", "household_size"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(column: str, values: list[str]):
    col = F.col(column)
    rule = F.when(col == values[0], 1)
    for i, v in enumerate(values[1:], 2):
        rule = rule.when(col == v, i)
    return rule


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension `(region_code, zone, zone_rank)`."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("region_code"), F.col("r_name").alias("zone"),
        F.col("r_regionkey").alias("zone_rank"))


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household section `(hhid, wave, region, rural_urban, water_source, segment)`."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    base = orders.select(
        F.col("o_orderkey").alias("hhid"), F.col("o_custkey").alias("c_custkey"),
        F.least(F.year("o_orderdate") - 1994, F.lit(5)).cast("int").alias("wave"),
        _code("o_orderstatus", ["F", "O", "P"]).alias("rural_urban"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("water_source"))
    owner = customer.select("c_custkey", F.col("c_nationkey").alias("region"),
                            _code("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD",
                                                   "MACHINERY"]).alias("segment"))
    return base.join(owner, "c_custkey", "left").drop("c_custkey")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head of each household with its member count."""
    line = table(spark, sf_dir, "lineitem")
    return assemble.head_rows(line, "l_orderkey", "l_linenumber", MEMBER_ORDER,
                              ["l_partkey", "l_quantity", "l_returnflag", "l_linestatus"])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table: one row per household with its zone, answers missing where not asked."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_size",
        _code("p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).alias("floor_material"))
    head = heads(spark, sf_dir).join(part, "l_partkey", "left").withColumnRenamed("l_orderkey", "hhid")
    joined = households(spark, sf_dir).join(head, "hhid", "left")
    asked = F.lit(False)
    for wave, size in ELECTRICITY_ASKED_ABOVE.items():
        asked = asked | ((F.col("wave") == wave) & (F.col("p_size") > size))
    dim = zones(spark, sf_dir)
    return joined.join(dim.withColumnRenamed("region_code", "region"), "region", "left").select(
        "hhid", "wave", "zone", "zone_rank", "region", "rural_urban", "water_source",
        F.col("household_size"), F.col("l_quantity").alias("head_age"),
        F.when(F.col("l_returnflag") != "N", F.col("p_size").cast("double")).alias("rooms"),
        _code("l_linestatus", ["F", "O"]).alias("head_sex"),
        _code("l_returnflag", ["A", "N", "R"]).alias("housing_tenure"),
        "floor_material", F.when(asked, F.col("segment")).alias("electricity_source"))


def with_sql(body: str, ctes: str) -> str:
    return f"WITH {ctes}\n{body}"


_ORDER_SQL = ", ".join(MEMBER_ORDER)

SQL_HOUSEHOLDS = """
hh AS (
  SELECT o_orderkey AS hhid, CAST(least(year(o_orderdate) - 1994, 5) AS INTEGER) AS wave,
         c_nationkey AS region,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS rural_urban,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS water_source,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                           WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

SQL_HEADS = f"""
head AS (
  SELECT l_orderkey AS hhid, l_partkey, l_quantity, l_returnflag, l_linestatus, household_size
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END, {_ORDER_SQL}) AS rn,
               count(*) OVER (PARTITION BY l_orderkey) AS household_size
        FROM lineitem) WHERE rn = 1)"""

SQL_FEATURES = f"""{SQL_HOUSEHOLDS},{SQL_HEADS},
ft AS (
  SELECT hh.hhid, wave, r_name AS zone, r_regionkey AS zone_rank, region, rural_urban, water_source,
         household_size, l_quantity AS head_age,
         CASE WHEN l_returnflag <> 'N' THEN CAST(p_size AS DOUBLE) END AS rooms,
         CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS head_sex,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS housing_tenure,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                     WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS floor_material,
         CASE WHEN p_size > CASE wave {" ".join(f"WHEN {w} THEN {s}" for w, s in ELECTRICITY_ASKED_ABOVE.items())} END
              THEN segment END AS electricity_source
  FROM hh LEFT JOIN head USING (hhid) LEFT JOIN part ON l_partkey = p_partkey
       LEFT JOIN nation ON region = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def sql_key(key: str, seed: int) -> str:
    """The arithmetic sampling number in SQL."""
    return f"((({key} % 2147483648) * 1103515245 + {12345 + 7919 * seed}) % 2147483648)"


# Codes of the stand-in answers, and weights of the linear score used where an exact attribution is wanted.
CODES = {"head_sex": 2, "housing_tenure": 3, "floor_material": 6, "electricity_source": 5, "water_source": 5,
         "rural_urban": 3}


def code_lists() -> dict[str, list[str]]:
    return {f: [str(c) for c in range(1, n + 1)] for f, n in CODES.items()}


def score_weights() -> dict[str, float]:
    """Weight of each design column in the linear score."""
    weights = {"head_age": 0.004, "rooms": 0.006, "household_size": 0.02}
    for i, (feature, n) in enumerate(CODES.items()):
        for code in range(1, n + 1):
            weights[f"{feature}_{code}"] = (i + 1) * 0.01 * (code - n / 3)
    return weights


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design matrix of all households with their wave and zone."""
    from panelspark.operators.encode import design_matrix

    return design_matrix(features(spark, sf_dir), ["hhid", "wave", "zone"], NUMERIC, code_lists())


def attribution_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact attribution of a linear score, one column per design column.

    Each column gets its weight times the distance from the wave's mean; a
    missing answer counts as the mean.
    """
    x = design(spark, sf_dir)
    return x.join(wave_means(x), "wave").select("hhid", "wave", "zone", *[p.alias(c) for c, p in attribution_columns().items()])


def attribution_columns() -> dict[str, Column]:
    """The attribution of each column of a design row that carries the means `m_<column>` of its wave."""
    return {c: F.coalesce((F.col(c) - F.col(f"m_{c}")) * w, F.lit(0.0)) for c, w in score_weights().items()}


def wave_means(x: DataFrame) -> DataFrame:
    """Mean of each design column per wave: one row per wave, so it is broadcast."""
    return F.broadcast(x.groupBy("wave").agg(*[F.avg(c).alias(f"m_{c}") for c in score_weights()]))


def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a long table `(hhid, wave, zone, column, phi)`."""
    from panelspark.operators.explain import to_long

    return to_long(attribution_wide(spark, sf_dir), ["hhid", "wave", "zone"], list(score_weights()))


def _sql_design() -> str:
    dummies = ", ".join(f"CAST({f} = {c} AS DOUBLE) AS {f}_{c}" for f, n in CODES.items() for c in range(1, n + 1))
    return f"""
x AS (SELECT hhid, wave, zone, head_age, rooms, CAST(household_size AS DOUBLE) AS household_size, {dummies} FROM ft)"""


def _sql_attribution() -> str:
    w = score_weights()
    means = ", ".join(f"avg({c}) AS m_{c}" for c in w)
    phi = ", ".join(f"coalesce(({c} - m_{c}) * {v!r}, 0.0) AS {c}" for c, v in w.items())
    return f"""
m AS (SELECT wave, {means} FROM x GROUP BY wave),
wide AS (SELECT hhid, x.wave, zone, {phi} FROM x JOIN m ON x.wave = m.wave),
phi AS (UNPIVOT wide ON {", ".join(w)} INTO NAME "column" VALUE phi)"""


SQL_DESIGN = f"{SQL_FEATURES},{_sql_design()}"
SQL_ATTRIBUTION = f"{SQL_DESIGN},{_sql_attribution()}"

# Importance of each feature per household, then per zone, then overall.
SQL_IMPORTANCE = f"""{SQL_ATTRIBUTION},
byf AS (SELECT hhid, wave, zone, CASE {" ".join(f"WHEN starts_with(\"column\", '{f}') THEN '{f}'" for f in CODES)}
               ELSE "column" END AS feature, sum(abs(phi)) AS importance
        FROM phi GROUP BY ALL),
zt AS (SELECT wave, zone, feature, avg(importance) AS mean_importance, count(*) AS n_households
       FROM byf WHERE zone IS NOT NULL GROUP BY ALL),
ov AS (SELECT wave, feature, avg(mean_importance) AS importance FROM zt GROUP BY ALL)"""
