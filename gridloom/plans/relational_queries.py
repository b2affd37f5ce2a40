"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.operators import metrics as M
from gridloom.operators import relational as R
from gridloom.plans.base import BUILDINGS_SQL, KIND_SQL, buildings, query, sites, table

_LOAD = "sum(CASE WHEN n = 0 THEN 0 ELSE p * (g + (1 - g) * pow(n, -0.75)) END)"
_CLASS = "CASE WHEN kind IN ('SFH', 'MFH', 'TH', 'AB') THEN 'Residential' ELSE kind END"


@query(f"""
    WITH c AS (SELECT nation, {_CLASS} AS class, CAST(sum(peak) AS DOUBLE) AS p, CAST(sum(units) AS DOUBLE) AS n FROM ({BUILDINGS_SQL}) b GROUP BY 1, 2),
    l AS (SELECT nation, {_LOAD} AS load FROM (SELECT *, CASE class WHEN 'Residential' THEN 0.07 WHEN 'Commercial' THEN 0.5 ELSE 0.6 END::DOUBLE AS g FROM c) x GROUP BY 1)
    SELECT n_name, round(load, 6) AS load, CASE WHEN load < 100 THEN 100 WHEN load < 160 THEN 160 WHEN load < 250 THEN 250 WHEN load < 400 THEN 400 WHEN load < 630 THEN 630 END AS size_kva
    FROM l JOIN nation ON nation = n_nationkey
""")
def q01_sim_peak_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the simultaneous load of its sites and the smallest transformer above it."""
    loads = M.simultaneous_load_by(buildings(spark, sf_dir), ["nation"], "kind", "peak", "units")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return loads.join(names, F.col("nation") == F.col("n_nationkey")).select("n_name", F.round("load", 6).alias("load"), E.next_capacity(F.col("load"), E.MAPPED_CAPACITIES).alias("size_kva"))


@query(f"""
    SELECT site, kind, CAST(units AS INTEGER) AS units, CAST(round(peak, 6) AS DOUBLE) AS peak,
           CAST(CASE WHEN kind IN ('Commercial', 'Public') AND peak > 30 AND peak > 100 THEN 0 ELSE round(peak, 6) END AS DOUBLE) AS served
    FROM ({BUILDINGS_SQL}) b WHERE peak > 0
""")
def q02_building_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and peak of every site, and the peak that the network serves."""
    rows = buildings(spark, sf_dir).where("peak > 0")
    served = E.without_large_consumers(F.col("kind"), F.col("peak"))
    return rows.select("site", "kind", F.col("units").cast("int").alias("units"), F.round("peak", 6).alias("peak"), F.round(served, 6).alias("served"))


@query("""
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus IN ('F', 'O') AND l_quantity >= 25 AND l_quantity < 45 AND l_shipdate IS NOT NULL AND l_tax <> 0
""")
def q03_filter_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of a filtered scan."""
    rows = R.filter_equal(table(spark, sf_dir, "lineitem"), l_returnflag="R")
    q = F.col("l_quantity")
    rows = rows.where(F.col("l_linestatus").isin("F", "O") & (q >= 25) & (q < 45) & F.col("l_shipdate").isNotNull() & (F.col("l_tax") != 0))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
    SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def q04_inner_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    per_customer = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = per_customer.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""
    SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS n, count(l_orderkey) = 0 AS unused FROM (SELECT * FROM lineitem WHERE l_quantity >= 49) l
    RIGHT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def q05_right_join_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with its number of large lines, and a flag where there is none."""
    counts = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").groupBy("l_suppkey").agg(F.count("*").alias("c"))
    rows = counts.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "right")
    return rows.select("s_suppkey", F.coalesce("c", F.lit(0).cast("long")).alias("n"), F.col("c").isNull().alias("unused"))


@query("""
    WITH v(k) AS (VALUES (1), (2), (999999937)), o AS (SELECT o_custkey AS ok, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1)
    SELECT CAST(coalesce(k, ok) AS BIGINT) AS custkey, n, k IS NOT NULL AS listed FROM o FULL JOIN v ON ok = k
""")
def q06_full_outer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all customers against an inline list, both sides kept."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([(1,), (2,), (999999937,)], "k long")
    return counts.join(listed, F.col("o_custkey") == F.col("k"), "full").select(F.coalesce("k", "o_custkey").alias("custkey"), "n", F.col("k").isNotNull().alias("listed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def q07_anti_join_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    done = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return R.unfinished(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("""
    SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN true
           WHEN o_totalprice > 300000 THEN true ELSE false END AS filtered FROM orders
""")
def q08_semi_flag_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders flagged by a threshold, then by lines that match, and the rest set to false."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, True).alias("filtered"))
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.flag_matches(rows, large, ["o_orderkey"], "filtered").select("o_orderkey", F.coalesce("filtered", F.lit(False)).alias("filtered"))


@query("""
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) e WHERE nth = 1
""")
def q09_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return R.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""
    SELECT doc_id, source, n_chars FROM documents
    WHERE NOT (coalesce(text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1), false) AND coalesce(source LIKE '%1%', false))
""")
def q10_duplicate_pattern_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those copies whose source matches a pattern."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return R.drop_marked_duplicates(rows, "digest", F.col("source").like("%1%")).select("doc_id", "source", "n_chars")


@query("""
    SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY 1
""")
def q11_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, events and days of each type."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS share FROM part")
def q12_scalar_crossjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as shares of the largest."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    most = rows.agg(F.max("p_retailprice").alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("p_partkey", F.round(F.col("p_retailprice") / F.col("most"), 6).alias("share"))


@query("""
    WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), e AS (SELECT unnest(range(10)) AS bin),
    c AS (SELECT least(greatest(ceil((c_acctbal - lo) * 10 / (hi - lo)) - 1, 0), 9) AS bin, count(*) AS n FROM customer, b GROUP BY 1)
    SELECT CAST(e.bin AS INTEGER) AS bin, round(lo + e.bin * ((hi - lo) / 10), 6) AS low, round(lo + (e.bin + 1) * ((hi - lo) / 10), 6) AS high, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM e CROSS JOIN b LEFT JOIN c ON c.bin = e.bin
""")
def q36_histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of account balances."""
    rows = R.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 10)
    return rows.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("""
    WITH p AS (SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS p FROM customer GROUP BY 1)
    SELECT nation, CAST(round_even(p / (SELECT sum(p) FROM p)::DOUBLE * 200, 0) AS BIGINT) AS n FROM p
""")
def q37_population_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred samples shared over nations by population, rounded half to even."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("people"))
    return R.allocation(rows, "nation", "people", 200)


@query("""
    WITH p AS (SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS p FROM customer GROUP BY 1),
    a AS (SELECT nation, CAST(round_even(p / (SELECT sum(p) FROM p)::DOUBLE * 200, 0) AS BIGINT) AS n FROM p),
    r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 48271) % 2147483647) AS nth FROM customer)
    SELECT c_nationkey AS nation, c_custkey FROM r JOIN a ON c_nationkey = nation WHERE nth <= n
""")
def q38_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each nation in proportion, drawn by a hash."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    sizes = R.allocation(rows.withColumn("people", F.lit(1)), "nation", "people", 200)
    return R.stratified_sample(rows, "nation", sizes, F.col("c_custkey") * 48271 % 2147483647).select("nation", "c_custkey")


@query("""
    SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size,
           round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part
""")
def q39_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised sizes and prices."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return R.z_scores(rows, ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("""
    SELECT event_type, user_id % 3 AS bucket, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY event_type), 6)::DOUBLE AS percent
    FROM events GROUP BY 1, 2
""")
def q48_share_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each bucket of users within a type of event."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("bucket"))
    return R.shares(rows, "bucket", ["event_type"]).withColumn("percent", F.round("percent", 6))


@query("""
    SELECT user_id % 7 AS bucket, round(count(*) FILTER (event_type = 'click') * 100.0 / count(*), 6)::DOUBLE AS click,
           round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 6)::DOUBLE AS purchase, round(count(*) FILTER (event_type = 'view') * 100.0 / count(*), 6)::DOUBLE AS view
    FROM events GROUP BY 1
""")
def q49_pivot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events as columns, in percent of each bucket of users."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("bucket"), "event_type")
    kinds = ["click", "purchase", "view"]
    counts = rows.groupBy("bucket").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count()
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in ("click", "error", "purchase", "signup", "view")), F.lit(0))
    return counts.select("bucket", *[F.round(F.coalesce(F.col(k), F.lit(0)) * 100.0 / total, 6).alias(k) for k in kinds])


@query("SELECT p_brand, min(p_size) AS min_size, max(p_size) AS max_size, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part GROUP BY 1")
def q50_cluster_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of sizes and prices of each brand."""
    ends = [f(c).alias(f"{n}_{a}") for c, a in (("p_size", "size"), ("p_retailprice", "price")) for n, f in (("min", F.min), ("max", F.max))]
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*ends)


@query("""
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25
""")
def q51_topk_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 dearest lines: a report of the top k."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("""
    SELECT c_custkey AS id, c_name AS name, CAST(1 + c_custkey % 5 AS BIGINT) AS floors FROM customer
    UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier
""")
def q52_union_by_name_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of different columns as one, with a default for what one lacks."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (1 + F.col("c_custkey") % 5).alias("floors"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("floors", F.coalesce("floors", F.lit(1).cast("long")))


@query("""
    SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL
    SELECT * FROM (VALUES (24, 'again'), (25, 'first new'), (26, 'second new')) v(id, name) WHERE id NOT IN (SELECT n_nationkey FROM nation)
""")
def q53_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the rows of an inline table whose keys were free."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return R.insert_if_absent(rows, spark.createDataFrame([(24, "again"), (25, "first new"), (26, "second new")], "id int, name string"), ["id"])


@query("SELECT DISTINCT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def q54_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have no urgent order."""
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%")).select("o_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(urgent)


@query(f"""
    SELECT site, 'household ' || j AS name, CAST(CASE WHEN kind IN ('SFH', 'MFH', 'AB') THEN 30.0 ELSE round(peak, 6) END / 1000 AS DOUBLE) AS max_p_mw
    FROM (SELECT *, unnest(range(1, greatest(units, 1) + 1)) AS j FROM ({BUILDINGS_SQL}) b) e
""")
def q55_explode_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every household of a site."""
    from gridloom.operators.network import household_loads

    return household_loads(buildings(spark, sf_dir).withColumn("peak", F.round("peak", 6)), "site")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS again FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q59_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties decoded from JSON and encoded again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return rows.where("p.k IS NOT NULL").select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


@query(f"""
    SELECT nation, CAST(count(*) FILTER (kind IN ('SFH', 'MFH', 'AB')) AS BIGINT) AS residential, CAST(count(*) FILTER (kind = 'Commercial') AS BIGINT) AS commercial,
           CAST(coalesce(round(sum(peak) FILTER (kind = 'Public'), 6), 0) AS DOUBLE) AS public_kw FROM ({BUILDINGS_SQL}) b GROUP BY 1
""")
def q34_zone_conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by class of consumer, in one pass."""
    kind = F.col("kind")
    return buildings(spark, sf_dir).groupBy("nation").agg(
        F.count_if(kind.isin(*E.RESIDENTIAL_TYPES)).alias("residential"), F.count_if(kind == "Commercial").alias("commercial"), F.coalesce(F.round(F.sum(F.when(kind == "Public", F.col("peak"))), 6), F.lit(0.0)).alias("public_kw")
    )


@query("""
    SELECT l_returnflag AS std_type, round(sum(l_linenumber * l_quantity), 6) AS length FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
""")
def q33_length_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length times parallel number by type, of lines in service."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return rows.groupBy(F.col("l_returnflag").alias("std_type")).agg(F.round(F.sum(F.col("l_linenumber") * F.col("l_quantity")), 6).alias("length"))


@query("""
    SELECT o_orderpriority AS size, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS buses, round(max(o_totalprice), 6) AS most, round(avg(o_totalprice), 6) AS mean
    FROM orders GROUP BY 1
""")
def q32_capacity_summary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct members and extremes by size."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("size")).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("buses"), F.round(F.max("o_totalprice"), 6).alias("most"), F.round(F.avg("o_totalprice"), 6).alias("mean")
    )


@query(f"SELECT {KIND_SQL} AS kind, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def q61_value_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values replaced by a map."""
    return sites(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
