"""Queries of the clustering and network operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.functions import geometry as G
from gridloom.operators import cluster as C
from gridloom.operators import metrics as M
from gridloom.operators import network as N
from gridloom.operators import radial as P
from gridloom.operators import relational as R
from gridloom.operators import spatial as S
from gridloom.operators import transformers as T
from gridloom.plans.base import BUILDINGS_SQL, SITES_SQL, buildings, query, sites, table

_CABLES_SQL = ", ".join(f"('{n}', {r}, {x}, {i}, {q})" for n, r, x, i, q in E.STREET_CABLES)


@query(f"""
    WITH b AS ({BUILDINGS_SQL}), d AS (SELECT i.nation, i.site AS i, sum(sqrt(CAST((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) AS DOUBLE)) * j.peak) AS m FROM b i JOIN b j ON i.nation = j.nation GROUP BY 1, 2)
    SELECT nation, arg_min(i, (round(m, 3), i)) AS site, round(min(m), 3) AS moment FROM d GROUP BY 1
""")
def q24_weighted_one_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the site with the least load-weighted distance to all its sites."""
    b = buildings(spark, sf_dir).select("nation", F.col("site").alias("id"), "x", "y", F.col("peak").alias("load"))
    return C.weighted_median_point(b, "nation")


@query()
def q25_greedy_capacity_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites given to suppliers' transformers within reach until these are full."""
    b = buildings(spark, sf_dir).select("nation", F.col("site").alias("consumer"), "x", "y", "kind", F.col("peak").alias("power"), F.col("units").alias("count"))
    key = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(key.alias("transformer"), (key * 6007 % 10007).alias("tx"), (key * 3001 % 10009).alias("ty"))
    return C.assign_within_reach(b, t, "nation")


@query()
def q26_capacity_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of each nation, in areas of bounded size, in clusters that a transformer can serve."""
    b = buildings(spark, sf_dir).select("nation", F.col("site").alias("point"), "x", "y", "kind", F.col("peak").alias("power"), F.col("units").alias("count"))
    b = C.bounded_areas(b, "nation").select("area", "point", "x", "y", "kind", "power", "count")
    return C.bisect_by_capacity(b, "area")


@query(f"""
    WITH c(cable, r, x, i, q) AS (VALUES {_CABLES_SQL}),
    s AS (SELECT o_orderkey, (1 + o_orderkey % 17) * 0.04::DOUBLE AS ka, CAST(o_custkey % 60 AS DOUBLE) AS m FROM orders),
    o AS (SELECT o_orderkey, cable, q, CAST(greatest(ceil(ka / i - 1e-12), CASE WHEN m <> 0 THEN ceil(sqrt(r * r + x * x) / (400 * 0.045) * ka * m - 1e-12) ELSE 0 END, 1) AS INTEGER) AS n FROM s, c)
    SELECT o_orderkey, arg_min(cable, (n, q, cable)) AS cable, min(n) AS parallel FROM o GROUP BY 1
""")
def q27_cable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable and parallel number of a line for every order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 17 + 1) * F.lit(0.04)).alias("ka"), (F.col("o_custkey") % 60).cast("double").alias("m"))
    return N.choose_cable(rows, "o_orderkey", F.col("ka"), F.col("m")).select("o_orderkey", "cable", "parallel")


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'SFH' ELSE 'Public' END"


@query(f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, {_KIND} AS kind, l_quantity * 4 AS p, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS d FROM lineitem),
    n AS (SELECT * FROM r WHERE d = 1),
    s AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS nth,
            sum(CASE WHEN kind = 'SFH' THEN p ELSE 0 END) OVER w AS rp, sum(CASE WHEN kind = 'SFH' THEN 1 ELSE 0 END) OVER w AS rn,
            sum(CASE WHEN kind = 'Commercial' THEN p ELSE 0 END) OVER w AS cp, sum(CASE WHEN kind = 'Commercial' THEN 1 ELSE 0 END) OVER w AS cn,
            sum(CASE WHEN kind = 'Public' THEN p ELSE 0 END) OVER w AS pp, sum(CASE WHEN kind = 'Public' THEN 1 ELSE 0 END) OVER w AS pn
          FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, (CASE WHEN rn > 0 THEN rp * (0.07 + 0.93 * pow(rn, -0.75)) ELSE 0 END + CASE WHEN cn > 0 THEN cp * (0.5 + 0.5 * pow(cn, -0.75)) ELSE 0 END
            + CASE WHEN pn > 0 THEN pp * (0.6 + 0.4 * pow(pn, -0.75)) ELSE 0 END) / (400 * 0.95 * sqrt(3)) AS ka FROM s),
    f AS (SELECT l_orderkey, min(l_linenumber) AS cut FROM c WHERE ka >= 0.313 AND nth > 1 GROUP BY 1)
    SELECT c.l_orderkey, c.l_linenumber, round(ka, 6) AS current_ka, cut IS NULL OR c.l_linenumber < cut AS on_branch FROM c LEFT JOIN f USING (l_orderkey)
""")
def q28_branch_running_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running current along each order's lines, and where the branch ends."""
    n = F.col("l_linenumber") % 3
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select(columns).repartition("l_orderkey")  # one shuffle for both windows
    rows = R.keep_first(lines, columns[:2], columns[2:])
    rows = rows.select("l_orderkey", "l_linenumber", F.when(n == 0, "Commercial").when(n == 1, "SFH").otherwise("Public").alias("kind"), (F.col("l_quantity") * 4).alias("p"), F.lit(1).alias("one"))
    return N.branch_cut(rows, ["l_orderkey"], "l_linenumber", "kind", "p", "one").select("l_orderkey", "l_linenumber", F.round("current_ka", 6).alias("current_ka"), "on_branch")


@query()
def q63_lay_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeders of one network for each area of bounded size of a nation: its sites along a line of streets."""
    b = C.bounded_areas(buildings(spark, sf_dir).where("peak > 0"), "nation", 50)
    w = Window.partitionBy("area").orderBy("y", "site")
    nodes = b.select(
        "area", F.col("site").alias("node"), F.lag("site").over(w).alias("parent"), (F.col("y") / 1000).alias("distance"),
        F.array("kind").alias("kinds"), F.array(F.col("peak").cast("double")).alias("powers"), F.array(F.col("units").cast("double")).alias("counts"),
    )
    return N.lay_branches(nodes, "area")


#: Components of a vector of the table.
DIMENSIONS = 64
_E = [f"e{i}" for i in range(DIMENSIONS)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_E)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *columns)


@query()
def q40_kmeans_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row nearest to the centre of each of five clusters."""
    labelled, _ = C.k_means(R.z_scores(_vectors(spark, sf_dir), _E), _E, "vec_id", 5)
    return C.representatives(labelled, "vec_id", "label").select("cluster", "representative")


@query()
def q41_kmedoids_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five medoids, clusters renumbered by their label."""
    labelled, _ = C.k_medoids(R.z_scores(_vectors(spark, sf_dir), _E), _E, "vec_id", 5)
    return C.representatives(labelled, "vec_id", "label").select("cluster", "representative")


@query()
def q42_gmm_tied_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by a Gaussian mixture with one covariance."""
    return C.gaussian_mixture(R.z_scores(_vectors(spark, sf_dir), _E), _E, "vec_id", 4).select("vec_id", "cluster")


@query()
def q67_index_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both indices of six algorithms for three to seven clusters of the numbers of parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    columns = ["p_size", "p_retailprice"]
    return C.index_sweep(R.z_scores(rows, columns), columns, "p_partkey")


_MEANS = ", ".join(f"avg(e{i}) AS m{i}" for i in range(DIMENSIONS))
_ROWS = "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIMENSIONS)) + " FROM embeddings"
_SQUARES = lambda a, b: " + ".join(f"({a}{i} - {b}{i}) ** 2" for i in range(DIMENSIONS))


@query(f"""
    WITH v AS ({_ROWS}), c AS (SELECT label, count(*) AS n, {_MEANS} FROM v GROUP BY 1), g AS (SELECT {_MEANS} FROM v),
    w AS (SELECT sum({_SQUARES("e", "m")}) AS w FROM v JOIN c USING (label)),
    b AS (SELECT sum(n * ({_SQUARES("c.m", "g.m")})) AS b, count(*) AS k, sum(n) AS n FROM c, g)
    SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 6) AS ch FROM w, b
""")
def q43_ch_index_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calinski-Harabasz index of the labels."""
    return M.calinski_harabasz(_vectors(spark, sf_dir), _E, "label").select("k", "n", F.round("ch", 6).alias("ch"))


@query(f"""
    WITH v AS ({_ROWS}), c AS (SELECT label, {_MEANS} FROM v GROUP BY 1),
    s AS (SELECT label, avg(sqrt({_SQUARES("e", "m")})) AS s FROM v JOIN c USING (label) GROUP BY 1), a AS (SELECT * FROM c JOIN s USING (label)),
    r AS (SELECT a.label, max((a.s + b.s) / sqrt({_SQUARES("a.m", "b.m")})) AS r FROM a JOIN a b ON a.label <> b.label GROUP BY 1)
    SELECT round(avg(r), 6) AS db FROM r
""")
def q44_db_index_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Davies-Bouldin index of the labels."""
    return M.davies_bouldin(_vectors(spark, sf_dir), _E, "label").select(F.round("db", 6).alias("db"))


@query("""
    WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
    x AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM t), l AS (SELECT sum(n * (n - 1) / 2) AS l FROM (SELECT sum(n) AS n FROM t GROUP BY a) q),
    r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY b) q)
    SELECT round((i - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2)), 6) AS ari FROM x, l, r
""")
def q45_adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index of two labelings of lines."""
    return M.adjusted_rand(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("ari", 6).alias("ari"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
def q46_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r of all pairs of measures."""
    return M.correlations(table(spark, sf_dir, "lineitem"), _NUMBERS).select("a", "b", F.round("r", 6).alias("r"))


@query()
def q47_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of the principal components."""
    return spark.createDataFrame(M.explained_variance(table(spark, sf_dir, "lineitem"), _NUMBERS), "component int, share double, cumulative double")


@query()
def q64_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each factor above an eigenvalue of 1 the column that loads most."""
    found = M.factors(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return spark.createDataFrame(found, "factor int, column string, loading double")


@query("""
    WITH m AS (SELECT p_brand, p_size AS s, p_retailprice AS r, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part WHERE p_size > 0)
    SELECT p.p_brand, round((sqrt(avg(((p_size - s) / s) ** 2)) + sqrt(avg(((p_retailprice - r) / r) ** 2))) / 2, 6) AS deviation
    FROM part p JOIN m ON p.p_brand = m.p_brand AND nth = 1 GROUP BY 1
""")
def q57_deviation_from_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative deviation of each brand's parts from its first part."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    first = R.keep_first(rows.where("p_size > 0"), ["p_brand"], ["p_partkey"])
    return M.deviation_from(rows, first, "p_brand", ["p_size", "p_retailprice"]).select("p_brand", F.round("deviation", 6).alias("deviation"))


@query("""
    WITH m AS (SELECT p_brand, p_size AS s, p_retailprice AS r, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part WHERE p_size > 0),
    d AS (SELECT p.p_brand, (sqrt(avg(((p_size - s) / s) ** 2)) + sqrt(avg(((p_retailprice - r) / r) ** 2))) / 2 AS deviation FROM part p JOIN m ON p.p_brand = m.p_brand AND nth = 1 GROUP BY 1)
    SELECT count(*) AS clusters, round(avg(deviation), 6) AS deviation FROM d
""")
def q90_mean_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation of brands from their first part, averaged over brands."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    first = R.keep_first(rows.where("p_size > 0"), ["p_brand"], ["p_partkey"])
    return M.mean_deviation(rows, first, "p_brand", ["p_size", "p_retailprice"]).select("clusters", F.round("deviation", 6).alias("deviation"))


_THREE = ["l_quantity", "l_extendedprice", "l_discount"]
_THREE_SQL = "SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c, count(*) AS n FROM lineitem"


@query(f"""
    WITH r AS ({_THREE_SQL}), p AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det, (a - b * c) ** 2 / ((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) ** 2 / ((1 - a * a) * (1 - c * c)) AS pb, (c - a * b) ** 2 / ((1 - a * a) * (1 - b * b)) AS pc FROM r)
    SELECT round(-(n - 1 - 11.0 / 6) * ln(det), 3) AS bartlett, round((a * a + b * b + c * c) / (a * a + b * b + c * c + pa + pb + pc), 6) AS kmo FROM p
""")
def q91_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether three measures of lines suit a factor analysis: Bartlett's statistic and the Kaiser-Meyer-Olkin measure."""
    bartlett, kmo = M.adequacy(table(spark, sf_dir, "lineitem"), _THREE)
    return spark.createDataFrame([(round(bartlett, 3), round(kmo, 6))], "bartlett double, kmo double")


@query(f"""
    WITH r AS ({_THREE_SQL}), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM r), f AS (SELECT p, acos(least(1, greatest(-1, a * b * c / p ** 3))) / 3 AS f FROM p),
    e AS (SELECT 1 + 2 * p * cos(f) AS e1, 1 - 2 * p * cos(pi() / 3 - f) AS e3 FROM f),
    s AS (SELECT 1 AS component, e1 / 3 AS s FROM e UNION ALL SELECT 2, (3 - e1 - e3) / 3 FROM e UNION ALL SELECT 3, e3 / 3 FROM e)
    SELECT component, round(s, 6) AS share, round(sum(s) OVER (ORDER BY component), 6) AS cumulative FROM s
""")
def q92_explained_variance_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of the principal components of three measures, whose eigenvalues SQL has in closed form."""
    found = [(i, round(s, 6), round(c, 6)) for i, s, c in M.explained_variance(table(spark, sf_dir, "lineitem"), _THREE)]
    return spark.createDataFrame(found, "component int, share double, cumulative double")


@query(f"""
    SELECT site, CAST(CASE WHEN peak < 100 THEN 100 WHEN peak < 160 THEN 160 WHEN peak < 250 THEN 250 WHEN peak < 400 THEN 400 END AS INTEGER) AS single,
           CAST(CASE WHEN peak * 1.15 < 500 THEN 500 WHEN peak * 1.15 < 800 THEN 800 END AS INTEGER) AS double
    FROM ({BUILDINGS_SQL}) b
""")
def q65_transformer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single and twin transformer sizes for every site's peak."""
    peak = F.col("peak")
    doubles = F.array(*[F.lit(2 * c) for c in E.SYNTHESISED_CAPACITIES[2:4]])
    return buildings(spark, sf_dir).select("site", E.next_capacity(peak).alias("single"), F.array_min(F.filter(doubles, lambda c: c > peak * 1.15)).alias("double"))


@query(f"""
    WITH s AS ({SITES_SQL})
    SELECT DISTINCT nation AS grid, 'LV' AS bus, 'lv' AS kind, CAST(NULL AS VARCHAR) AS zone, 0.4::DOUBLE AS vn_kv FROM s
    UNION ALL SELECT DISTINCT nation, 'MV', 'mv', NULL, 20.0::DOUBLE FROM s
    UNION ALL SELECT nation, 'Connection Nodebus ' || site, 'connection', NULL, 0.4::DOUBLE FROM s WHERE site % 5 = 0
    UNION ALL SELECT nation, 'Consumer Nodebus ' || site, 'consumer', kind, 0.4::DOUBLE FROM s
""")
def q66_buses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buses of one network per nation."""
    s = sites(spark, sf_dir)
    grids = s.select(F.col("nation").alias("grid")).distinct()
    points = s.select(F.col("nation").alias("grid"), F.col("site").alias("vertex"), "kind")
    return N.buses(grids, points.where("vertex % 5 = 0"), points)



_HOUSE_SQL = ", ".join(f"('{n}', {r}, {x}, {i}, {q})" for n, r, x, i, q in E.HOUSE_CABLES)


@query(f"""
    WITH c(cable, r, x, i, q) AS (VALUES {_HOUSE_SQL}),
    b AS (SELECT site, CAST(1 + site % 60 AS DOUBLE) AS m, CASE WHEN units = 0 THEN 0 ELSE CAST(peak AS DOUBLE) * (g + (1 - g) * pow(units, -0.75)) END AS load
          FROM (SELECT *, CASE kind WHEN 'Commercial' THEN 0.5 WHEN 'Public' THEN 0.6 ELSE 0.07 END::DOUBLE AS g FROM ({BUILDINGS_SQL}) b) k),
    l AS (SELECT *, load / (400 * 0.95 * sqrt(3)) AS ka, CASE WHEN load <= 100 THEN 2.0 ELSE 4.0 END::DOUBLE AS volts FROM b),
    o AS (SELECT site, load, cable, q, CAST(greatest(ceil(ka / i - 1e-12), ceil(sqrt(r * r + x * x) / volts * ka * m - 1e-12), 1) AS INTEGER) AS n FROM l, c)
    SELECT site, round(min(load), 6) AS load, arg_min(cable, (n, q, cable)) AS cable, min(n) AS parallel FROM o GROUP BY 1
""")
def q68_house_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable and parallel number of the connection of every site."""
    rows = buildings(spark, sf_dir).select("site", "kind", "peak", "units", (1 + F.col("site") % 60).cast("double").alias("m"))
    return N.house_connections(rows, "site", "kind", "peak", "units", "m").select("site", F.round("load", 6).alias("load"), "cable", "parallel")


@query("""
    WITH p AS (SELECT 'way/' || s_suppkey AS id, CAST(s_suppkey AS BIGINT) AS nth, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN '20000' WHEN 3 THEN '110000' ELSE '400' END AS voltage,
          CAST((s_suppkey * 37) % 211 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 199 AS DOUBLE) AS y FROM supplier),
    a AS (SELECT 'node/' || n_nationkey AS id, CAST(1000000 + n_nationkey AS BIGINT) AS nth, 8.0 * n_nationkey + 0.5 AS x0, 7.0 * n_nationkey + 0.5 AS y0, 5.0 + n_nationkey % 5 AS s FROM nation),
    m AS (SELECT 40.0 * r_regionkey + 0.25 AS x0, 20.25 AS y0, 12.0 AS s FROM region),
    r AS (SELECT id, nth, x, y, voltage, 0.0 AS m2 FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE p.x > x0 AND p.x < x0 + s AND p.y > y0 AND p.y < y0 + s)
          UNION ALL SELECT id, nth, x0 + s / 2, y0 + s / 2, NULL, s * s FROM a),
    k AS (SELECT * FROM r WHERE m2 < 60 AND coalesce(coalesce(try_cast(coalesce(voltage, '1') AS DOUBLE), 0) < 110000, true)),
    u AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.nth > k.nth AND (b.x - k.x) * (b.x - k.x) + (b.y - k.y) * (b.y - k.y) < 64))
    SELECT regexp_replace(id, '^[waynode/]+', '') || CASE WHEN nth >= 1000000 THEN 'a' ELSE 'p' END AS osm_id, CAST(round(x, 6) AS DOUBLE) AS x, CAST(round(y, 6) AS DOUBLE) AS y FROM u
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE u.x > x0 AND u.x < x0 + s AND u.y > y0 AND u.y < y0 + s)
""")
def q69_clean_transformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for transformers, as points and footprints, of which those that are none are dropped."""
    key = F.col("s_suppkey")
    square = lambda x, y, s: F.array(G.point(x, y), G.point(x + s, y), G.point(x + s, y + s), G.point(x, y + s))
    voltage = F.when(key % 5 == 1, "unknown").when(key % 5 == 2, "20000").when(key % 5 == 3, "110000").when(key % 5 == 4, "400")
    points = table(spark, sf_dir, "supplier").select(F.concat(F.lit("way/"), key).alias("id"), key.cast("long").alias("nth"), voltage.alias("voltage"), F.array(G.point(key * 37 % 211, key * 53 % 199)).alias("ring"))
    n = F.col("n_nationkey")
    areas = table(spark, sf_dir, "nation").select(F.concat(F.lit("node/"), n).alias("id"), (n + 1_000_000).cast("long").alias("nth"), F.lit(None).cast("string").alias("voltage"), square(n * 8 + 0.5, n * 7 + 0.5, n % 5 + 5.0).alias("ring"))
    malls = table(spark, sf_dir, "region").select(square(F.col("r_regionkey") * 40 + 0.25, F.lit(20.25), F.lit(12.0)).alias("ring"))
    out = T.clean_candidates(points.unionByName(areas), malls)
    kind = F.when(F.col("id").startswith("node"), "a").otherwise("p")
    return out.select(F.concat(T.map_id(F.col("id")), kind).alias("osm_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""
    WITH s AS (SELECT b.*, n_regionkey AS grid, CAST(CASE WHEN kind IN ('SFH', 'MFH', 'AB') THEN 'Residential' ELSE kind END AS VARCHAR) AS class, CAST(peak AS DOUBLE) / 1000 AS p, CAST(1 + n_nationkey % 7 AS DOUBLE) / 10 AS ln, CAST(1 + site % 13 AS DOUBLE) / 100 AS lc
               FROM ({BUILDINGS_SQL}) b JOIN nation ON nation = n_nationkey WHERE peak > 0),
    c AS (SELECT grid, nation, class, sum(p) AS p, sum(units) AS n, CASE class WHEN 'Commercial' THEN 0.5 WHEN 'Public' THEN 0.6 ELSE 0.07 END::DOUBLE AS g FROM s GROUP BY 1, 2, 3),
    f AS (SELECT grid, nation, sum(p * (g + (1 - g) * pow(n, -0.75))) / sum(p) AS factor FROM c GROUP BY 1, 2),
    o AS (SELECT s.*, CASE class WHEN 'Commercial' THEN 0.5 WHEN 'Public' THEN 0.6 ELSE 0.07 END::DOUBLE AS g FROM s),
    v AS (SELECT o.grid, o.nation, sum(p * 1000 / 30) AS h, sum(p * 1000 / 30 * (ln * 0.2 * factor + lc * 0.5 * (g + (1 - g) * pow(units, -0.75)))) AS r, sum(p * 1000 / 30 * (ln + lc) * 0.08) AS x FROM o JOIN f ON o.grid = f.grid AND o.nation = f.nation GROUP BY 1, 2),
    t AS (SELECT grid, max(h) AS most, sum(r) AS r, sum(x) AS x, max(r) AS worst, count(*) AS branches FROM v GROUP BY 1),
    k AS (SELECT grid, count(*) AS houses, max(ln + lc) AS far, avg(ln + lc) AS mean, sum(lc) AS leaves, sum(units) AS households, sum(p) AS mw FROM s GROUP BY 1),
    b AS (SELECT grid, sum(ln) AS trunk FROM (SELECT DISTINCT grid, nation, ln FROM s) d GROUP BY 1)
    SELECT CAST(grid AS INTEGER) AS grid, CAST(branches AS BIGINT) AS no_branches, CAST(houses AS BIGINT) AS no_house_connections, CAST(branches AS BIGINT) AS no_connection_buses, CAST(households AS BIGINT) AS no_households, round(most, 4) AS max_no_of_households_of_a_branch,
           round(mw, 6) AS max_power_mw, round(leaves + trunk, 6) AS cable_length_km, round(far, 6) AS max_trafo_dis, round(mean, 6) AS avg_trafo_dis, round(r, 4) AS resistance, round(x, 4) AS reactance, round(r / x, 6) AS ratio, round(worst, 4) AS max_vsw_of_a_branch
    FROM t JOIN k USING (grid) JOIN b USING (grid)
""")
def q70_grid_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification parameters of one network a region: its nations as branches, their sites as houses."""
    of = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("grid"))
    s = buildings(spark, sf_dir).where("peak > 0").join(of, "nation")
    trunk = s.select("grid", F.lit("root").alias("parent"), F.concat(F.lit("n"), "nation").alias("child"), ((1 + F.col("nation") % 7).cast("double") / 10).alias("length_km"), F.lit(0.2).alias("r")).distinct()
    house = F.concat(F.lit("c"), "site")
    leaves = s.select("grid", F.concat(F.lit("n"), "nation").alias("parent"), house.alias("child"), ((1 + F.col("site") % 13).cast("double") / 100).alias("length_km"), F.lit(0.5).alias("r"))
    lines = trunk.unionByName(leaves).withColumns({"x": F.lit(0.08), "parallel": F.lit(1)})
    loads = s.select("grid", house.alias("vertex"), "kind", (F.col("peak").cast("double") / 1000).alias("max_p_mw"), F.col("units").cast("long").alias("n"))
    out = P.grid_parameters(lines, loads, "root")
    rounded = {"max_no_of_households_of_a_branch": 4, "max_power_mw": 6, "cable_length_km": 6, "max_trafo_dis": 6, "avg_trafo_dis": 6, "resistance": 4, "reactance": 4, "ratio": 6, "max_vsw_of_a_branch": 4}
    return out.select("grid", "no_branches", "no_house_connections", "no_connection_buses", "no_households", *[F.round(c, n).alias(c) for c, n in rounded.items()])
