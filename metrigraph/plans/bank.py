"""The query bank: operators bound to the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrigraph.functions import scalars as S
from metrigraph.functions.similarity import jaro_winkler, jaro_winkler_most
from metrigraph.operators import demand, ledger, quality, relational, scoring

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def money(c: str):
    """Exact sums: prices have two decimals."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def as_of() -> Column:
    """Past all events."""
    return F.lit("2024-02-01").cast("date")


def late() -> Column:
    """Past all orders."""
    return F.lit("2001-09-01").cast("date")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the estate: users' events by type; the type is the tool."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool"), F.col("user_id").alias("report")).agg(F.count("*").alias("runs"), F.count_distinct(F.to_date("ts")).alias("users"), F.max(F.to_date("ts")).alias("last"))


REPORTS = "reports AS (SELECT event_type AS tool, user_id AS report, count(*) AS runs, count(DISTINCT ts::DATE) AS users, max(ts::DATE) AS last FROM events GROUP BY ALL)"
PCT = "pct AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY runs, report)::DOUBLE / count(*) OVER (PARTITION BY tool) AS p FROM reports)"
EVEN = "CASE WHEN (p * (n - 1)) - floor(p * (n - 1)) = 0.5 THEN floor(p * (n - 1)) + (floor(p * (n - 1))::BIGINT % 2) ELSE round(p * (n - 1)) END::BIGINT"
PARITY = f"pool AS (SELECT greatest(runs, 0) AS v, row_number() OVER (ORDER BY greatest(runs, 0)) - 1 AS i FROM reports), parity AS (SELECT x.*, pool.v AS parity_runs FROM (SELECT *, {EVEN} AS i FROM (SELECT *, count(*) OVER () AS n FROM pct)) x JOIN pool USING (i))"


def _demand(spark: SparkSession, d: str) -> DataFrame:
    p = demand.quantile_parity(demand.within_percentile(reports(spark, d), "tool", "runs", "report"), "percentile", "runs", "report")
    w = demand.usage_weight(F.col("parity_runs"), F.col("users"), F.col("last"), as_of())
    return p.select("tool", "report", "runs", "users", _r("percentile").alias("percentile"), "parity_runs", _r(w).alias("weight"))


_DEMAND = f"WITH {REPORTS}, {PCT}, {PARITY} SELECT tool, report, runs, users, round(p, 6) AS percentile, parity_runs, round(ln(1 + parity_runs) * greatest(1, users) * power(0.5, greatest(0, date_diff('day', last, DATE '2024-02-01') / 30.44) / 6.0), 6) AS weight FROM parity"


@query(_DEMAND)
def usage_demand(spark, d):
    return _demand(spark, d)


def top_demand(spark: SparkSession, d: str) -> DataFrame:
    return _demand(spark, d).orderBy(F.col("weight").desc(), "tool", "report").limit(20)


@query(f"SELECT * FROM ({_DEMAND}) ORDER BY weight DESC, tool, report LIMIT 20")
def top_reports(spark, d):
    return top_demand(spark, d)


@query(f"WITH {REPORTS}, {PCT} SELECT tool, report, round(p, 6) AS percentile FROM pct")
def within_tool_percentile(spark, d):
    return demand.within_percentile(reports(spark, d), "tool", "runs", "report").select("tool", "report", _r("percentile").alias("percentile"))


@query(f"WITH {REPORTS}, {PCT}, {PARITY} SELECT tool, report, parity_runs FROM parity")
def quantile_parity(spark, d):
    return demand.quantile_parity(demand.within_percentile(reports(spark, d), "tool", "runs", "report"), "percentile", "runs", "report").select("tool", "report", "parity_runs")


def _last_order(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"), F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")), F.col("c_custkey") == F.col("o_custkey"), "left")


LAST = "l AS (SELECT c_custkey, last, n, urgent FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate::DATE) AS last, count(*) AS n, count_if(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON c_custkey = o_custkey)"
MONTHS = "coalesce(greatest(0, date_diff('day', last, DATE '2001-09-01') / 30.44), 24)"


@query(f"WITH {LAST} SELECT c_custkey, round({MONTHS}, 6) AS months, round(power(0.5, {MONTHS} / 6.0), 6) AS decay FROM l")
def recency_decay(spark, d):
    c = _last_order(spark, d)
    return c.select("c_custkey", _r(S.months_since(F.col("last"), late())).alias("months"), _r(S.recency_decay(F.col("last"), late())).alias("decay"))


@query(f"WITH {LAST}, b AS (SELECT c_custkey, ln(1 + coalesce(n, 0)) AS base, coalesce(urgent, 0) > 0 AS critical, power(0.5, {MONTHS} / 6.0) AS f FROM l) SELECT c_custkey, round(CASE WHEN critical THEN greatest(base * f, 0.6 * base) ELSE base * f END, 6) AS weight FROM b")
def decision_critical_floor(spark, d):
    c = _last_order(spark, d).na.fill(0, ["n", "urgent"])
    return c.select("c_custkey", _r(demand.usage_weight(F.col("n"), F.lit(1), F.col("last"), late(), F.col("urgent") > 0)).alias("weight"))


@query("WITH v AS (SELECT l_partkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT l_partkey, s_nationkey AS winner, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, s_nationkey) = 1")
def majority_vote(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return relational.majority(rows, ["l_partkey"], "s_nationkey")


@query("WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS mode, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1")
def modal_first_seen(spark, d):
    return relational.modal_first_seen(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT l_partkey, count(*) AS column_count, count(DISTINCT l_suppkey) AS suppliers, count_if(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'F') AS any_final, min(l_shipdate::DATE) AS first_ship FROM lineitem GROUP BY 1")
def catalog_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("column_count"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "F").alias("any_final"), F.min(F.to_date("l_shipdate")).alias("first_ship"))


@query("WITH j AS (SELECT c_mktsegment AS bu, o_custkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT bu, o_orderpriority, count(*) AS n FROM j GROUP BY bu, o_orderpriority), m AS (SELECT bu, o_orderpriority FROM k QUALIFY row_number() OVER (PARTITION BY bu ORDER BY n DESC, o_orderpriority) = 1) SELECT j.bu, count(DISTINCT o_custkey) AS users, count(*) AS reports, round(avg((j.o_orderpriority = '1-URGENT')::INT), 6) AS scheduled_share, any_value(m.o_orderpriority) AS cadence FROM j JOIN m USING (bu) GROUP BY j.bu")
def consumers_rollup(spark, d):
    j = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("bu")), F.col("o_custkey") == F.col("c_custkey"))
    mode = relational.majority(j, ["bu"], "o_orderpriority", "cadence").drop("votes")
    return j.groupBy("bu").agg(F.count_distinct("o_custkey").alias("users"), F.count("*").alias("reports"), _r(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int"))).alias("scheduled_share")).join(mode, "bu").select("bu", "users", "reports", "scheduled_share", "cadence")


@query("WITH f AS (SELECT l_orderkey, sha256(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand)) AS fp FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT fp, count(*) AS members, min(l_orderkey) AS head FROM f GROUP BY fp")
def fingerprint_group(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    f = j.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("p_brand")), "|"), 256).alias("fp"))
    return f.groupBy("fp").agg(F.count("*").alias("members"), F.min("l_orderkey").alias("head"))


@query("WITH v AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_type, p_brand AS dominant FROM v QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) = 1), c AS (SELECT p_type, count(*) - 1 AS variant_count FROM v GROUP BY 1) SELECT v.p_type, v.p_brand, v.n, CASE WHEN v.p_brand = m.dominant THEN 'IDENTICAL' ELSE 'VARIANT' END AS tier, c.variant_count FROM v JOIN m USING (p_type) JOIN c USING (p_type)")
def variant_tiers(spark, d):
    p = table(spark, d, "part")
    v = p.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    m = relational.majority(p, ["p_type"], "p_brand", "dominant").drop("votes")
    c = v.groupBy("p_type").agg((F.count("*") - 1).alias("variant_count"))
    return v.join(m, "p_type").join(c, "p_type").select("p_type", "p_brand", "n", F.when(F.col("p_brand") == F.col("dominant"), "IDENTICAL").otherwise("VARIANT").alias("tier"), "variant_count")


@query("WITH g AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT a.p_name, a.p_type AS type_a, b.p_type AS type_b, a.n * b.n AS pairs FROM g a JOIN g b ON a.p_name = b.p_name AND a.p_type < b.p_type")
def cousins(spark, d):
    g = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.count("*").alias("n"))
    a, b = g.select("p_name", F.col("p_type").alias("type_a"), F.col("n").alias("na")), g.select("p_name", F.col("p_type").alias("type_b"), F.col("n").alias("nb"))
    return a.join(b, "p_name").where("type_a < type_b").select("p_name", "type_a", "type_b", (F.col("na") * F.col("nb")).alias("pairs"))


BLOCKS = "n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), t AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS block FROM n), pairs AS (SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared_blocks FROM t a JOIN t b ON a.block = b.block AND a.p_name < b.p_name GROUP BY ALL)"


def _conflicts(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return relational.conflicts(names.withColumn("blocks", F.split("p_name", " ")), "p_name", "blocks", "p_name")


@query(f"WITH {BLOCKS} SELECT * FROM pairs")
def conflict_blocking(spark, d):
    return _conflicts(spark, d)


@query(f"WITH {BLOCKS} SELECT string_split(a, ' ')[1] AS label, count(*) AS conflicts, count(DISTINCT b) AS competing, max(shared_blocks) AS most FROM pairs GROUP BY 1")
def conflict_heat_map(spark, d):
    return _conflicts(spark, d).groupBy(F.split("a", " ")[0].alias("label")).agg(F.count("*").alias("conflicts"), F.count_distinct("b").alias("competing"), F.max("shared_blocks").alias("most"))


JW = "j + least(4, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END) * 0.1 * (1 - j)"


@query(f"WITH {BLOCKS}, s AS (SELECT a, b, jaro_similarity(a, b) AS j FROM pairs) SELECT a, b, round({JW}, 6) AS similarity FROM s WHERE {JW} >= 0.9")
def label_similarity_pairs(spark, d):
    a, b = F.col("a"), F.col("b")
    pairs = _conflicts(spark, d).where(jaro_winkler_most(a, b) >= 0.9)  # lengths and first letters tell most pairs apart
    return pairs.select("a", "b", jaro_winkler(a, b).alias("s")).where("s >= 0.9").select("a", "b", _r("s").alias("similarity"))


def _sql_map() -> str:
    return "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in S.ABBREVIATIONS.items()) + " ELSE w END"


_TOKENS = "t AS (SELECT p_name, list_filter(list_transform(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: " + _sql_map() + "), lambda w: w NOT IN ('the', 'of', 'a', 'an', 'and', 'for', 'to', 'in', 'by')) AS words FROM (SELECT DISTINCT p_name FROM part))"


@query(f"WITH {_TOKENS} SELECT p_name, array_to_string(list_sort(words), ' ') AS token_key, CASE WHEN len(words) = 0 THEN 'unnamed' ELSE array_to_string(words, '_') END AS snake FROM t")
def token_key(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", S.token_key(F.col("p_name")).alias("token_key"), S.snake_case(F.col("p_name")).alias("snake"))


@query("SELECT c_custkey, 'CU-' || upper(substr(sha256(c_name || '|' || coalesce(c_mktsegment, '')), 1, 10)) AS id FROM customer")
def stable_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.stable_id("CU", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


EDGES = "e AS (SELECT DISTINCT o_custkey AS n, p_brand AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"


def _purchases(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_suppkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))


@query("WITH e AS (SELECT DISTINCT p_brand AS n, s_nationkey AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT n, count(*) AS s FROM e GROUP BY 1), b AS (SELECT x.n AS a, y.n AS b, count(*) AS shared FROM e x JOIN e y ON x.v = y.v AND x.n < y.n GROUP BY ALL) SELECT a, b, shared, round(shared / (p.s + q.s - shared), 6) AS jaccard FROM b JOIN s p ON a = p.n JOIN s q ON b = q.n WHERE shared / (p.s + q.s - shared) >= 0.25")
def table_jaccard_projection(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = _purchases(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return relational.projection(e, "p_brand", "s_nationkey", 0.25).select("a", "b", "shared", _r("jaccard").alias("jaccard"))


@query("SELECT p_partkey, count(DISTINCT c_nationkey) AS communities FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 3")
def hub_tables(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return _purchases(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("p_partkey").agg(F.count_distinct("c_nationkey").alias("communities")).where("communities >= 3")


@query("WITH x AS (SELECT DISTINCT o_orderkey, l_partkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), t AS (SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM x GROUP BY 1) SELECT o_orderkey, p_brand, count(*) AS inside, round(count(*) / any_value(n), 6) AS coverage FROM x JOIN t USING (o_orderkey) GROUP BY ALL")
def coverage_ratio(spark, d):
    return _coverage(spark, d).select("o_orderkey", "p_brand", "inside", _r("coverage").alias("coverage"))


def _coverage(spark, d):
    x = _purchases(spark, d).select("o_orderkey", "l_partkey", "p_brand").distinct()
    t = x.groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return x.groupBy("o_orderkey", "p_brand").agg(F.count("*").alias("inside")).join(t, "o_orderkey").withColumn("coverage", F.col("inside") / F.col("n"))


@query("WITH x AS (SELECT DISTINCT o_orderkey, l_partkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), c AS (SELECT o_orderkey, p_brand, count(*) AS inside FROM x GROUP BY ALL) SELECT o_orderkey, p_brand FROM c QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY inside DESC, p_brand) = 1")
def attribute_once(spark, d):
    return relational.attribute_once(_coverage(spark, d), "o_orderkey", "p_brand", "inside")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) = count_if(p_size <= 49 OR l_quantity < 50)")
def relational_division(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return relational.division(j, "l_suppkey", (F.col("p_size") <= 49) | (F.col("l_quantity") < 50))


_BRANDS = "b AS (SELECT p_brand, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(DISTINCT l_orderkey) AS orders, count(DISTINCT s_nationkey) AS nations, count(DISTINCT l_partkey) AS parts, count_if(l_returnflag = 'R') AS returned, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


def _brands(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    j = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand").agg(money("l_extendedprice").alias("revenue"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("s_nationkey").alias("nations"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("lines"))


@query(f"WITH {_BRANDS}, r AS (SELECT p_brand, row_number() OVER (ORDER BY revenue DESC, p_brand) AS rank FROM b), m AS (SELECT DISTINCT p_brand, o_custkey AS metric FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), w AS (SELECT o_custkey AS metric, count(*) AS w FROM orders GROUP BY 1), f AS (SELECT metric, min(rank) AS rank FROM m JOIN r USING (p_brand) GROUP BY 1), a AS (SELECT rank, sum(w)::BIGINT AS added FROM f JOIN w USING (metric) GROUP BY 1) SELECT p_brand, r.rank, coalesce(added, 0)::BIGINT AS added, (sum(coalesce(added, 0)) OVER (ORDER BY r.rank))::BIGINT AS cumulative FROM r LEFT JOIN a USING (rank)")
def coverage_curve(spark, d):
    return _curve(spark, d)


def _curve(spark, d):
    ranks = scoring.rank_by(_brands(spark, d), F.col("revenue"), "p_brand").select("p_brand", F.col("rank"))
    weight = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("metric")).agg(F.count("*").alias("w"))
    members = _purchases(spark, d).select("p_brand", F.col("o_custkey").alias("metric")).distinct().join(weight, "metric")
    return relational.coverage_curve(members, ranks, "p_brand", "metric", "w")


@query(f"WITH {_BRANDS}, t AS (SELECT p_brand FROM b ORDER BY revenue DESC, p_brand LIMIT 20) SELECT count(DISTINCT o_custkey) AS covered, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM t)")
def topn_coverage(spark, d):
    top = scoring.rank_by(_brands(spark, d), F.col("revenue"), "p_brand").where("rank <= 20").select("p_brand")
    covered = _purchases(spark, d).join(top, "p_brand", "left_semi").agg(F.count_distinct("o_custkey").alias("covered"))
    return covered.crossJoin(table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers")))  # one row each


def _ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN least(1.0, ln(1 + {x}) / ln(1 + max({x}) OVER ())) ELSE 0.0 END)"


_SCORES = f"{_BRANDS}, s AS (SELECT *, {_ln('revenue')} AS revenue_n, {_ln('orders')} AS orders_n, {_ln('nations')} AS nations_n, {_ln('returned')} AS returned_n FROM b)"


def _scores(spark, d):
    return scoring.run_relative(_brands(spark, d), ["revenue", "orders", "nations", "returned"])


@query(f"WITH {_SCORES} SELECT p_brand, round(revenue_n, 6) AS revenue_n, round(orders_n, 6) AS orders_n, round(nations_n, 6) AS nations_n FROM s")
def log_ratio_features(spark, d):
    return _scores(spark, d).select("p_brand", *[_r(f"{c}_n").alias(f"{c}_n") for c in ("revenue", "orders", "nations")])


_COMP = "100 * (0.35 * revenue_n + 0.30 * orders_n + 0.25 * nations_n - 0.10 * returned_n)"


def _composite():
    return scoring.composite({"demand": F.col("revenue_n"), "consolidation": F.col("orders_n"), "feasibility": F.col("nations_n"), "risk": F.col("returned_n")})


@query(f"WITH {_SCORES} SELECT p_brand, nations >= 10 AS g1, returned / lines <= 0.34 AS g2, parts >= 70 AS g4, CASE WHEN NOT parts >= 70 THEN 'Blocked' WHEN NOT (nations >= 10 AND returned / lines <= 0.34) THEN 'Exploratory' ELSE 'Proposed' END AS status, CASE WHEN {_COMP} >= 75 THEN 'Strong' WHEN {_COMP} >= 60 THEN 'Good' WHEN {_COMP} >= 45 THEN 'Moderate' ELSE 'Weak' END AS band, round({_COMP}, 6) AS composite FROM s")
def gates_status(spark, d):
    g1, g2, g4 = F.col("nations") >= 10, F.col("returned") / F.col("lines") <= 0.34, F.col("parts") >= 70
    return _scores(spark, d).select("p_brand", g1.alias("g1"), g2.alias("g2"), g4.alias("g4"), scoring.status(g4, g1, g2).alias("status"), S.composite_band(_composite()).alias("band"), _r(_composite()).alias("composite"))


@query(f"WITH {_SCORES} SELECT p_brand, CASE WHEN returned_n >= 0.999 THEN 'Event Stream' WHEN revenue_n >= 0.998 THEN 'Metric' WHEN orders_n >= 0.99 THEN 'Entity Master' ELSE 'Insight' END AS archetype FROM s")
def archetype_rules(spark, d):
    return _scores(spark, d).select("p_brand", scoring.first_rule([("Event Stream", F.col("returned_n"), 0.999), ("Metric", F.col("revenue_n"), 0.998), ("Entity Master", F.col("orders_n"), 0.99)], "Insight").alias("archetype"))


_VECTORS = [(f"{name}{sign}", [w * (1 + (0.2 if sign == "+" else -0.2) * (k == i)) for k, w in enumerate(scoring.DIMENSIONS.values())]) for i, name in enumerate(scoring.DIMENSIONS) for sign in "+-"]
_VSQL = "v(vector, w0, w1, w2, w3) AS (VALUES " + ", ".join(f"('{n}', {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE, {w[3]!r}::DOUBLE)" for n, w in _VECTORS) + ")"


@query(f"WITH {_SCORES}, {_VSQL} SELECT vector, p_brand, row_number() OVER (PARTITION BY vector ORDER BY round(w0 * revenue_n + w1 * orders_n + w2 * nations_n + w3 * returned_n, 9) DESC, p_brand) AS rank FROM s CROSS JOIN v")
def rank_under_weights(spark, d):
    vectors = spark.createDataFrame([(n, *w) for n, w in _VECTORS], "vector string, w0 double, w1 double, w2 double, w3 double")
    s = _scores(spark, d).crossJoin(F.broadcast(vectors))  # eight vectors
    score = F.round(F.expr("w0 * revenue_n + w1 * orders_n + w2 * nations_n + w3 * returned_n"), 9)
    return scoring.rank_by(s, score, "p_brand", ["vector"]).select("vector", "p_brand", F.col("rank"))


@query(f"WITH {_BRANDS}, r AS (SELECT p_brand, row_number() OVER (ORDER BY revenue DESC, p_brand) AS x, row_number() OVER (ORDER BY orders DESC, p_brand) AS y FROM b) SELECT round(sum(sign((p.x - q.x) * (p.y - q.y))) / count(*), 6) AS tau FROM r p JOIN r q ON p.p_brand < q.p_brand")
def kendall_tau(spark, d):
    b = _brands(spark, d)
    x = scoring.rank_by(b, F.col("revenue"), "p_brand").select("p_brand", F.col("rank").alias("x"))
    y = scoring.rank_by(b, F.col("orders"), "p_brand").select("p_brand", F.col("rank").alias("y"))
    return relational.kendall_tau(x.join(y, "p_brand"), "x", "y", "p_brand").select(_r("tau").alias("tau"))


@query(f"WITH {_BRANDS} SELECT p_brand, round(-(parts * 1800.0) + revenue / 1000 * 0.5 / 1.08 + revenue / 1000 / power(1.08, 2) + revenue / 1000 / power(1.08, 3), 4) AS npv, round(parts * 1800.0 / (revenue / 1000), 6) AS payback FROM b")
def npv_payback(spark, d):
    benefit, cost = F.col("revenue") / 1000, F.col("parts") * 1800.0
    return _brands(spark, d).select("p_brand", F.round(scoring.npv(benefit, cost), 4).alias("npv"), _r(cost / benefit).alias("payback"))


@query(f"WITH {_BRANDS}, m AS (SELECT list_sort(list(revenue))[floor(count(*) / 2)::INT + 1] AS mv, list_sort(list(parts))[floor(count(*) / 2)::INT + 1] AS me FROM b) SELECT p_brand, CASE WHEN revenue >= mv AND parts < me THEN 'quick_wins' WHEN revenue >= mv THEN 'big_bets' WHEN parts < me THEN 'fill_ins' ELSE 'reconsider' END AS quadrant FROM b, m")
def quadrants(spark, d):
    return scoring.quadrants(_brands(spark, d), "revenue", "parts").select("p_brand", "quadrant")


@query(f"WITH {_BRANDS}, p AS (SELECT p_brand, nations * 1.0 + returned / 100.0 AS points FROM b) SELECT p_brand, round(points, 6) AS points, CASE WHEN points <= 12 THEN 'XS' WHEN points <= 24 THEN 'S' WHEN points <= 45 THEN 'M' WHEN points <= 75 THEN 'L' ELSE 'XL' END AS size FROM p")
def effort_bands(spark, d):
    points = F.col("nations") * 1.0 + F.col("returned") / 100.0
    return _brands(spark, d).select("p_brand", _r(points).alias("points"), scoring.effort_size(points).alias("size"))


def _dq_sql(table_: str, rules: list[tuple[str, str, str, float, bool]]) -> str:
    one = lambda r: f"SELECT '{table_}' AS input, '{r[0]}' AS rule, '{r[1]}' AS dimension, count(*) AS checked, count_if(coalesce({r[2]}, false)) AS failed, {r[3]} AS t, {str(r[4]).lower()} AS w FROM {table_}"
    return " UNION ALL ".join(map(one, rules))


_RULES = {
    "orders": [("ORD-01", "validity", "o_orderstatus NOT IN ('O', 'F', 'P')", 0.0, False), ("ORD-02", "validity", "o_totalprice < 0", 0.0, False), ("ORD-03", "timeliness", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'", 0.05, False)],
    "lineitem": [("LIN-01", "validity", "l_quantity <= 0", 0.0, False), ("LIN-02", "validity", "l_discount > 0.05", 0.1, True), ("LIN-03", "completeness", "l_returnflag IS NULL", 0.0, False)],
    "events": [("EVT-01", "validity", "event_type = 'error'", 0.5, False), ("EVT-02", "completeness", "props IS NULL", 0.0, False)],
    "documents": [("DOC-01", "completeness", "text IS NULL OR text = ''", 0.0, True), ("DOC-02", "validity", "n_chars <> length(text)", 0.0, False)],
}


@query("SELECT input, rule, dimension, checked, failed, round(CASE WHEN checked > 0 THEN failed / checked ELSE 0 END, 6) AS share, CASE WHEN failed = 0 THEN 'pass' WHEN failed / checked <= t OR w THEN 'warn' ELSE 'fail' END AS result FROM (" + " UNION ALL ".join(_dq_sql(t, r) for t, r in _RULES.items()) + ")")
def dq_scorecard(spark, d):
    out = None
    for name, rules in _RULES.items():
        part = quality.scorecard(table(spark, d, name), name, [(r, dim, F.expr(bad), t, w) for r, dim, bad, t, w in rules])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("share", _r("share"))


@query("SELECT (min(o_orderdate::DATE)) AS oldest, date_diff('day', min(o_orderdate::DATE), DATE '2001-09-01') AS age_days, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) AS spread_days, CASE WHEN date_diff('day', min(o_orderdate::DATE), DATE '2001-09-01') > 90 THEN 'fail' WHEN date_diff('day', min(o_orderdate::DATE), DATE '2001-09-01') > 30 THEN 'warn' ELSE 'pass' END AS verdict FROM orders")
def freshness_gate(spark, d):
    return quality.freshness(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", late())


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("WITH up AS (SELECT tgt, min(src) AS src FROM (SELECT 'N' || n_nationkey AS tgt, 'R' || n_regionkey AS src FROM nation UNION ALL SELECT 'R' || r_regionkey, 'WORLD' FROM region) GROUP BY tgt HAVING count(*) = 1) SELECT 'N' || n_nationkey AS node, coalesce(u2.src, u1.src, 'N' || n_nationkey) AS terminal, ((u1.src IS NOT NULL)::INT + (u2.src IS NOT NULL)::INT) AS hops FROM nation LEFT JOIN up u1 ON u1.tgt = 'N' || n_nationkey LEFT JOIN up u2 ON u2.tgt = u1.src")
def lineage_walk(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    edges = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), own.alias("tgt")).union(r.select(F.lit("WORLD"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))))
    return relational.lineage_walk(n.select(own.alias("node")), edges)


_YEARS = "y AS (SELECT DISTINCT year(o_orderdate) AS yr, p_type || p_brand AS name, s_nationkey AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {_YEARS}, n AS (SELECT name, m FROM y WHERE yr = 2000), b AS (SELECT name, m FROM y WHERE yr = 1999), ns AS (SELECT name, count(*) AS c FROM n GROUP BY 1), bs AS (SELECT name, count(*) AS c FROM b GROUP BY 1), k AS (SELECT n.name AS x, b.name AS y, count(*) AS k FROM n JOIN b USING (m) GROUP BY ALL) SELECT bs.name, round(coalesce(max(k / (ns.c + bs.c - k)), 0), 6) AS best FROM bs LEFT JOIN k ON k.y = bs.name LEFT JOIN ns ON ns.name = k.x GROUP BY bs.name")
def stability_jaccard(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("m"))
    y = _purchases(spark, d).drop("o_custkey").join(o, "o_orderkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("yr", F.concat("p_type", "p_brand").alias("name"), "m").distinct()
    return relational.stability(y.where("yr = 2000"), y.where("yr = 1999"), "name", "m").select("name", _r("best").alias("best"))


@query("WITH b AS (SELECT DISTINCT p_brand, year(o_orderdate) AS yr FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), a AS (SELECT p_brand FROM b WHERE yr = 1996), c AS (SELECT p_brand FROM b WHERE yr = 2001) SELECT coalesce(a.p_brand, c.p_brand) AS p_brand, CASE WHEN a.p_brand IS NULL THEN 'added' WHEN c.p_brand IS NULL THEN 'removed' ELSE 'matched' END AS delta FROM a FULL JOIN c USING (p_brand)")
def run_delta_match(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    b = _purchases(spark, d).join(o, "o_orderkey").select("p_brand", "yr").distinct()
    a, c = b.where("yr = 1996").select("p_brand", F.lit(1).alias("was")), b.where("yr = 2001").select("p_brand", F.lit(1).alias("is"))
    return a.join(c, "p_brand", "full").select("p_brand", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("matched").alias("delta"))


@query("WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') || ':' || coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, '') || ':' || coalesce(text, '')) - 1 AS position FROM conversations), c AS (SELECT conv_id, position, body, '' AS prev_hash, sha256('|' || body) AS row_hash FROM r WHERE position = 0 UNION ALL SELECT r.conv_id, r.position, r.body, c.row_hash, sha256(c.row_hash || '|' || r.body) FROM c JOIN r ON r.conv_id = c.conv_id AND r.position = c.position + 1) SELECT conv_id, position::INT AS position, prev_hash, row_hash FROM c")
def hash_chain(spark, d):
    return _chain(spark, d).select("conv_id", "position", "prev_hash", "row_hash")


def _chain(spark, d):
    body = F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return ledger.seal(table(spark, d, "conversations"), "conv_id", ["turn"], body)


@query("SELECT conv_id, CASE WHEN count(*) > 2 THEN 2 END AS first_break, count(*) AS n_rows FROM conversations GROUP BY 1")
def hash_chain_verify(spark, d):
    """Every third row is altered after sealing: verification names the first."""
    tampered = _chain(spark, d).withColumn("body", F.when(F.col("position") % 3 == 2, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return ledger.verify(tampered, "conv_id", "position")


@query("WITH u AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1), s AS (SELECT user_id, errors, errors / sum(errors) OVER () AS share FROM u) SELECT user_id, errors, round(share, 6) AS share, CASE WHEN share >= 0.05 THEN 'high' WHEN share >= 0.01 OR errors >= 10 THEN 'medium' ELSE 'low' END AS priority, row_number() OVER (ORDER BY errors DESC, user_id) AS rank FROM s")
def remediation_units(spark, d):
    u = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    s = u.crossJoin(F.broadcast(u.agg(F.sum("errors").alias("total")))).withColumn("share", F.col("errors") / F.col("total"))  # one row
    s = s.withColumn("priority", F.when(F.col("share") >= 0.05, "high").when((F.col("share") >= 0.01) | (F.col("errors") >= 10), "medium").otherwise("low"))
    return scoring.rank_all(s, F.col("errors"), "user_id").select("user_id", "errors", _r("share").alias("share"), "priority", "rank")


@query(f"WITH {LAST} SELECT c_custkey, last, coalesce(n, 0) AS n FROM l WHERE last IS NULL OR last < DATE '2000-06-01'")
def zombie_reports(spark, d):
    return _last_order(spark, d).where("last is null or last < date'2000-06-01'").select("c_custkey", "last", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_SCORES} SELECT p_brand, round({_COMP}, 6) AS composite FROM s WHERE contains(lower(p_brand), '#1') ORDER BY round({_COMP}, 9) DESC, p_brand LIMIT 5")
def named_ranking(spark, d):
    s = _scores(spark, d).where(F.lower("p_brand").contains("#1"))
    return s.orderBy(F.round(_composite(), 9).desc(), "p_brand").limit(5).select("p_brand", _r(_composite()).alias("composite"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY 1")
def json_props_rollup(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"), F.max(k).alias("max_k"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    """Similarity of each vector with its successor."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(n, "vec_id").select("vec_id", F.round(S.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


# --- communities, streams ----------------------------------------------------------------------------------

from metrigraph.operators import community  # noqa: E402
from metrigraph.streaming import usage  # noqa: E402


@query()
def louvain_communities(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = _purchases(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("group", F.concat_ws("-", "p_type", "p_brand"))
    return community.communities(relational.projection(e, "group", "s_nationkey", 0.25), "a", "b", "jaccard")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS runs, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def windowed_usage(spark, d):
    return usage.windowed_usage(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
