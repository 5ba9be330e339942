"""Named queries and the DuckDB SQL that gives the same rows.

The driver's `events` table serves as the logs of one tenant: logs_view() maps
its columns to those of the `logs` table, and every query runs over that view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.time import event_hour, nanos
from .plans import storage_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000_000

#: The same view in DuckDB; every oracle begins with it.
LOGS_SQL = """WITH logs AS (SELECT event_id AS wal_sequence, epoch_ns(ts) AS event_time_unix_nano, event_type AS body,
value AS log_value_f64, CAST(json_extract_string(props, '$.k') AS BIGINT) AS log_k_i64, user_id AS log_user_id_i64,
CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS log_sparse_i64
FROM events) """
#: An event time in the middle of the tables' month, and one a day later.
T0, T1 = 1_705_276_800_000_000_000, 1_705_363_200_000_000_000


def logs_view(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The events as log rows, of event times from `start` to before `end` (whole microseconds). Only the columns a query names are read.

    The bounds are compared with the stored timestamps, so that Parquet skips by them: the view's own time is an expression.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = events.schema["ts"].dataType

    def at(time: int) -> Column:
        return F.timestamp_micros(F.lit(time // 1000)).cast(kind)

    if start is not None:
        events = events.filter(F.col("ts") >= at(start))
    if end is not None:
        events = events.filter(F.col("ts") < at(end))
    return events.select(
        F.col("event_id").alias("wal_sequence"),
        nanos(F.col("ts")).alias("event_time_unix_nano"),
        F.col("event_type").alias("body"),
        F.col("value").alias("log_value_f64"),
        k.alias("log_k_i64"),
        F.col("user_id").alias("log_user_id_i64"),
        F.when(k % 3 != 0, k).alias("log_sparse_i64"),
    )


def query(name: str, sql: str | None, start: int | None = None, end: int | None = None):
    """Registers a function from the logs view, of a span of event times, to a result, and the oracle's SELECT over the whole view."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(logs_view(spark, sf_dir, start, end))
        if sql is not None:
            ORACLES[name] = LOGS_SQL + sql
        return f

    return register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers Spark SQL over {logs}, and the same text (or `oracle`) for DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.format(logs="{logs}"), logs=logs_view(spark, sf_dir))

    QUERIES[name] = run
    ORACLES[name] = LOGS_SQL.replace("WITH logs", "WITH RECURSIVE logs") + (oracle or text).replace("{logs}", "logs")


# Projection and filters -----------------------------------------------------


@query("project_alias", "SELECT body AS message, wal_sequence FROM logs")
def project_alias(logs):
    return logs.select(F.col("body").alias("message"), "wal_sequence")


@query("filter_time_bound", f"SELECT wal_sequence, event_time_unix_nano FROM logs WHERE event_time_unix_nano >= {T0}", start=T0)
def filter_time_bound(logs):
    return logs.select("wal_sequence", "event_time_unix_nano")


@query("filter_body_eq", "SELECT wal_sequence FROM logs WHERE body = 'click'")
def filter_body_eq(logs):
    return logs.filter(F.col("body") == "click").select("wal_sequence")


@query("filter_dynamic_eq", "SELECT wal_sequence, log_k_i64, log_value_f64 FROM logs WHERE log_k_i64 = 10")
def filter_dynamic_eq(logs):
    return logs.filter(F.col("log_k_i64") == 10).select("wal_sequence", "log_k_i64", "log_value_f64")


@query("filter_between", "SELECT wal_sequence, log_user_id_i64 FROM logs WHERE log_user_id_i64 BETWEEN 20 AND 40")
def filter_between(logs):
    return logs.filter(F.col("log_user_id_i64").between(20, 40)).select("wal_sequence", "log_user_id_i64")


@query("filter_and", f"SELECT wal_sequence FROM logs WHERE event_time_unix_nano >= {T0} AND event_time_unix_nano < {T1} AND log_k_i64 > 50", start=T0, end=T1)
def filter_and(logs):
    return logs.filter(F.col("log_k_i64") > 50).select("wal_sequence")


@query("filter_or", "SELECT wal_sequence FROM logs WHERE log_k_i64 = 1 OR log_user_id_i64 = 2")
def filter_or(logs):
    return logs.filter((F.col("log_k_i64") == 1) | (F.col("log_user_id_i64") == 2)).select("wal_sequence")


@query("filter_is_null", "SELECT wal_sequence FROM logs WHERE log_sparse_i64 IS NULL")
def filter_is_null(logs):
    return logs.filter(F.col("log_sparse_i64").isNull()).select("wal_sequence")


@query("filter_not_null_neq", "SELECT wal_sequence, log_sparse_i64 FROM logs WHERE log_sparse_i64 IS NOT NULL AND body <> 'click' AND NOT (log_sparse_i64 < 40)")
def filter_not_null_neq(logs):
    x = F.col("log_sparse_i64")
    return logs.filter(x.isNotNull() & (F.col("body") != "click") & ~(x < 40)).select("wal_sequence", "log_sparse_i64")


@query(
    "filter_in_like_case",
    "SELECT wal_sequence, CASE WHEN body LIKE 'c%' THEN 'c' WHEN body ILIKE 'V%' THEN 'v' ELSE 'other' END AS kind, COALESCE(log_sparse_i64, -1) AS k, CAST(log_value_f64 AS BIGINT) AS whole "
    "FROM logs WHERE log_k_i64 IN (1, 2, 3, 50) AND regexp_matches(body, '^[a-z]+$')",
)
def filter_in_like_case(logs):
    kind = F.when(F.col("body").like("c%"), "c").when(F.col("body").ilike("V%"), "v").otherwise("other")
    whole = F.bround("log_value_f64", 0).cast("bigint")  # the oracle rounds half to even where Spark's cast cuts
    return logs.filter(F.col("log_k_i64").isin(1, 2, 3, 50) & F.col("body").rlike("^[a-z]+$")).select("wal_sequence", kind.alias("kind"), F.coalesce("log_sparse_i64", F.lit(-1)).alias("k"), whole.alias("whole"))


@query("empty_filter_keeps_schema", "SELECT body, event_time_unix_nano FROM logs WHERE body = 'missing'")
def empty_filter_keeps_schema(logs):
    return logs.filter(F.col("body") == "missing").select("body", "event_time_unix_nano")


sql_query("select_star", "SELECT * FROM {logs}")

# Aggregates -----------------------------------------------------------------


@query("count_star", "SELECT count(*) AS rows_counted FROM logs")
def count_star(logs):
    return logs.agg(F.count("*").alias("rows_counted"))


@query("count_by_body", "SELECT body, count(*) AS rows_counted FROM logs GROUP BY body ORDER BY body")
def count_by_body(logs):
    return logs.groupBy("body").agg(F.count("*").alias("rows_counted")).orderBy("body")


@query("count_by_null_group", "SELECT log_sparse_i64, count(*) AS n FROM logs GROUP BY log_sparse_i64")
def count_by_null_group(logs):
    return logs.groupBy("log_sparse_i64").agg(F.count("*").alias("n"))


@query("sum_i64", "SELECT CAST(sum(log_k_i64) AS BIGINT) AS total FROM logs")
def sum_i64(logs):
    return logs.agg(F.sum("log_k_i64").alias("total"))


@query("avg_f64", "SELECT round(avg(log_value_f64), 6) AS mean FROM logs")
def avg_f64(logs):
    return logs.agg(F.round(F.avg("log_value_f64"), 6).alias("mean"))


@query("sum_decimal", "SELECT body, sum(CAST(log_k_i64 AS DECIMAL(18, 2))) AS total FROM logs GROUP BY body")
def sum_decimal(logs):
    return logs.groupBy("body").agg(F.sum(F.col("log_k_i64").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query("min_max_distinct", "SELECT body, min(log_k_i64) AS low, max(log_k_i64) AS high, count(log_sparse_i64) AS known, count(DISTINCT log_user_id_i64) AS users FROM logs GROUP BY body")
def min_max_distinct(logs):
    return logs.groupBy("body").agg(F.min("log_k_i64").alias("low"), F.max("log_k_i64").alias("high"), F.count("log_sparse_i64").alias("known"), F.countDistinct("log_user_id_i64").alias("users"))


@query(
    "statistics",
    "SELECT body, round(stddev_samp(log_k_i64), 6) AS sd, round(var_samp(log_k_i64), 6) AS variance, round(corr(log_k_i64, log_user_id_i64), 6) AS correlation, "
    "round(covar_samp(log_k_i64, log_user_id_i64), 6) AS covariance, median(log_k_i64) AS middle, bool_and(log_k_i64 >= 0) AS never_negative, CAST(bit_and(log_k_i64) AS BIGINT) AS bits FROM logs GROUP BY body",
)
def statistics(logs):
    k, u = F.col("log_k_i64").cast("double"), F.col("log_user_id_i64").cast("double")
    return logs.groupBy("body").agg(
        F.round(F.stddev(k), 6).alias("sd"), F.round(F.variance(k), 6).alias("variance"), F.round(F.corr(k, u), 6).alias("correlation"), F.round(F.covar_samp(k, u), 6).alias("covariance"),
        F.median("log_k_i64").alias("middle"), F.bool_and(F.col("log_k_i64") >= 0).alias("never_negative"), F.bit_and("log_k_i64").alias("bits"),
    )


sql_query("string_agg", "SELECT log_user_id_i64, listagg(DISTINCT body, ',') WITHIN GROUP (ORDER BY body) AS bodies FROM {logs} GROUP BY log_user_id_i64", "SELECT log_user_id_i64, string_agg(DISTINCT body, ',' ORDER BY body) AS bodies FROM logs GROUP BY log_user_id_i64")
sql_query("aggregate_filter", "SELECT body, count(*) FILTER (WHERE log_k_i64 > 50) AS high, CAST(sum(log_k_i64) FILTER (WHERE log_k_i64 <= 50) AS BIGINT) AS low_sum FROM {logs} GROUP BY body")
sql_query("having", "SELECT log_user_id_i64, count(*) AS n FROM {logs} GROUP BY log_user_id_i64 HAVING count(*) > 70")
sql_query("select_distinct", "SELECT DISTINCT body, log_k_i64 FROM {logs}")


@query("approx_distinct", "SELECT body, TRUE AS users_close, TRUE AS middle_close FROM logs GROUP BY body")
def approx_distinct(logs):
    """Whether the approximations keep their bounds: three standard errors of the count, and of the rank of the median 1 in 1,000."""
    found = logs.groupBy("body").agg(
        F.approx_count_distinct("log_user_id_i64", 0.05).alias("users"), F.countDistinct("log_user_id_i64").alias("exact"), F.percentile_approx("log_k_i64", 0.5, 1_000).alias("middle"),
        F.percentile("log_k_i64", F.lit(0.498)).alias("low"), F.percentile("log_k_i64", F.lit(0.502)).alias("high"),
    )
    return found.select("body", (F.abs(F.col("users") - F.col("exact")) <= F.ceil(0.15 * F.col("exact"))).alias("users_close"), F.col("middle").between(F.floor("low"), F.ceil("high")).alias("middle_close"))


sql_query(
    "first_last_aggregate",
    "SELECT log_user_id_i64, min_by(body, wal_sequence) AS oldest, max_by(body, wal_sequence) AS newest, any_value(log_user_id_i64) AS own, first(log_user_id_i64) AS head, last(log_user_id_i64) AS tail FROM {logs} GROUP BY log_user_id_i64",
    "SELECT log_user_id_i64, arg_min(body, wal_sequence) AS oldest, arg_max(body, wal_sequence) AS newest, any_value(log_user_id_i64) AS own, first(log_user_id_i64) AS head, last(log_user_id_i64) AS tail FROM logs GROUP BY log_user_id_i64",
)
sql_query(
    "array_agg_sorted",
    "SELECT log_user_id_i64, array_join(array_sort(array_agg(DISTINCT body)), '|') AS bodies, CAST(size(array_agg(log_sparse_i64)) AS BIGINT) AS known FROM {logs} GROUP BY log_user_id_i64",
    "SELECT log_user_id_i64, array_to_string(list_sort(array_agg(DISTINCT body)), '|') AS bodies, count(log_sparse_i64) AS known FROM logs GROUP BY log_user_id_i64",
)


@query("rollup", "SELECT body, log_k_i64 % 4 AS part, count(*) AS n FROM logs GROUP BY ROLLUP (body, log_k_i64 % 4)")
def rollup(logs):
    return logs.withColumn("part", F.col("log_k_i64") % 4).rollup("body", "part").agg(F.count("*").alias("n"))


@query("cube", "SELECT body, log_k_i64 % 4 AS part, count(*) AS n FROM logs GROUP BY CUBE (body, log_k_i64 % 4)")
def cube(logs):
    return logs.withColumn("part", F.col("log_k_i64") % 4).cube("body", "part").agg(F.count("*").alias("n"))


sql_query("grouping_sets", "SELECT body, log_user_id_i64, count(*) AS n FROM {logs} GROUP BY GROUPING SETS ((body), (log_user_id_i64), ())")

# Order and limits ---------------------------------------------------------------


def newest(logs: DataFrame) -> DataFrame:
    return logs.orderBy(F.desc("event_time_unix_nano"), F.desc("wal_sequence"))


@query("newest_top_n", "SELECT body, event_time_unix_nano, wal_sequence FROM logs ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 20")
def newest_top_n(logs):
    return newest(logs.select("body", "event_time_unix_nano", "wal_sequence")).limit(20)


@query("newest_top_n_filtered", f"SELECT body, event_time_unix_nano, wal_sequence FROM logs WHERE event_time_unix_nano < {T0} AND body = 'view' ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 20", end=T0)
def newest_top_n_filtered(logs):
    return newest(logs.filter(F.col("body") == "view").select("body", "event_time_unix_nano", "wal_sequence")).limit(20)


@query("oldest_top_n", "SELECT body, event_time_unix_nano, wal_sequence FROM logs ORDER BY event_time_unix_nano, wal_sequence LIMIT 20")
def oldest_top_n(logs):
    return logs.select("body", "event_time_unix_nano", "wal_sequence").orderBy("event_time_unix_nano", "wal_sequence").limit(20)


@query("order_nulls_explicit", "SELECT log_sparse_i64, wal_sequence FROM logs ORDER BY log_sparse_i64 DESC NULLS FIRST, wal_sequence LIMIT 50")
def order_nulls_explicit(logs):
    return logs.select("log_sparse_i64", "wal_sequence").orderBy(F.desc_nulls_first("log_sparse_i64"), "wal_sequence").limit(50)


@query("offset_page", "SELECT wal_sequence FROM logs ORDER BY wal_sequence LIMIT 25 OFFSET 100")
def offset_page(logs):
    return logs.select("wal_sequence").orderBy("wal_sequence").offset(100).limit(25)


# Time ---------------------------------------------------------------------------


@query("hour_histogram", f"SELECT event_time_unix_nano - event_time_unix_nano % {HOUR} AS hour_start, count(*) AS n FROM logs GROUP BY 1")
def hour_histogram(logs):
    return logs.groupBy(event_hour(F.col("event_time_unix_nano")).alias("hour_start")).agg(F.count("*").alias("n"))


@query("hour_partition_counts", "SELECT strftime(make_timestamp_ns(event_time_unix_nano), '%Y-%m-%d') AS date, strftime(make_timestamp_ns(event_time_unix_nano), '%H') AS hour, count(*) AS n FROM logs GROUP BY 1, 2")
def hour_partition_counts(logs):
    time = F.timestamp_micros(F.expr("event_time_unix_nano div 1000"))
    return logs.groupBy(F.date_format(time, "yyyy-MM-dd").alias("date"), F.date_format(time, "HH").alias("hour")).agg(F.count("*").alias("n"))


@query(
    "severity_error_rate_by_hour",
    f"SELECT event_time_unix_nano - event_time_unix_nano % {HOUR} AS hour_start, count(*) AS n, CAST(sum(CASE WHEN body = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(CASE WHEN log_k_i64 >= 90 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM logs GROUP BY 1",
)
def severity_error_rate_by_hour(logs):
    return logs.groupBy(event_hour(F.col("event_time_unix_nano")).alias("hour_start")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("body") == "error", 1).otherwise(0)).alias("errors"), F.round(F.avg(F.when(F.col("log_k_i64") >= 90, 1.0).otherwise(0.0)), 6).alias("rate")
    )


# Windows ------------------------------------------------------------------------


def per_body() -> Window:
    return Window.partitionBy("body").orderBy("event_time_unix_nano", "wal_sequence")


def per_user() -> Window:
    """By user and body: of a few bodies alone each would be a task of its own, which more machines do not shorten."""
    return Window.partitionBy("log_user_id_i64", "body").orderBy("event_time_unix_nano", "wal_sequence")


BODY_SQL = "OVER (PARTITION BY body ORDER BY event_time_unix_nano, wal_sequence)"
ORDER_SQL = "OVER (PARTITION BY log_user_id_i64, body ORDER BY event_time_unix_nano, wal_sequence)"


@query("row_number_per_body", f"SELECT * FROM (SELECT body, wal_sequence, CAST(row_number() {BODY_SQL} AS INTEGER) AS place FROM logs) WHERE place <= 10")
def row_number_per_body(logs):
    return logs.select("body", "wal_sequence", F.row_number().over(per_body()).alias("place")).filter("place <= 10")


@query("lag_gap", f"SELECT wal_sequence, event_time_unix_nano - lag(event_time_unix_nano) {ORDER_SQL} AS gap, lead(wal_sequence) {ORDER_SQL} AS following FROM logs")
def lag_gap(logs):
    gap = F.col("event_time_unix_nano") - F.lag("event_time_unix_nano").over(per_user())
    return logs.select("wal_sequence", gap.alias("gap"), F.lead("wal_sequence").over(per_user()).alias("following"))


@query("running_sum", f"SELECT wal_sequence, CAST(sum(log_k_i64) {ORDER_SQL[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, CAST(sum(log_k_i64) {ORDER_SQL[:-1]} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near FROM logs")
def running_sum(logs):
    w = per_user()
    return logs.select("wal_sequence", F.sum("log_k_i64").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.sum("log_k_i64").over(w.rowsBetween(-2, 2)).alias("near"))


K_SQL = "OVER (PARTITION BY log_user_id_i64 ORDER BY log_k_i64)"


@query(
    "rank_dense_rank",
    f"SELECT wal_sequence, CAST(rank() {K_SQL} AS INTEGER) AS place, CAST(dense_rank() {K_SQL} AS INTEGER) AS step, round(percent_rank() {K_SQL}, 6) AS share, round(cume_dist() {K_SQL}, 6) AS below, CAST(ntile(4) OVER (PARTITION BY log_user_id_i64 ORDER BY log_k_i64, wal_sequence) AS INTEGER) AS quarter FROM logs",
)
def rank_dense_rank(logs):
    w = Window.partitionBy("log_user_id_i64").orderBy("log_k_i64")
    return logs.select(
        "wal_sequence", F.rank().over(w).alias("place"), F.dense_rank().over(w).alias("step"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("below"),
        F.ntile(4).over(Window.partitionBy("log_user_id_i64").orderBy("log_k_i64", "wal_sequence")).alias("quarter"),
    )


@query("first_last_nth", f"SELECT wal_sequence, first_value(log_k_i64) {ORDER_SQL} AS head, nth_value(log_k_i64, 2) {ORDER_SQL} AS second, last_value(log_k_i64) {ORDER_SQL} AS own FROM logs")
def first_last_nth(logs):
    w = per_user()
    return logs.select("wal_sequence", F.first_value("log_k_i64").over(w).alias("head"), F.nth_value("log_k_i64", 2).over(w).alias("second"), F.last_value("log_k_i64").over(w).alias("own"))


@query("range_frame", f"SELECT wal_sequence, count(*) OVER (PARTITION BY log_user_id_i64 ORDER BY event_time_unix_nano RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS last_hour FROM logs")
def range_frame(logs):
    return logs.select("wal_sequence", F.count("*").over(Window.partitionBy("log_user_id_i64").orderBy("event_time_unix_nano").rangeBetween(-HOUR, 0)).alias("last_hour"))


# Sets, subqueries, joins ----------------------------------------------------------

sql_query("union_all", "SELECT body, log_k_i64 FROM {logs} WHERE log_k_i64 < 5 UNION ALL SELECT body, log_k_i64 FROM {logs} WHERE log_k_i64 < 3")
sql_query("union_distinct", "SELECT body, log_k_i64 FROM {logs} WHERE log_k_i64 < 50 UNION SELECT body, log_k_i64 FROM {logs} WHERE log_k_i64 > 30")
sql_query("intersect", "SELECT log_user_id_i64 FROM {logs} WHERE log_k_i64 < 30 INTERSECT SELECT log_user_id_i64 FROM {logs} WHERE log_k_i64 > 90")
sql_query("except", "SELECT log_user_id_i64, body FROM {logs} WHERE log_k_i64 < 30 EXCEPT SELECT log_user_id_i64, body FROM {logs} WHERE log_k_i64 > 80")
sql_query("cte", "SELECT body, max(n) AS most FROM (WITH users AS (SELECT body, log_user_id_i64, count(*) AS n FROM {logs} GROUP BY body, log_user_id_i64) SELECT * FROM users) AS u GROUP BY body")
sql_query("scalar_subquery", "SELECT wal_sequence FROM {logs} WHERE log_k_i64 > (SELECT avg(log_k_i64) FROM {logs})")
sql_query("semi_exists", "SELECT wal_sequence FROM {logs} AS a WHERE EXISTS (SELECT 1 FROM {logs} AS b WHERE b.log_user_id_i64 = a.log_user_id_i64 AND b.log_k_i64 = 0)")
sql_query("anti_not_exists", "SELECT wal_sequence FROM {logs} AS a WHERE NOT EXISTS (SELECT 1 FROM {logs} AS b WHERE b.log_user_id_i64 = a.log_user_id_i64 AND b.log_k_i64 = 0)")
sql_query("in_subquery", "SELECT wal_sequence FROM {logs} WHERE log_user_id_i64 IN (SELECT log_user_id_i64 FROM {logs} WHERE log_k_i64 = 7)")
sql_query("not_in_subquery", "SELECT wal_sequence FROM {logs} WHERE log_user_id_i64 NOT IN (SELECT log_user_id_i64 FROM {logs} WHERE log_k_i64 = 7)")
sql_query("self_join_inner", "SELECT a.wal_sequence, b.wal_sequence AS other FROM {logs} AS a JOIN {logs} AS b ON a.wal_sequence + 1 = b.wal_sequence AND a.body = b.body")
sql_query("left_join_values", "SELECT l.wal_sequence, v.weight FROM {logs} AS l LEFT JOIN (VALUES ('click', 1), ('view', 2), ('never', 3)) AS v(name, weight) ON l.body = v.name")
sql_query("right_join_values", "SELECT v.name, count(l.wal_sequence) AS n FROM {logs} AS l RIGHT JOIN (VALUES ('click', 1), ('view', 2), ('never', 3)) AS v(name, weight) ON l.body = v.name GROUP BY v.name")
sql_query("full_join", "SELECT a.u, a.n, b.m FROM (SELECT log_user_id_i64 AS u, count(*) AS n FROM {logs} WHERE log_k_i64 < 3 GROUP BY 1) AS a FULL JOIN (SELECT log_user_id_i64 AS v, count(*) AS m FROM {logs} WHERE log_k_i64 > 97 GROUP BY 1) AS b ON a.u = b.v")
sql_query("theta_join_values", "SELECT l.wal_sequence, v.name FROM {logs} AS l JOIN (VALUES (0, 20, 'low'), (21, 80, 'middle'), (81, 1000, 'high')) AS v(a, z, name) ON l.log_k_i64 BETWEEN v.a AND v.z")
sql_query("lateral_join", "SELECT l.wal_sequence, t.twice FROM {logs} AS l, LATERAL (SELECT l.log_k_i64 * 2 AS twice) AS t WHERE t.twice > 150")
sql_query(
    "recursive_cte",
    "WITH RECURSIVE hours(h) AS (SELECT 0 UNION ALL SELECT h + 1 FROM hours WHERE h < 23) SELECT h, count(wal_sequence) AS n FROM hours LEFT JOIN {logs} ON (event_time_unix_nano div 3600000000000) % 24 = h GROUP BY h",
    "SELECT h, count(wal_sequence) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN logs ON (event_time_unix_nano // 3600000000000) % 24 = h GROUP BY h",
)

sql_query("cross_join_values", "SELECT l.wal_sequence, v.n FROM {logs} AS l CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE l.log_k_i64 < 10")
sql_query("merge_join_hint", "SELECT /*+ MERGE(b) */ a.wal_sequence, b.log_user_id_i64 AS u FROM {logs} AS a JOIN {logs} AS b ON a.wal_sequence = b.wal_sequence")
sql_query("values_only", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(n, name)")
sql_query("range_table", "SELECT id * 2 AS twice FROM range(10)", "SELECT range * 2 AS twice FROM range(10)")
sql_query("correlated_scalar", "SELECT DISTINCT a.body, (SELECT max(b.log_k_i64) FROM {logs} AS b WHERE b.body = a.body) AS high FROM {logs} AS a")
sql_query("qualify_by_subquery", "SELECT body, wal_sequence FROM (SELECT body, wal_sequence, row_number() OVER (PARTITION BY body ORDER BY log_value_f64 DESC, wal_sequence) AS rn FROM {logs}) AS t WHERE rn <= 3")
sql_query("intersect_all", "SELECT body FROM {logs} WHERE log_k_i64 = 1 INTERSECT ALL SELECT body FROM {logs} WHERE log_k_i64 = 2")
sql_query("except_all", "SELECT body FROM {logs} WHERE log_k_i64 = 1 EXCEPT ALL SELECT body FROM {logs} WHERE log_k_i64 = 2")


@query("broadcast_join_checked", "SELECT l.wal_sequence, u.n FROM logs AS l JOIN (SELECT log_user_id_i64, count(*) AS n FROM logs GROUP BY log_user_id_i64 HAVING count(*) > 70) AS u ON l.log_user_id_i64 = u.log_user_id_i64")
def broadcast_join_checked(logs):
    """No hint: the planner broadcasts the small side if its measured size allows, and sorts and merges otherwise."""
    users = logs.groupBy("log_user_id_i64").agg(F.count("*").alias("n")).filter("n > 70")
    return logs.join(users, "log_user_id_i64").select("wal_sequence", "n")


@query("interval_join", f"SELECT a.wal_sequence, count(b.wal_sequence) AS n FROM logs AS a JOIN logs AS b ON b.body = a.body AND b.event_time_unix_nano > a.event_time_unix_nano - {HOUR} AND b.event_time_unix_nano <= a.event_time_unix_nano WHERE a.log_k_i64 < 5 GROUP BY a.wal_sequence")
def interval_join(logs):
    """A join on nearby times: each left row meets the right rows of its hour and the hour before, by an equality the planner can shuffle on."""
    time = F.col("event_time_unix_nano")
    left = logs.filter("log_k_i64 < 5").select("wal_sequence", "body", time.alias("t"), F.explode(F.array(event_hour(time), event_hour(time) - HOUR)).alias("h"))
    right = logs.select(F.col("body"), time.alias("s"), event_hour(time).alias("h"))
    return left.join(right, ["body", "h"]).filter((F.col("s") > F.col("t") - HOUR) & (F.col("s") <= F.col("t"))).groupBy("wal_sequence").agg(F.count("*").alias("n"))


# Scalar functions -------------------------------------------------------------------

sql_query(
    "scalar_math",
    "SELECT wal_sequence, abs(log_k_i64 - 50) AS a, CAST(ceil(log_value_f64) AS BIGINT) AS b, CAST(floor(log_value_f64) AS BIGINT) AS c, round(sqrt(abs(log_value_f64)), 6) AS d, round(ln(log_k_i64 + 1), 6) AS e, mod(log_k_i64, 7) AS f, CAST(sign(log_k_i64 - 50) AS INTEGER) AS g, round(power(log_k_i64, 2), 3) AS h FROM {logs}",
)
sql_query(
    "scalar_string",
    "SELECT wal_sequence, upper(body) AS a, length(body) AS b, substr(body, 2, 3) AS c, concat(body, '-', CAST(log_k_i64 AS VARCHAR(20))) AS d, replace(body, 'c', 'k') AS e, split_part(body, 'i', 1) AS f, lpad(body, 10, '.') AS g, reverse(body) AS h, trim(concat(' ', body)) AS i, instr(body, 'e') AS j FROM {logs}",
)
sql_query("scalar_regex", "SELECT wal_sequence, regexp_replace(body, '[aeiou]', '#', 1) AS a, regexp_extract(body, '^(.)', 1) AS b FROM {logs}", "SELECT wal_sequence, regexp_replace(body, '[aeiou]', '#', 'g') AS a, regexp_extract(body, '^(.)', 1) AS b FROM logs")
sql_query("scalar_hash", "SELECT DISTINCT body, md5(body) AS a, sha2(body, 256) AS b, base64(encode(body, 'utf-8')) AS c FROM {logs}", "SELECT DISTINCT body, md5(body) AS a, sha256(body) AS b, base64(encode(body)) AS c FROM logs")
sql_query("scalar_conditional", "SELECT wal_sequence, nullif(body, 'click') AS a, greatest(log_k_i64, 10) AS b, least(log_k_i64, 10) AS c, coalesce(log_sparse_i64, 0) AS d FROM {logs}")
sql_query(
    "date_functions",
    "SELECT wal_sequence, date_trunc('day', timestamp_micros(event_time_unix_nano div 1000)) AS day, CAST(extract(hour FROM timestamp_micros(event_time_unix_nano div 1000)) AS BIGINT) AS h FROM {logs}",
    "SELECT wal_sequence, CAST(date_trunc('day', make_timestamp(event_time_unix_nano // 1000)) AS TIMESTAMP) AS day, CAST(extract(hour FROM make_timestamp(event_time_unix_nano // 1000)) AS BIGINT) AS h FROM logs",
)

sql_query("array_functions", "SELECT body, size(collect_set(log_k_i64)) AS kinds, array_max(collect_set(log_k_i64)) AS high, array_contains(collect_set(log_k_i64), 5) AS has_five FROM {logs} GROUP BY body", "SELECT body, CAST(len(list(DISTINCT log_k_i64)) AS INTEGER) AS kinds, list_max(list(log_k_i64)) AS high, list_contains(list(log_k_i64), 5) AS has_five FROM logs GROUP BY body")
sql_query(
    "map_struct_functions",
    "SELECT wal_sequence, element_at(map('kind', body, 'k', CAST(log_k_i64 AS STRING)), 'k') AS k, named_struct('a', body, 'b', log_k_i64).b AS b, size(map_keys(map(body, 1))) AS n, array_join(transform(split(body, 'i'), x -> upper(x)), '+') AS parts FROM {logs}",
    "SELECT wal_sequence, CAST(log_k_i64 AS VARCHAR) AS k, log_k_i64 AS b, CAST(1 AS INTEGER) AS n, array_to_string(list_transform(string_split(body, 'i'), lambda x: upper(x)), '+') AS parts FROM logs",
)
sql_query("try_cast", "SELECT wal_sequence, TRY_CAST(body AS INT) AS a, TRY_CAST(CAST(log_k_i64 AS STRING) AS BIGINT) AS b, TRY_CAST(concat(body, '1') AS DOUBLE) IS NULL AS c FROM {logs}")
sql_query(
    "date_bin_now",
    "SELECT date_trunc('minute', window.start) AS bin, count(*) AS n, bool_and(now() > t) AS past, bool_and(to_timestamp('2020-01-01 00:00:00') < t) AS recent FROM (SELECT timestamp_micros(event_time_unix_nano div 1000) AS t FROM {logs}) GROUP BY window(t, '15 minutes')",
    "SELECT time_bucket(INTERVAL '15 minutes', t) AS bin, count(*) AS n, bool_and(now()::TIMESTAMP > t) AS past, bool_and(TIMESTAMP '2020-01-01 00:00:00' < t) AS recent FROM (SELECT make_timestamp(event_time_unix_nano // 1000) AS t FROM logs) GROUP BY 1",
)
sql_query("explode_words", "SELECT w, count(*) AS n FROM (SELECT explode(split(concat(body, ' ', body), ' ')) AS w FROM {logs}) AS t GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(concat(body, ' ', body), ' ')) AS w FROM logs) AS t GROUP BY w")

# The other tables ---------------------------------------------------------------------------


def table_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers Spark SQL over {table} names, and the same text, or `oracle`, for DuckDB."""
    tables = sorted({w for w in "region nation customer supplier part orders lineitem events".split() if "{" + w + "}" in text})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    QUERIES[name] = run
    plain = oracle or text
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
    ORACLES[name] = plain


table_query(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n "
    "FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
table_query("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
table_query(
    "revenue_by_nation",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey "
    "WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY n_name",
)
table_query(
    "top_unshipped_orders",
    "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-03-15 00:00:00' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
)
table_query("part_supplier_counts", "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers FROM {part} JOIN {lineitem} ON l_partkey = p_partkey WHERE p_size < 20 GROUP BY p_brand")
table_query("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")
table_query("customers_without_orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")

# Storage ------------------------------------------------------------------------------

def stored(f: storage_queries.Reader) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the session's store of all events."""
    return lambda spark, sf_dir: f(spark, storage_queries.shared(spark, sf_dir, logs_view(spark, sf_dir)))


QUERIES |= {name: stored(f) for name, f in storage_queries.QUERIES.items()}
ORACLES |= {name: LOGS_SQL.rstrip() + ", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else LOGS_SQL + sql for name, sql in storage_queries.ORACLES.items()}
