"""Test tables seen as the model tables of the library.

Order lines are the interactions: the order is the session, the part the listing.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan with a fixed schema, so that planning a query starts no job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _instant(c: str):
    """Zone-less timestamp -> the instant with that clock time in UTC."""
    zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {zero}, {c}))")


def line_number():
    """Unique with the session and the ship date."""
    return (F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")) * 100_000 + F.col(
        "l_suppkey"
    )


def keyed_events(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("listing_id"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("user_id"),
        F.concat("l_returnflag", "l_linestatus").alias("event_type"),
        F.col("o_orderstatus").alias("business_type"),
        F.col("l_shipdate").cast("date").alias("dt"),
        _instant("l_shipdate").alias("event_ts"),
        line_number().alias("event_id"),
        F.col("l_suppkey").alias("supplier_id"),
    )


def lines_as_events(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines alone, where the order's own columns are not needed."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("listing_id"),
        F.lit(None).cast("bigint").alias("user_id"),
        F.col("l_shipdate").cast("date").alias("dt"),
        _instant("l_shipdate").alias("event_ts"),
        line_number().alias("event_id"),
        F.col("l_suppkey").alias("supplier_id"),
    )


def _coordinate(base: int, factor: int):
    value = F.lit(float(base)) + (F.col("p_partkey") * factor % 1000) / F.lit(100.0)
    return F.when(F.col("p_partkey") % 17 != 0, value)


def item_listings(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per part."""
    part, nation = table(spark, folder, "part"), table(spark, folder, "nation")
    key = F.col("p_partkey")
    return (
        part.join(nation, key % 25 == F.col("n_nationkey"))
        .select(
            key.alias("listing_id_numeric"),
            _coordinate(-33, 37).alias("lat"),
            _coordinate(-60, 91).alias("lon"),
            (F.col("p_retailprice") * (1 + key % 7)).alias("price"),
            F.col("p_size").cast("double").alias("usable_areas"),
            (F.col("p_size") % 5).alias("bedrooms"),
            (F.col("p_size") % 3).alias("bathrooms"),
            F.when(key % 11 != 0, (key % 4).cast("int")).alias("parking_spaces"),
            (F.col("p_size") % 2).alias("suites"),
            F.when(key % 19 != 0, F.col("p_brand")).alias("city"),
            F.split("p_name", " ")[0].alias("neighborhood"),
            F.col("p_type").alias("unit_type"),
            F.col("n_name").alias("state"),
        )
    )


def known_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings for the queries about items without one: every 13th part lacks it."""
    return item_listings(spark, folder).where(F.col("listing_id_numeric") % 13 != 5)


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listing versions as untyped text: one per order line, with dirty values."""
    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    number = F.col("l_linenumber")
    size = F.col("p_size").cast("string")
    stamp = F.col("l_shipdate").cast("string")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("L"), F.col("l_partkey")).alias("anonymized_listing_id"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.when(number == 5, "unknown").otherwise(stamp).alias("updated_at"),
        stamp.alias("created_at"),
        F.col("l_shipdate").cast("date").cast("string").alias("dt"),
        F.when(number == 2, "").otherwise(F.concat(F.lit("R$ "), F.col("l_extendedprice"))).alias("price"),
        F.when(number != 3, F.concat(size, F.lit(" m"))).alias("usable_areas"),
        F.when(number == 4, "1.2.3").otherwise(size).alias("total_areas"),
        F.concat((F.col("p_size") % 5).cast("string"), F.lit(".0")).alias("bedrooms"),
        F.when(number == 6, "abc").otherwise(number.cast("string")).alias("bathrooms"),
        _coordinate(-33, 37).cast("string").alias("lat_region"),
        _coordinate(-60, 91).cast("string").alias("lon_region"),
        F.when(F.col("p_partkey") % 34 != 0, F.concat(F.lit("Z"), F.col("p_partkey") % 50)).alias("zip_code"),
        F.when(F.col("p_size") != 13, F.col("p_type")).alias("unit_type"),
        line_number().alias("version"),
        F.col("l_orderkey").alias("source_order"),
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Untyped events: the order is both session and anonymous visitor, the supplier the user."""
    lines = table(spark, folder, "lineitem")
    ms = F.expr(
        "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) * 1000 + l_linenumber * 7"
    )
    user = F.when(F.col("l_linenumber") == 1, "  ").otherwise(
        F.concat(F.lit(" "), F.col("l_suppkey"))
    )
    return lines.select(
        user.alias("anonymized_user_id"),
        F.when(F.col("l_orderkey") % 10 != 0, F.concat(F.lit("a"), F.col("l_orderkey"))).alias(
            "anonymized_anonymous_id"
        ),
        F.concat(F.lit("s"), F.col("l_orderkey")).alias("anonymized_session_id"),
        F.concat(F.lit("L"), F.col("l_partkey")).alias("anonymized_listing_id"),
        F.when(F.col("l_linenumber") != 7, ms.cast("string")).otherwise("n/a").alias("collector_timestamp"),
        F.concat("l_returnflag", "l_linestatus").alias("event_type"),
        F.col("l_shipdate").cast("date").cast("string").alias("dt"),
        F.lit("browser").alias("browser_family"),
        line_number().alias("event_id"),
    )


def listing_versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("anonymized_listing_id"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.col("l_shipdate").alias("updated_at"),
        "l_orderkey",
        line_number().alias("version"),
        F.col("l_extendedprice").alias("price"),
    )


def benchmark_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as benchmark runs: the priority is the model, the customer bucket the data set."""
    key = F.col("o_orderkey")
    metric = F.when(key % 7 != 0, F.round(F.col("o_totalprice") / 1_000_000, 6))
    return table(spark, folder, "orders").select(
        F.concat(
            F.when(key % 3 == 0, "Eval_").otherwise(""),
            F.col("o_orderpriority"),
            F.lit("_"),
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.lit("_"),
            F.lpad(key.cast("string"), 9, "0"),
        ).alias("run_name"),
        F.concat(F.lit("r"), key).alias("run_id"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_custkey") % 40 != 39, F.concat(F.lit("d"), F.col("o_custkey") % 40)).alias("dataset"),
        (key % 3 == 0).alias("is_eval"),
        metric.alias("test_mrr@10"),
        F.round(metric * 2, 6).alias("test_hit@5"),
        F.round(metric * F.col("o_custkey") / 100_000, 6).alias("test_hit@10"),
    )
