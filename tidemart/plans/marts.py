"""Dimensions, facts and marts over the retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, normalize_text, ratio_or, surrogate_key
from ..operators import history, segments
from ..session import written

Tables = dict[str, DataFrame]
MONEY = "decimal(28,6)"

#: The aspects that an order's lines can mention: aspect, its group, whether it is a complaint.
TAXONOMY = [("A-F", "accepted", False), ("N-F", "open", False), ("N-O", "open", False), ("R-F", "returned", True), ("R-O", "returned", True), ("A-O", "accepted", False)]
TAXONOMY_SCHEMA = "aspect string, aspect_group string, is_complaint boolean"


def taxonomy(t: Tables) -> DataFrame:
    return t["orders"].sparkSession.createDataFrame(TAXONOMY, TAXONOMY_SCHEMA)


def stg_customers(t: Tables) -> DataFrame:
    c, n = t["customer"], t["nation"]
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return joined.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), normalize_text(F.col("c_name")).alias("customer_name_normalized"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.col("c_mktsegment").alias("market_segment"))


def stg_orders(t: Tables) -> DataFrame:
    return t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").cast("timestamp_ntz").alias("ordered_at"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast(MONEY).alias("order_value"))


def stg_lines(t: Tables) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_extendedprice").cast(MONEY).alias("price"), (F.col("l_quantity").cast(MONEY)).alias("quantity"), "l_discount",
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("aspect"), F.col("l_shipdate").cast("timestamp_ntz").alias("shipped_at"),
    )


def dim_customers(t: Tables) -> DataFrame:
    """Type 2: a customer's priority class as observed through their orders."""
    return history.dimension(stg_orders(t), "customer_id", ["ordered_at", "order_id"], ["priority"])


def dim_parts(t: Tables) -> DataFrame:
    """Type 1, with a measure that is null where one of its factors is unknown."""
    p = t["part"]
    size = F.nullif(F.col("p_size"), F.lit(1))
    return p.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("part_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.when(size.isNotNull(), F.round(size * F.col("p_retailprice"), 2)).alias("size_value"))


def dim_suppliers(t: Tables) -> DataFrame:
    s, n = t["supplier"], t["nation"]
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return joined.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), (F.col("s_name") != normalize_text(F.col("s_name"))).alias("name_was_normalized"))


def order_economics(t: Tables) -> DataFrame:
    """Sums of an order's lines, and how many suppliers and parts they have.

    Lines are dealt by order once.  Sums are taken by order and supplier first, and parts counted by order and part, so all
    aggregations are plain hash ones over rows that stay where they are.
    """
    lines = stg_lines(t).select("order_id", "part_id", "supplier_id", "price", "quantity", "shipped_at").repartition("order_id")
    by_supplier = lines.groupBy("order_id", "supplier_id").agg(F.count("*").alias("_n"), F.sum("price").alias("_price"), F.sum("quantity").alias("_quantity"), F.max("shipped_at").alias("_shipped"))
    sums = by_supplier.groupBy("order_id").agg(
        F.sum("_n").alias("item_count"), F.count("supplier_id").alias("seller_count"), F.sum("_price").cast("decimal(38,6)").alias("items_value"), F.sum("_quantity").cast("decimal(38,6)").alias("units"), F.max("_shipped").alias("last_shipped_at")
    )
    parts = lines.groupBy("order_id", "part_id").agg(F.lit(1).alias("_one")).groupBy("order_id").agg(F.count("part_id").alias("product_count"))
    return sums.join(parts.hint("shuffle_hash"), "order_id")


def fct_orders(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """One row an order, with the customer version valid when it was placed; times
    that can't be (shipped before ordered is kept as a negative number) stay.  ``customers``: the dimension, if it is there already."""
    dated = history.asof_join(stg_orders(t).withColumnRenamed("priority", "_own"), customers or dim_customers(t), "customer_id", "ordered_at")
    joined = dated.join(order_economics(t), "order_id", "left")
    return joined.select(
        "order_id", "customer_id", F.col("sk").alias("customer_sk"), "version_number", "order_status", "ordered_at", "order_value",
        F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("seller_count", F.lit(0)).alias("seller_count"), F.coalesce("product_count", F.lit(0)).alias("product_count"),
        "items_value", "units", F.when(F.col("last_shipped_at").isNotNull(), day_diff(F.col("last_shipped_at"), F.col("ordered_at"))).alias("delivery_days"),
    )


def customer_rfm(t: Tables) -> DataFrame:
    return segments.rfm(stg_orders(t), "customer_id", "ordered_at", "order_value")


def order_aspects(t: Tables) -> DataFrame:
    """Aspects mentioned by an order's discounted lines, once a line: the fan-out is meant."""
    return stg_lines(t).where("l_discount > 0.05").select("order_id", "part_id", "aspect")


def fct_segment_aspect(t: Tables) -> DataFrame:
    """Every segment with every aspect, zeros filled in, over both denominators.

    One pass over orders and their lines: an order gives a row without an aspect for its segment's totals and
    one for each aspect that its reviewed lines mention.  What is left, a row for each segment and aspect, is written.
    """
    people = written(customer_rfm(t).select("customer_id", "rfm_segment"), "segments")
    lines = order_aspects(t).repartition("order_id")  # all that follows keeps to this partitioning
    lines = lines.distinct().groupBy("order_id", "aspect").agg(F.count("*").alias("lines"))
    seen = lines.groupBy("order_id").agg(F.collect_list(F.struct("aspect", "lines")).alias("seen"))
    owned = stg_orders(t).select("order_id", "customer_id").join(people, "customer_id").join(seen, "order_id", "left")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("aspect"), F.lit(None).cast("long").alias("lines")))
    rows = owned.select("rfm_segment", F.col("seen").isNotNull().alias("reviewed"), F.explode(F.concat(whole, F.coalesce("seen", F.array().cast("array<struct<aspect:string,lines:bigint>>")))).alias("x"))
    rows = rows.select("rfm_segment", "x.aspect", "x.lines", "reviewed", F.lit(0).alias("customer"))
    rows = rows.unionByName(people.select("rfm_segment", F.lit(1).alias("customer")), allowMissingColumns=True)  # a customer is a row of the segment's totals
    counted = rows.groupBy("rfm_segment", "aspect").agg(F.count_if(F.col("customer") == 0).alias("orders"), F.count_if("reviewed").alias("reviewed"), F.sum("lines").alias("lines"), F.sum("customer").alias("customers_in_segment"))
    counted = written(counted, "segment-aspects")
    totals = counted.where("aspect is null").select("rfm_segment", "customers_in_segment", F.col("orders").alias("orders_in_segment"), F.col("reviewed").alias("orders_with_review_text"))
    mentions = counted.where("aspect is not null").select("rfm_segment", "aspect", F.col("orders").alias("m"), F.col("lines").alias("l"))
    full = segments.complete_grid(totals, taxonomy(t)).join(F.broadcast(mentions), ["rfm_segment", "aspect"], "left")
    m = F.coalesce("m", F.lit(0))
    return full.select(
        "rfm_segment", "aspect", "aspect_group", "is_complaint", F.lit("v1").alias("label_version"), "customers_in_segment", "orders_in_segment", "orders_with_review_text",
        ratio_or(F.col("orders_with_review_text"), F.col("orders_in_segment"), 0.0, 100, 2).alias("coverage_pct"), m.alias("orders_mentioning"), F.coalesce("l", F.lit(0)).alias("lines_mentioning"),
        ratio_or(m, F.col("orders_with_review_text"), None, 100, 4).alias("rate_of_reviewed"), ratio_or(m, F.col("orders_in_segment"), None, 100, 4).alias("rate_of_all"),
    )


def event_dimension(t: Tables) -> DataFrame:
    """Type 2 over the event stream: runs of equal event types of each user."""
    return history.dimension(t["events"].select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["event_type"])


def events_as_of(t: Tables) -> DataFrame:
    """Events with the version valid at their time."""
    return history.asof_join(t["events"].select("event_id", "user_id", "ts", "value"), event_dimension(t), "user_id", "ts")


def part_key(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", surrogate_key(F.col("p_brand"), F.nullif(F.col("p_size"), F.lit(1))).alias("sk"))
