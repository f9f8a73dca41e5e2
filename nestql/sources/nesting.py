"""Nested views of flat tables: child rows as an array of objects on their parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nest(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str, fields: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """parent with an array `name` of the child rows of equal key, in order; an empty array where there are none.

    One shuffle of each side by the key; rows of one key meet in one task, as the array that they become does.
    """
    rows = gather(child, child_key, "__key", name, fields, order)
    kind = rows.schema[name].dataType
    return parent.join(rows, parent[parent_key] == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def gather(child: DataFrame, child_key: str, key: str, name: str, fields: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """The child rows of each key, null too, as an array `name` in order: every child row is in one array, and no array is empty."""
    sort = [F.col(o) if isinstance(o, str) else o for o in order or []]
    item = F.struct(*[F.col(f) for f in fields])
    keyed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(sort)], item.alias("item"))
    return child.groupBy(F.col(child_key).alias(key)).agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["item"]).alias(name))


def _text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("o_orderdate", _text("o_orderdate"))


_ORDER_FIELDS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]
_LINE_FIELDS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders."""
    return nest(read(spark, sf_dir, "customer"), _orders(spark, sf_dir), "c_custkey", "o_custkey", "orders", _ORDER_FIELDS, ["o_orderkey"])


def orders_by_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders by their customer's key, whether or not there is such a customer; customers without orders are no records."""
    return gather(_orders(spark, sf_dir), "o_custkey", "c_custkey", "orders", _ORDER_FIELDS, ["o_orderkey"])


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("l_shipdate", _text("l_shipdate"))
    return nest(_orders(spark, sf_dir), lines, "o_orderkey", "l_orderkey", "lines", _LINE_FIELDS, ["l_linenumber"])


def cust_orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, which have their lines."""
    return nest(read(spark, sf_dir, "customer"), _orders_lines(spark, sf_dir), "c_custkey", "o_custkey", "orders", [*_ORDER_FIELDS, "lines"], ["o_orderkey"])


def orders_lines_by_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their lines by their customer's key, as in orders_by_cust."""
    return gather(_orders_lines(spark, sf_dir), "o_custkey", "c_custkey", "orders", [*_ORDER_FIELDS, "lines"], ["o_orderkey"])


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their events and the history of their values."""
    events = read(spark, sf_dir, "events").where("user_id is not null")
    item = F.struct("ts", "event_id", "event_type", "value", "props")
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("e"))
    shaped = F.transform("e", lambda x: F.struct(x["event_id"].alias("event_id"), x["ts"].cast("string").alias("ts"), x["event_type"].alias("event_type"), x["value"].alias("value"), x["props"].alias("props")))
    return rows.select("user_id", shaped.alias("events"), F.transform("e", lambda x: x["value"]).alias("value_hist"))


def user_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a history of values for each type of event."""
    events = read(spark, sf_dir, "events").where("user_id is not null")
    hist = events.groupBy("user_id", "event_type").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("hist")
    )
    return hist.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "hist"))).alias("types"))


def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns."""
    rows = read(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
