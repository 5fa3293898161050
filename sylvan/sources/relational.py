"""Trees from tables: dialogues, sessions, orders, places and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.sources.nodes import flat_trees


def dialogues(conversations: DataFrame) -> DataFrame:
    """``conversation`` over its turns in order, each of its role's kind; ``system`` turns are extras."""
    rows = conversations.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"), "text", "turn", (F.col("role") == "system").alias("extra"))
    return flat_trees(rows, "conversation", ["turn"])


def sessions(events: DataFrame) -> DataFrame:
    """``session`` of each user over the events in order of time, each of its type's kind; ``error`` events are extras."""
    rows = events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("text"), "ts", "event_id", (F.col("event_type") == "error").alias("extra"))
    return flat_trees(rows, "session", ["ts", "event_id"])


def orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``order`` over fields ``status`` and ``priority`` and then its ``item`` nodes, by line, part and the rest."""
    own = lambda at, c: orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(c).alias("kind"), F.col(f"o_order{c}").alias("text"), F.lit(c).alias("field"), F.lit(at).alias("at"), *(F.lit(0).cast(k).alias(x) for x, k in (("line", "int"), ("part", "long"), ("supp", "long"), ("qty", "double"))))
    items = lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit("item").alias("kind"), F.col("l_partkey").cast("string").alias("text"), F.lit(None).cast("string").alias("field"), F.lit(2).alias("at"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"))
    items = items.join(orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    return flat_trees(own(0, "status").union(own(1, "priority")).union(items), "order", ["at", "line", "part", "supp", "qty"])


def lines(documents: DataFrame) -> DataFrame:
    """``document`` over its ``line`` nodes; blank lines are extras."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return flat_trees(rows.select("doc_id", F.lit("line").alias("kind"), "text", "at", (F.trim("text") == "").alias("extra")), "document", ["at"])


def places(region: DataFrame, nation: DataFrame) -> DataFrame:
    """``region`` over its ``nation`` nodes by key."""
    rows = nation.select(F.col("n_regionkey").alias("doc_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("text"), "n_nationkey")
    return flat_trees(rows, "region", ["n_nationkey"], all_docs=region.select("r_regionkey"))


def accounts(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """``account`` of each customer over the ``order`` nodes by key; finished orders are extras."""
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("text"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("extra"))
    return flat_trees(rows, "account", ["o_orderkey"], all_docs=customer.select("c_custkey"))
