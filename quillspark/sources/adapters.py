"""The driver's tables as contexts, graphs, logs and metric maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import kind_for_role
from ..session import share_package
from ..storage import merged, saved

ITEMS = ("context_id", "pos", "kind", "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time as a transcript with all kinds of items."""
    value = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.when(F.col("event_type").isin("click", "error"), "tool_output").when(F.col("event_type") == "view", "user_message")
    content = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("paid $"), value))
        .when(F.col("event_type") == "error", F.concat(F.lit("exit code "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "click", F.lit("ok"))
        .when(F.col("event_type") == "view", F.concat(F.lit("view "), F.col("props")))
        .otherwise(F.lit("joined"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("context_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("pos"),
        kind.when(F.col("event_type") == "signup", "system").otherwise("agent_message").alias("kind"),
        content.alias("content"),
    )


def documents_context(spark: SparkSession, sf_dir: str, kind: str = "tool_output") -> DataFrame:
    """Each source's documents in the order of their ids. There are few sources: one sort by range deals their texts out, and only
    how many rows of a source each part has is summed up."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("context_id"), "doc_id", "text")
    ordered = saved(docs.orderBy("context_id", "doc_id").select("context_id", "text", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    before = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(F.col("context_id").alias("_c"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # written, so that Spark sees how few they are
    sizes = saved(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")), "sizes")
    found = ordered.join(sizes, (F.col("_part") == F.col("_p")) & F.col("context_id").eqNullSafe(F.col("_c")))
    return found.select("context_id", (F.col("_at") + F.col("_start")).alias("pos"), F.lit(kind).alias("kind"), F.col("text").alias("content"))


def conversations_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("context_id"), F.col("turn").alias("pos"), kind_for_role(F.col("role")).alias("kind"), F.col("text").alias("content")
    )


def star_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions hold nations, nations hold customers and suppliers, suppliers call parts, customers test parts."""
    t = lambda name: table(spark, sf_dir, name)
    named = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    def nodes_of(name: str, key: str, label: str) -> DataFrame:
        return t(name).select(named(name, key).alias("id"), F.lit(name).alias("kind"), F.col(label).alias("name"))

    def edges_of(df: DataFrame, source, target, kind: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    nodes = nodes_of("region", "r_regionkey", "r_name")
    for name, key, label in (("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        nodes = nodes.unionByName(nodes_of(name, key, label))
    lines = t("lineitem")
    bought = merged(lines, t("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("o_custkey", "l_partkey").distinct()
    edges = edges_of(t("nation"), named("region", "n_regionkey"), named("nation", "n_nationkey"), "contains")
    edges = edges.unionByName(edges_of(t("customer"), named("nation", "c_nationkey"), named("customer", "c_custkey"), "contains"))
    edges = edges.unionByName(edges_of(t("supplier"), named("nation", "s_nationkey"), named("supplier", "s_suppkey"), "contains"))
    edges = edges.unionByName(edges_of(lines.select("l_suppkey", "l_partkey").distinct(), named("supplier", "l_suppkey"), named("part", "l_partkey"), "calls"))
    edges = edges.unionByName(edges_of(bought, named("customer", "o_custkey"), named("part", "l_partkey"), "tests"))
    return nodes, edges


def page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages by the path of their URL, and their links; a link to a path that no page has is unresolved."""
    pages = table(spark, sf_dir, "pages")
    nodes = pages.select("page_id", F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1).alias("path"))
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return nodes, links


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document as a repeat with a metric map; its language is the condition."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    metrics = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("condition"), F.col("doc_id").alias("rep"), metrics.alias("metrics"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only log of records with a status; every seventh record replaces the one three before it."""
    id = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        id.alias("id"),
        F.col("event_type").alias("record_type"),
        F.col("user_id"),
        F.when(F.col("value") < 20, "rejected").otherwise("active").alias("status"),
        F.when((id % 7 == 0) & (id >= 3), id - 3).alias("supersedes"),
        F.col("ts"),
        F.col("props").alias("payload"),
    )
