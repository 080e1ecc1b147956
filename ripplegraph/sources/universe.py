"""The given tables as entity graphs: a star schema as containment and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.model import Graph, Snapshot, checkpointed

ROOT = "universe:"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(kind: str, *keys: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(k).cast("string") for k in keys])


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint").cast("string")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, up, text: a row for each row of the tables; ``up`` is what contains it."""
    t = lambda name: read(spark, sf_dir, name)
    text = lambda *c: F.concat_ws("|", *[x if isinstance(x, Column) else F.col(x).cast("string") for x in c])
    shape = lambda df, kind, keys, up, body: df.select(_id(kind, *keys).alias("id"), F.lit(kind).alias("kind"), up.alias("up"), body.alias("text"))
    parts = [
        shape(t("region"), "region", ["r_regionkey"], F.lit(ROOT), text("r_name")),
        shape(t("nation"), "nation", ["n_nationkey"], _id("region", "n_regionkey"), text("n_name")),
        shape(t("customer"), "customer", ["c_custkey"], _id("nation", "c_nationkey"), text("c_name", _cents("c_acctbal"), "c_mktsegment")),
        shape(t("supplier"), "supplier", ["s_suppkey"], _id("nation", "s_nationkey"), text("s_name", _cents("s_acctbal"))),
        shape(t("part"), "part", ["p_partkey"], F.lit(ROOT), text("p_name", "p_brand", "p_type", "p_size", _cents("p_retailprice"))),
        shape(t("orders"), "order", ["o_orderkey"], _id("customer", "o_custkey"), text("o_orderstatus", _cents("o_totalprice"), "o_orderpriority")),
        shape(t("lineitem"), "lineitem", _LINE, _id("order", "l_orderkey"), text(_cents("l_quantity"), _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"), "l_returnflag", "l_linestatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def snapshot(spark: SparkSession, sf_dir: str, captured: bool = False) -> Snapshot:
    """The tables as they are. Repeated line items are one entity, whose token covers all rows.

    ``captured`` writes entities with their tokens, and edges, once, for whoever goes over them
    more often than that.
    """
    every = rows(spark, sf_dir)
    root = spark.range(1).select(F.lit(ROOT).alias("id"), F.lit("universe").alias("kind"))
    line, orders, customer = (read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    needs = lambda kind, key: line.select(_id("lineitem", *_LINE).alias("src"), _id(kind, key).alias("dst"), F.lit("depends-on").alias("kind"))
    mentions = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(_id("order", "o_orderkey").alias("src"), _id("nation", "c_nationkey").alias("dst"), F.lit("mentions").alias("kind"))
    edges = every.select(F.col("up").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind")).union(needs("part", "l_partkey")).union(needs("supplier", "l_suppkey")).union(mentions)
    token = F.concat(F.lit("row:"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "\n")))
    edges, known = edges.distinct(), every.groupBy("id", "kind").agg(token.alias("token"))
    if captured:
        edges, known = checkpointed(edges), checkpointed(known)
    return Snapshot(Graph(root.union(known.select("id", "kind")), edges), known.select("id", "token"))


def edited(base: Snapshot) -> Snapshot:
    """A later snapshot: edited orders and parts, suppliers gone, and a new order for each nation."""
    g = base.graph
    number = F.regexp_extract("id", r":(\d+)", 1).try_cast("bigint")
    of = lambda kind, n: F.col("id").startswith(f"{kind}:") & (number % n == 0)
    gone = checkpointed(g.entities.where(of("supplier", 37)).select("id"))  # so that Spark knows its size
    fresh = g.entities.where("kind = 'nation'").select(F.concat(F.lit("order:new-"), F.regexp_extract("id", r":(\d+)", 1)).alias("id"), F.lit("order").alias("kind"), F.col("id").alias("_up"))
    entities = g.entities.join(gone, "id", "left_anti").union(fresh.select("id", "kind"))
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    edges = edges.select("src", "dst", "kind").union(fresh.select("_up", "id", F.lit("contains")))
    token = F.when(of("order", 97) | of("part", 211), F.concat("token", F.lit(":v2"))).otherwise(F.col("token"))
    return Snapshot(Graph(entities, edges), base.tokens.join(gone, "id", "left_anti").select("id", token.alias("token")), base.followed)
