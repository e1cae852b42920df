"""Link graphs as edge tables ``(src, dst, w)`` with parallel-edge weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feathergrid.session import bucketed, remove_path, scratch_path

# fixed value: teleport probability
ALPHA = 0.15
# Links of one node handled by one task; a node with more is split over salts.
LINKS_PER_SALT = 1_000_000


def edges_from_adjacency(adjacency: DataFrame, node: str = "node", links: str = "links") -> DataFrame:
    return adjacency.select(F.col(node).alias("src"), F.explode(links).alias("dst", "w"))


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ids over sources and destinations."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def count_nodes(edges: DataFrame) -> DataFrame:
    return nodes(edges).agg(F.count("id").alias("nodes"))


def dangling_nodes(edges: DataFrame) -> DataFrame:
    """Ids that are linked to but link nowhere."""
    sources = edges.select(F.col("src").alias("id"))
    return edges.select(F.col("dst").alias("id")).join(sources, "id", "left_anti").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("degree"), F.sum("w").alias("links"))


def transition_matrix(edges: DataFrame) -> DataFrame:
    """Row-stochastic weights; totals come from an aggregate, so a hot source is combined early."""
    total = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    return edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("p"))


def _salted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transition edges with a salt, and per source its number of salts.

    Only a source with more than ``LINKS_PER_SALT`` links gets more than one
    salt, so ranks are copied for hot nodes alone.
    """
    degree = edges.groupBy("src").agg(
        F.sum("w").alias("_t"), F.ceil(F.count("dst") / LINKS_PER_SALT).cast("int").alias("salts")
    )
    joined = edges.join(degree, "src")
    out = joined.select(
        "src",
        F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"),
        "dst",
        (F.col("w") / F.col("_t")).alias("p"),
    )
    return out, degree.select(F.col("src").alias("id"), "salts")


def _received(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(id, got)``: what each node gets over its incoming links."""
    out = ranks.where(F.col("salts").isNotNull()).select(
        F.col("id").alias("src"), "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    along = links.join(out, ["src", "salt"])
    return along.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("p")).alias("got"))


def _iterate(edges: DataFrame, steps: int, alpha: float, teleport: bool) -> DataFrame:
    """x <- alpha/N + (1 - alpha) (m/N + sum x p), or x <- x P without teleport and dangling mass.

    The edges are computed once and written; links and nodes are written once as
    bucketed tables, so a step moves ranks and what they add up to, but no links.
    """
    spark = edges.sparkSession
    # degrees, links and nodes all come from the edges, which may be a join or an aggregate
    given = scratch_path(spark, "edges")
    edges.write.parquet(given)
    edges = spark.read.schema(edges.schema).parquet(given)
    raw_links, salts = _salted(edges)
    links = bucketed(raw_links, ["src", "salt"], "links")
    base = bucketed(nodes(edges).join(salts, "id", "left"), ["id"], "nodes")
    remove_path(spark, given)
    size = base.agg(F.count("id").alias("n")).first()["n"]
    ranks, before = base.withColumn("x", F.lit(1.0) / size), None
    for step in range(1, steps + 1):
        received = _received(links, ranks)
        flow = F.coalesce("got", F.lit(0.0))
        if teleport:
            mass = ranks.agg(F.coalesce(F.sum(F.when(F.col("salts").isNull(), F.col("x"))), F.lit(0.0)).alias("m"))
            flow = F.lit(alpha / size) + (1 - alpha) * (mass.scalar() / size + flow)
        ranks = base.join(received, "id", "left").select("id", "salts", flow.alias("x"))
        if step < steps:
            # the next step reads ranks twice, for the flow and for the dangling mass
            path = scratch_path(spark, "ranks")
            ranks.write.parquet(path)
            ranks = spark.read.schema(ranks.schema).parquet(path)
            if before:
                remove_path(spark, before)
            before = path
    return ranks.select("id", F.col("x").alias("rank"))


def power_iteration(edges: DataFrame, steps: int) -> DataFrame:
    """x <- xP from the uniform vector; a dangling node leaks its mass."""
    return _iterate(edges, steps, 0.0, False)


def pagerank(edges: DataFrame, steps: int, alpha: float = ALPHA) -> DataFrame:
    """``(id, rank)`` after ``steps`` steps; dangling mass is shared by all nodes and ranks sum to 1."""
    return _iterate(edges, steps, alpha, True)


def rank_with_titles(ranks: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """k highest ranks with their titles; only k rows are broadcast."""
    top = ranks.orderBy(F.desc("rank"), "id").limit(k)
    return titles.join(F.broadcast(top), "id", "inner")


def vertices_edges_frames(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex table and an edge table with one row per parallel edge."""
    repeated = edges.select(
        "src", "dst", F.explode(F.array_repeat(F.lit("links"), F.col("w").cast("int"))).alias("relationship")
    )
    return nodes(edges), repeated
