"""Graph queries on the customer/supplier link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators import graph as G
from feathergrid.operators import rows as R
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import scratch_path, table
from feathergrid.sources import readers, writers

E = f"e as materialized (select src, dst, w::bigint as w from ({roles.LINKS_SQL}))"
NODES = "n as materialized (select distinct id from (select src as id from e union all select dst from e))"
P = "p as materialized (select src, dst, w / sum(w) over (partition by src) as p from e)"


@query("g1_edges_from_adjacency", f"with {E} select src, dst, w from e")
def g1(spark, d):
    path = writers.write_adjacency_text(roles.links(spark, d), scratch_path(spark, "links"))
    lines = spark.read.text(path)
    adjacency = lines.select(
        F.split_part("value", F.lit("\t"), F.lit(1)).alias("node"),
        readers.parse_adjacency(F.col("value")).alias("links"),
    )
    edges = G.edges_from_adjacency(adjacency)
    return edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "w")


@query("g2_count_nodes", f"with {E}, {NODES} select count(*) as nodes from n")
def g2(spark, d):
    return G.count_nodes(roles.links(spark, d))


@query("g3_dangling_nodes", f"with {E}, {NODES} select id from n where id not in (select src from e)")
def g3(spark, d):
    return G.dangling_nodes(roles.links(spark, d))


@query(
    "g4_out_degree_top",
    f"""with {E}, o as (select src as id, count(*) as degree, sum(w)::bigint as links from e group by 1)
        select id, degree, links, (select round(avg(degree), 6) from o) as mean_degree from o
        order by degree desc, id limit 10""",
)
def g4(spark, d):
    degree = G.out_degree(roles.links(spark, d))
    top = R.top_k(degree, [F.desc("degree"), F.col("id")], 10)
    return top.withColumn("mean_degree", degree.agg(F.round(F.avg("degree"), 6)).scalar())


@query(
    "g4_out_degree_sample",
    f"""with {E}, o as (select src as id, count(*) as degree, sum(w)::bigint as links from e group by 1)
        select * from o order by md5('3:' || cast(id as varchar)), id limit 100""",
)
def g4b(spark, d):
    return R.sample_n(G.out_degree(roles.links(spark, d)), ["id"], 100, seed=3)


@query("g5_transition_matrix", f"with {E}, {P} select src, dst, round(p, 9) as p from p")
def g5(spark, d):
    return G.transition_matrix(roles.links(spark, d)).withColumn("p", F.round("p", 9))


def _power_sql(steps):
    ctes = [f"x0 as materialized (select id, 1.0::double / (select count(*) from n) as x from n)"]
    for i in range(1, steps + 1):
        ctes.append(
            f"x{i} as materialized (select n.id, coalesce(sum(x * p), 0) as x from n left join p on p.dst = n.id "
            f"left join x{i - 1} on x{i - 1}.id = p.src group by 1)"
        )
    return f"with {E}, {NODES}, {P}, {', '.join(ctes)} select id, round(x, 12) as rank from x{steps}"


def _pagerank_sql(steps):
    ctes = ["x0 as materialized (select id, 1.0::double / (select count(*) from n) as x from n)"]
    for i in range(1, steps + 1):
        prev = f"x{i - 1}"
        mass = f"(select coalesce(sum(x), 0) from {prev} where id not in (select src from e))"
        ctes.append(
            f"x{i} as materialized (select n.id, 0.15 / (select count(*) from n) + 0.85 * ({mass} / (select count(*) from n) "
            f"+ coalesce(sum({prev}.x * p), 0)) as x from n left join p on p.dst = n.id "
            f"left join {prev} on {prev}.id = p.src group by n.id)"
        )
    return f"with {E}, {NODES}, {P}, {', '.join(ctes)}"


@query("g6_power_iteration", _power_sql(4))
def g6(spark, d):
    return G.power_iteration(roles.links(spark, d), 4).withColumn("rank", F.round("rank", 12))


@query("g7_pagerank", _pagerank_sql(10) + " select id, round(x, 12) as rank from x10")
def g7(spark, d):
    return G.pagerank(roles.links(spark, d), 10).withColumn("rank", F.round("rank", 12))


@query(
    "g8_rank_with_titles",
    _pagerank_sql(3)
    + """ select id, title, round(x, 12) as rank from (select * from x3 order by round(x, 12) desc, id limit 20) join
        (select c_custkey as id, c_name as title from customer union all
         select 1000000000 + s_suppkey, s_name from supplier) using (id)""",
)
def g8(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("title"))
    ranks = G.pagerank(roles.links(spark, d), 3).withColumn("rank", F.round("rank", 12))
    return G.rank_with_titles(ranks, c.unionByName(s), 20)


@query(
    "g9_vertices_edges_frames",
    f"""with {E}, {NODES} select 'vertex' as kind, id as src, -1 as dst, '' as relationship from n union all
        select 'edge', src, dst, 'links' from (select src, dst, unnest(range(w)) as i from e)""",
)
def g9(spark, d):
    v, e = G.vertices_edges_frames(roles.links(spark, d))
    vertices = v.select(
        F.lit("vertex").alias("kind"),
        F.col("id").alias("src"),
        F.lit(-1).cast("bigint").alias("dst"),
        F.lit("").alias("relationship"),
    )
    return vertices.unionByName(e.select(F.lit("edge").alias("kind"), "src", "dst", "relationship"))
