"""Golden graphs and conservation of mass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feathergrid.operators import graph as G
from feathergrid.session import scratch_path
from feathergrid.sources import readers, writers


def frame(spark, links):
    return spark.createDataFrame([(s, d, w) for s, out in links.items() for d, w in out.items()], "src string, dst string, w long")


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


GOLDEN_11 = {
    "2": {"3": 1}, "3": {"2": 1}, "4": {"1": 1, "2": 1}, "5": {"4": 3, "2": 1, "6": 1}, "6": {"2": 1, "5": 2},
    "7": {"2": 1, "5": 1}, "8": {"2": 1, "5": 1}, "9": {"2": 1, "5": 1}, "10": {"5": 1}, "11": {"5": 1},
}


def test_published_five_node_graph(spark):
    published = "AB AD BC BE CD DE EA EB EC".split()
    df = spark.createDataFrame([(e[0], e[1], 1) for e in published], "src string, dst string, w long")
    got = ranks(G.power_iteration(df, 30))
    want = {"A": 0.10526316, "B": 0.15789474, "C": 0.18421053, "D": 0.23684211, "E": 0.31578947}
    assert got == pytest.approx(want, abs=1e-5)
    p = {(r["src"], r["dst"]): r["p"] for r in G.transition_matrix(df).collect()}
    for node in got:
        assert got[node] == pytest.approx(sum(got[s] * v for (s, d), v in p.items() if d == node), abs=1e-5)


def test_dangling_mass_leaks_without_and_stays_with_redistribution(spark):
    links = "AB AC AD BD BE CA CE DB".split()
    edges = spark.createDataFrame([(e[0], e[1], 1) for e in links], "src string, dst string, w long")
    assert sum(ranks(G.power_iteration(edges, 5)).values()) < 0.9
    assert sum(ranks(G.pagerank(edges, 5)).values()) == pytest.approx(1.0)
    assert [r["id"] for r in G.dangling_nodes(edges).collect()] == ["E"]


def test_eleven_node_pagerank(spark, monkeypatch):
    want = {"2": 0.3620640496, "3": 0.3339927005, "5": 0.0850639943, "4": 0.0603096351, "1": 0.0425574081, "6": 0.0313866235}
    want |= {str(i): 0.0169251178 for i in range(7, 12)}
    edges = frame(spark, GOLDEN_11)
    assert ranks(G.pagerank(edges, 20)) == pytest.approx(want, abs=1e-9)
    assert G.count_nodes(edges).first()["nodes"] == 11
    # splitting hot sources over salts does not change the ranks
    monkeypatch.setattr(G, "LINKS_PER_SALT", 1)
    assert ranks(G.pagerank(edges, 4)) == pytest.approx(ranks_plain(GOLDEN_11, 4), abs=1e-12)


def ranks_plain(links, steps, alpha=0.15):
    names = sorted(set(links) | {d for out in links.values() for d in out})
    x = dict.fromkeys(names, 1 / len(names))
    for _ in range(steps):
        mass = sum(v for n, v in x.items() if n not in links)
        new = dict.fromkeys(names, 0.0)
        for s, out in links.items():
            for d, w in out.items():
                new[d] += x[s] * w / sum(out.values())
        x = {n: alpha / len(names) + (1 - alpha) * (mass / len(names) + v) for n, v in new.items()}
    return x


def test_adjacency_text_splits_long_lines_and_reads_back(spark):
    edges = spark.range(50).select(F.lit(1).alias("src"), F.col("id").alias("dst"), (F.col("id") + 1).alias("w"))
    path = writers.write_adjacency_text(edges, scratch_path(spark, "adj"), per_line=8)
    assert spark.read.text(path).count() > 3
    back = readers.scan_adjacency_text(spark, path)
    assert sorted((int(r["dst"]), r["w"]) for r in back.collect()) == [(i, i + 1) for i in range(50)]


def test_vertices_and_parallel_edges(spark):
    v, e = G.vertices_edges_frames(frame(spark, GOLDEN_11))
    assert v.count() == 11
    assert e.where("src = '5' and dst = '4'").count() == 3


def test_pagerank_computes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 1, 1), (1, 3, 4)], "src long, dst long, w long")
    got = ranks(G.pagerank(edges.mapInArrow(passed, edges.schema), 3))
    assert seen.value == 4
    assert got == pytest.approx(ranks(G.pagerank(edges, 3)))
