"""Bytes of written edges: all pairs are listed, so what a row takes in a file decides the disk they need."""

import pytest
from pyspark.sql import functions as F

from layerweave.operators import layers as L
from layerweave.plans.queries import QUERIES
from layerweave.sources import tables as Tb


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    people, users = spark.range(2500), spark.range(900)
    people.select(F.col("id").alias("c_custkey"), ((F.col("id") * 7919) % 250 * 44.0 - 999).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    spent = F.round(F.log(6000.0 / ((F.col("id") * 7919) % 6000 + 0.5)) * 20.0).alias("o_totalprice")
    spark.range(6000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), spent).write.parquet(f"{folder}/orders.parquet")
    kinds = F.array(*[F.lit(kind) for kind in ("view", "click", "purchase", "signup", "error")])
    events = users.select(F.col("id").alias("user_id"), F.posexplode(kinds).alias("n", "event_type"))
    value = ((F.col("user_id") * 7919 + F.col("n") * 131) % 100).cast("double").alias("value")
    events.select("user_id", "event_type", value).write.parquet(f"{folder}/events.parquet")
    return folder


def bytes_a_row(spark, path):
    """Bytes of the files below a folder for each of their rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() / spark.read.parquet(path).count()


@pytest.mark.parametrize("name", ["adjacency_coo", "layer_edges_csn", "layer_edges_ext", "layer_edges_neu", "layer_edges_opn", "multilayer_edges", "store_edges", "layer_edges_default", "simple_edges", "layer_edges_agr", "transition_edges"])
def test_written_edges_are_runs_and_repeated_lists(spark, tables, tmp_path, name):
    """They took one to two bytes a row."""
    QUERIES[name](spark, tables).write.parquet(str(tmp_path / "out"))
    assert bytes_a_row(spark, str(tmp_path / "out")) < 0.5


def test_lists_hold_everyone_once(spark):
    """Also where many share a score, an id or both, and those without either are left out."""
    rows = spark.createDataFrame(
        [("OPN", n % 5, 0.25) for n in range(300)] + [("AGR", n, n * 0.01) for n in range(40)] + [("OPN", None, 1.0), ("AGR", 7, None), (None, 1, 1.0), ("LONE", 1, 1.0)],
        "layer string, id long, z double",
    )
    edges = L.layer_edges(rows, {"OPN": L.LayerRule((L.Band(0.0),), L.BOTH), "AGR": L.LayerRule((L.Band(0.0),), L.DOWN)}, block_rows=7)
    found = {r["layer"]: r["count"] for r in edges.groupBy("layer").count().collect()}
    assert found == {"OPN": 300 * 240, "AGR": 40 * 39 // 2}


def test_layer_folders_are_written_in_the_order_of_the_search(spark, tables, tmp_path):
    """Edges were sorted by layer on the way; the setting that spares it is as before afterwards."""
    from layerweave.plans.graph_queries import user_graph

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, graph, seen = spark.conf.get(name), user_graph(spark, tables), []
    with Tb._open_folders(spark, Tb.OPEN_FOLDERS):
        seen.append(spark.conf.get(name))
    paths = Tb.export_layers(graph.vertices, graph.edges, str(tmp_path / "layers"))
    assert seen == [str(Tb.OPEN_FOLDERS)] and spark.conf.get(name) == before
    assert bytes_a_row(spark, paths["edges"]) < 0.5
    found = {r["layer"]: r["count"] for r in spark.read.parquet(paths["edges"]).groupBy("layer").count().collect()}
    assert found == {r["layer"]: r["count"] for r in graph.edges.groupBy("layer").count().collect()}
