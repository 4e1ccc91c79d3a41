"""Queries: sources, sinks, HTML items, keys and nested exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.functions import cleaning as C
from layerweave.operators.ordering import dense_index
from layerweave.plans.graph_queries import user_graph
from layerweave.plans.inputs import USER_EDGES, user_layers
from layerweave.plans.registry import query, table
from layerweave.plans.tensor_queries import SALES, sales_cells
from layerweave.session import scratch_path
from layerweave.sources import delimited as D
from layerweave.sources import tables as Tb
from layerweave.sources.html import html_items


@query("csv_fallback", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def csv_fallback(spark, folder):
    """Written with commas, read with a tab asked for: the reader falls back to the comma."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = D.write_csv(orders, scratch_path(spark, "orders"))
    return D.read_csv(spark, path, sep="\t", schema="o_orderkey long, o_custkey long, o_totalprice double")


@query("sorted_csv", "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def sorted_csv(spark, folder):
    """Rows written in total order as range-partitioned files; ``place`` is their place in the files."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = D.write_sorted_csv(customers, scratch_path(spark, "customers"), ["c_custkey"])
    return in_file_order(spark.read.csv(path, header=True, schema="c_custkey long, c_name string, c_acctbal double"))


def in_file_order(rows):
    """Add ``place``: rows counted through the files in the order of their names, lines in the order of each file."""
    file = F.col("_metadata.file_name")
    placed = rows.withColumns({"_file": file, "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    return dense_index(placed, [F.col("_file"), F.col("_start"), F.col("_line")], "place").drop("_file", "_start", "_line")


@query("table_append", "SELECT l_returnflag, count(*) AS lines FROM lineitem GROUP BY ALL")
def table_append(spark, folder):
    """A table written once, appended to, and read back."""
    path = scratch_path(spark, "lines")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    Tb.write_table(lines.filter(F.col("l_returnflag") == "A"), path, mode="overwrite")
    Tb.write_table(lines.filter(F.col("l_returnflag") != "A"), path, mode="append")
    return Tb.read_table(spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


@query("coordinate_text", f"WITH {SALES} SELECT i, j, k, value FROM sales")
def coordinate_text(spark, folder):
    """A tensor written as text lines and read back."""
    path = D.write_coordinates(sales_cells(spark, folder), scratch_path(spark, "cells"))
    return D.read_coordinates(spark, path)


@query(
    "factor_text",
    "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS f0, s_nationkey::DOUBLE AS f1, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier",
)
def factor_text(spark, folder):
    """Factor rows written as text in index order and read back."""
    rows = dense_index(table(spark, folder, "supplier"), [F.col("s_suppkey")]).select(
        "idx", F.col("s_acctbal").alias("f0"), F.col("s_nationkey").cast("double").alias("f1")
    )
    path = D.write_factor(rows, scratch_path(spark, "factor"), ["f0", "f1"])
    return in_file_order(spark.read.csv(path, sep=" ", schema="idx long, f0 double, f1 double"))


@query("layer_export", f"WITH {USER_EDGES} SELECT layer, count(*) AS edges, count(DISTINCT src) AS sources FROM edges GROUP BY layer")
def layer_export(spark, folder):
    """Vertices and edges exported by layer and read back."""
    graph = user_graph(spark, folder)
    paths = Tb.export_layers(graph.vertices, graph.edges, scratch_path(spark, "layers"))
    return Tb.read_table(spark, paths["edges"]).groupBy("layer").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources")
    )


@query(
    "store_nodes",
    f"WITH {USER_EDGES} SELECT layer, id::BIGINT AS id, 'user ' || id AS label, round(z::FLOAT::DOUBLE, 4) AS score, (18 + id % 50)::INT AS age, "
    "CASE id % 2 WHEN 0 THEN 'M' ELSE 'F' END AS sex, 'ZZZ' AS country FROM people",
)
def store_nodes(spark, folder):
    """Node rows in the shape a graph store loads."""
    people = user_layers(spark, folder).withColumns(
        {"name": F.concat(F.lit("user "), F.col("id")), "age": 18 + F.col("id") % 50,
         "sex": F.when(F.col("id") % 2 == 0, "M").otherwise("F"), "country": F.lit("ZZZ")}
    )
    return Tb.store_nodes(people).withColumn("score", F.round(F.col("score").cast("double"), 4))


@query(
    "store_edges",
    f"WITH {USER_EDGES} SELECT layer, src::BIGINT AS src, dst::BIGINT AS dst, 'INTERLOCK' AS type, round(fit::FLOAT::DOUBLE, 4) AS weight FROM edges",
)
def store_edges(spark, folder):
    """Relation rows in the shape a graph store loads, weighted by the fit."""
    return Tb.store_edges(user_graph(spark, folder).edges).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


_ENTITY_SQL = "{0}"
for _name, _character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_name}', '{_character}')"


def _plain_sql(text: str) -> str:
    return _ENTITY_SQL.format(f"regexp_replace({text}, '<[^>]*>', '', 'g')")


def _html_sql(heading: str) -> str:
    from layerweave.sources.html import BLOCKS

    clean = (
        "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style)\\b.*?</(script|style)\\s*>', '', 'g')"
    )
    cut = f"string_split(regexp_replace({clean}, '(?i)<{heading}(\\s[^>]*)?>', chr(1), 'g'), chr(1))"
    marked = (
        f"regexp_replace(regexp_replace(part, '(?i)<p(\\s[^>]*)?>', chr(1) || '+', 'g'), '(?i)</?({BLOCKS}|p)(\\s[^>]*)?/?>', chr(1), 'g')"
    )
    title = f"regexp_extract(part, '(?is)^(.*?)</{heading}\\s*>', 1)"
    return (
        f"WITH sections AS (SELECT page_id, unnest({cut}) AS part, generate_subscripts({cut}, 1) AS s FROM pages), "
        f"items AS (SELECT page_id, s, CASE WHEN s = 1 THEN '' ELSE lower({_plain_sql(title)}) END AS topic, "
        f"unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) AS n FROM sections) "
        "SELECT page_id, topic, (row_number() OVER (PARTITION BY page_id ORDER BY s, n) - 1)::INT AS place, "
        "trim(regexp_replace(regexp_replace(" + _plain_sql("substr(piece, 2)") + ", '\\d+\\. ', '', 'g'), '\\s+', ' ', 'g')) AS goal "
        "FROM items WHERE starts_with(piece, '+')"
    )


@query("html_items", _html_sql("h1"))
def html_item_rows(spark, folder):
    """Paragraphs under their heading in every page."""
    return html_items(table(spark, folder, "pages"), "page_id", "html", heading="h1")


@query("dense_ids", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS idx FROM part")
def dense_ids(spark, folder):
    """0..N-1 in the order of name and key, without a global window."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return dense_index(parts, [F.col("p_name"), F.col("p_partkey")])


@query(
    "null_handling",
    "WITH sums AS (SELECT c_custkey, count(o_orderkey) AS orders, sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' "
    "THEN CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) "
    "SELECT c_custkey, orders, coalesce(spent, -1) AS spent, spent IS NOT NULL AS complete FROM sums",
)
def null_handling(spark, folder):
    """Orders of every customer and the amount of the urgent closed ones, NULL without any.

    Unknown amounts are filled with -1; ``complete`` says whether the any-NULL drop keeps the row.
    """
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    spent = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.when(urgent, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("spent")
    )
    joined = table(spark, folder, "customer").select("c_custkey").join(spent, "c_custkey", "left").na.fill(0, ["orders"])
    complete = joined.na.drop().withColumn("complete", F.lit(True))
    rest = joined.filter(F.col("spent").isNull()).withColumn("complete", F.lit(False))
    return complete.unionByName(rest).na.fill(-1.0, ["spent"])


@query(
    "geo_key",
    "SELECT c_custkey, r_regionkey || c_nationkey AS geoid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def geo_key(spark, folder):
    """Key parts before the underscore, joined to one code."""
    regions = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.concat_ws("_", F.col("r_regionkey").cast("string"), "r_name").alias("state")
    )
    nations = table(spark, folder, "nation").join(regions, "n_regionkey").select(
        F.col("n_nationkey").alias("c_nationkey"), "state",
        F.concat_ws("_", F.col("n_nationkey").cast("string"), F.lit("NATION")).alias("county"),
    )
    customers = table(spark, folder, "customer").join(nations, "c_nationkey")
    return customers.select("c_custkey", C.geo_key(F.col("state"), F.col("county")).alias("geoid"))


@query(
    "nested_record",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, user_id || '_' || event_id AS geoid, '{\"kind\":\"' || event_type || '\",\"cents\":' || "
    "round(value * 100)::BIGINT || '}' AS value FROM events WHERE ts >= '2024-01-08' AND ts < '2024-01-09'",
)
def nested_record(spark, folder):
    """The records of one day as nested values, in time order; the day reaches the scan as a range."""
    events = table(spark, folder, "events").filter((F.col("ts") >= "2024-01-08") & (F.col("ts") < "2024-01-09"))
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return events.orderBy("ts").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("geoid"),
        F.to_json(F.struct(F.col("event_type").alias("kind"), cents)).alias("value"),
    )
