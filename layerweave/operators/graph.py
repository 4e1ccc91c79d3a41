"""Layer graphs: adjacency, strength, edge patterns, PageRank and connected components.

A multi-layer network is one vertex table ``layer, id, ...`` and one edge table
``layer, src, dst, ...``; every operator works on all layers in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.layers import fit_edges
from layerweave.operators.ordering import dense_index
from layerweave.operators.skew import HotKeys, fits_broadcast, spread_join, tasks_for
from layerweave.session import cut_lineage, forget_table, keep_in_buckets, keep_table

LAYER = ("layer",)
# A bucket of edges by source holds so many times the rows of an ordinary task.
BUCKET_SHARE = 4


@dataclass(frozen=True)
class LayerGraph:
    """Vertices and edges of one or more layers."""

    vertices: DataFrame
    edges: DataFrame
    #: Options of the edge search, while the edges are what it finds among the vertices and are not stored.
    search: dict | None = None

    def persist(self) -> LayerGraph:
        level = StorageLevel.MEMORY_AND_DISK
        return LayerGraph(self.vertices.persist(level), self.edges.persist(level))

    def layer(self, name: str) -> LayerGraph:
        return LayerGraph(
            self.vertices.filter(F.col("layer") == name), self.edges.filter(F.col("layer") == name)
        )


def build_graph(people: DataFrame, **options) -> LayerGraph:
    """Vertices ``layer, id, z`` and the edges the layer rules give."""
    return LayerGraph(people, fit_edges(people, **options), options)


def repeated(vertices: DataFrame) -> bool:
    """Whether a vertex occurs more than once in a layer; those without an id have no edges and don't count."""
    counts = vertices.filter(F.col("id").isNotNull()).groupBy("layer", "id").agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > 1).isEmpty()


def adjacency(edges: DataFrame, weight: str = "fit") -> DataFrame:
    """Mean weight of every (layer, src, dst); absent cells are zero and are not stored."""
    return edges.groupBy("layer", "src", "dst").agg(F.avg(weight).alias(weight))


def adjacency_wide(vertices: DataFrame, edges: DataFrame, targets: Sequence, weight: str = "fit") -> DataFrame:
    """Export form of a block of columns: one row per vertex, one column per target id, zeros elsewhere.

    The caller names the targets, since a row holds as many columns as there are; a large graph is
    exported block by block, or keeps the coordinate form of ``adjacency``.
    """
    ids = list(targets)
    # Every vertex sends itself a NULL, so vertices without edges keep their row.
    cells = edges.filter(F.col("dst").isin(ids)).select(F.col("src").alias("id"), F.col("dst"), F.col(weight).alias("w")).unionByName(
        vertices.select("id", F.col("id").alias("dst"), F.lit(None).cast("double").alias("w"))
    )
    wide = cells.groupBy("id").pivot("dst", ids).agg(F.avg("w"))
    return wide.na.fill(0.0, [str(i) for i in ids])


def node_strength(edges: DataFrame, weight: str = "fit") -> DataFrame:
    """Sum of the weights of all edges that touch a node, whatever their direction."""
    ends = F.explode(F.array("src", "dst")).alias("id")
    touched = edges.select("layer", ends, weight)
    return touched.groupBy("layer", "id").agg(F.sum(weight).alias("strength"), F.count(F.lit(1)).alias("degree"))


def edge_pattern(graph: LayerGraph, attributes: Sequence[str], layers: Sequence[str] | None = None) -> DataFrame:
    """``(n)-[r]->(m)`` in the chosen layers: each edge with the attributes of both ends.

    Edges that are still to be searched take the attributes along; stored ones, and those of vertices that occur more than
    once in a layer, are joined with the vertices.
    """
    vertices, edges = graph.vertices, graph.edges
    if layers is not None:
        vertices, edges = vertices.filter(F.col("layer").isin(*layers)), edges.filter(F.col("layer").isin(*layers))
    if graph.search is not None:
        vertices = keep_table(vertices)
        if not repeated(vertices):
            return fit_edges(vertices, **graph.search, source_columns=attributes, target_columns=attributes)
    rows = vertices.count()
    if not fits_broadcast(rows, 2 + len(attributes)):
        edges = keep_table(edges)

    def with_end(df: DataFrame, name: str, other: str) -> DataFrame:
        end = vertices.select("layer", F.col("id").alias(name), *[F.col(a).alias(f"{name}_{a}") for a in attributes])
        return spread_join(df, end, ["layer", name], [F.col(other)], HotKeys(edges, ["layer", name]), rows)

    return with_end(with_end(edges, "src", "dst"), "dst", "src")


def indexed_edges(graph: LayerGraph, weight: str = "fit") -> tuple[DataFrame, DataFrame]:
    """Edges on dense indexes ``layer, i, j, value`` and the table ``id, idx`` (order of the ids).

    The edge search goes over the indexes where it is still to be done, so no edge is joined with them; edges meet for
    their mean only where a vertex occurs more than once in a layer.
    """
    index = dense_index(graph.vertices.select("id").distinct(), [F.col("id")])
    if graph.search is not None and weight == "fit":
        found = spread_join(graph.vertices.select("layer", "id", "z"), index, ["id"], [F.col("layer")], HotKeys(graph.vertices, ["id"]), index.count())
        found = keep_table(found.select("layer", F.col("idx").alias("id"), "z"))
        edges = fit_edges(found, **graph.search)
        cells = adjacency(edges, weight) if repeated(found) else edges
        return cells.select("layer", F.col("src").alias("i"), F.col("dst").alias("j"), F.col(weight).alias("value")), index
    cells = adjacency(graph.edges, weight)
    rows = index.select(F.col("id").alias("src"), F.col("idx").alias("i"))
    columns = index.select(F.col("id").alias("dst"), F.col("idx").alias("j"))
    total = index.count()
    if not fits_broadcast(total, 2):
        cells = keep_table(cells)
    cells = spread_join(cells, rows, ["src"], [F.col("dst")], HotKeys(cells, ["src"]), total)
    cells = spread_join(cells, columns, ["dst"], [F.col("src")], HotKeys(cells, ["dst"]), total)
    return cells.select("layer", "i", "j", F.col(weight).alias("value")), index


def out_weights(edges: DataFrame, by: Sequence[str] = LAYER, into: str = "src") -> DataFrame:
    """``by..., {into}, weight``: 1 / out-degree of every source."""
    return edges.groupBy(*by, F.col("src").alias(into)).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))


def transition_edges(edges: DataFrame, by: Sequence[str] = LAYER) -> DataFrame:
    """Edges with ``weight`` = 1 / out-degree of their source."""
    edges = keep_table(edges.select(*by, "src", "dst"))
    weights = cut_lineage(out_weights(edges, by))
    return spread_join(edges, weights, [*by, "src"], [F.col("dst")], HotKeys(edges, [*by, "src"]), weights.count())


class Hubs:
    """The sources with the most edges, as many as a broadcast holds: ``weights`` has ``by..., id, weight``.

    What they send goes to every task, so their edges need not lie by source: they lie by target, and what arrives at
    a target is added up before the shuffle.  No task gets all edges of a hub.
    """

    def __init__(self, weights: DataFrame, by: Sequence[str], walks: int = 1, columns: int = 2):
        self.by, self.weights = list(by), weights
        counts = weights.groupBy(self._level().alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per power of two
        self.lowest, self.rows, self.all = None, 0, True
        for row in sorted(counts, key=lambda r: -r["level"]):
            if not fits_broadcast((self.rows + row["n"]) * walks, columns):
                self.all = False
                break
            self.lowest, self.rows = row["level"], self.rows + row["n"]

    @staticmethod
    def _level() -> Column:
        return F.floor(-F.log2("weight"))

    def among(self) -> Column:
        """Whether a row with the ``weight`` of its vertex belongs to a hub."""
        return F.lit(False) if self.lowest is None else F.coalesce(self._level() >= F.lit(self.lowest), F.lit(False))

    def marked(self, edges: DataFrame, name: str = "hub") -> DataFrame:
        """Edges with a column that says whether a hub sends them."""
        if self.all or self.lowest is None:
            return edges.withColumn(name, F.lit(self.all))
        own = self.weights.filter(self.among()).select(*self.by, F.col("id").alias("src"), F.lit(True).alias(name))
        return edges.join(F.broadcast(own), [*self.by, "src"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))

    def by_target(self, edges: DataFrame, tasks: int) -> DataFrame | None:
        """The edges of hubs out of marked ones, kept by target."""
        if self.lowest is None:
            return None
        return keep_table(edges.filter("hub").drop("hub").repartition(tasks, *self.by, "dst"))


class Walk:
    """The repeated step of all PageRank forms: send each rank along the edges.

    What a vertex sends per edge travels with its rank, so a round is one join with the edges and one aggregate, in
    which arrivals are added up before the shuffle.  Edges are laid out once, those of hubs by target, all others in
    buckets by source, and no round moves them.
    """

    def __init__(
        self, edges: DataFrame, by: Sequence[str], tags: Sequence[str] = (), copies: str | None = None,
        weights: DataFrame | None = None,
    ):
        """``copies`` names a column that says how many parallel edges a row stands for; ``weights``
        (``by..., id, weight``) then tells what a vertex sends along one of them."""
        self.by, self.tags, self.copies = list(by), list(tags), copies
        self.edges = keep_table(edges.select(*by, "src", "dst", *([copies] if copies else [])))
        self.weights = cut_lineage(out_weights(self.edges, by, "id") if weights is None else weights)
        self.sources = self.weights.count()
        self.walks = 1

    @cached_property
    def laid(self) -> tuple[Hubs, DataFrame | None, DataFrame | None, HotKeys | None]:
        """Hubs, their edges, all other edges and the hot keys of those."""
        keys = [*self.by, "src"]
        hubs = Hubs(self.weights, self.by, self.walks, len(self.by) + len(self.tags) + 2)
        rows = self.edges.count()
        tasks = tasks_for(self.edges, rows)
        # An edge without a source is never sent.
        marked = hubs.marked(self.edges.dropna(subset=keys))
        own, rest, hot = hubs.by_target(marked, tasks), None, None
        if not hubs.all:
            # Arrivals are added up per bucket: wider buckets, fewer rows to shuffle.
            buckets = tasks_for(self.edges, rows, BUCKET_SHARE)
            rest = keep_in_buckets(marked.filter(~F.col("hub")).drop("hub").repartition(buckets, *keys), keys, buckets)
            hot = HotKeys(rest, keys)
        forget_table(self.edges)
        return hubs, own, rest, hot

    def step(self, ranks: DataFrame, base: DataFrame, damping: float) -> DataFrame:
        """``ranks`` and ``base`` hold ``by..., tags..., id, rank, weight``; ``base`` is what each vertex gets anyway."""
        hubs, own, rest, hot = self.laid
        keys = [*self.by, "src"]
        each = F.lit(damping) * F.col("rank") * F.col("weight")
        columns = [*self.by, *self.tags, F.col("id").alias("src"), each.alias("each")]
        senders = ranks.filter(F.col("weight").isNotNull())
        sent = []
        if own is not None:
            sent.append(own.join(F.broadcast(senders.filter(hubs.among()).select(*columns)), keys))
        if rest is not None:
            few = (self.sources - hubs.rows) * self.walks
            sent.append(spread_join(rest, senders.filter(~hubs.among()).select(*columns), keys, [F.col("dst")], hot, few))
        sent = reduce(DataFrame.unionByName, sent)
        amount = F.col("each") * F.col(self.copies) if self.copies else F.col("each")
        arrivals = sent.select(
            *self.by, *self.tags, F.col("dst").alias("id"), amount.alias("rank"), F.lit(None).cast("double").alias("weight")
        )
        columns = [*self.by, *self.tags, "id", "rank", "weight"]
        return arrivals.unionByName(base.select(*columns)).groupBy(*self.by, *self.tags, "id").agg(
            F.sum("rank").alias("rank"), F.max("weight").alias("weight")
        )

    def weighted(self, vertices: DataFrame, rank: float) -> DataFrame:
        """Every vertex with a starting rank and what it sends per edge (NULL without edges)."""
        return vertices.join(self.weights, [*self.by, "id"], "left").withColumn("rank", F.lit(float(rank)))

    def rounds(self, vertices: DataFrame, reset: float, iterations: int, cut_every: int) -> DataFrame:
        """Between two cuts the rounds are one plan."""
        nodes = cut_lineage(self.weighted(vertices, reset))
        ranks = nodes.withColumn("rank", F.lit(1.0))
        for done in range(1, iterations + 1):
            ranks = self.step(ranks, nodes, 1.0 - reset)
            if done % cut_every == 0 and done < iterations:
                ranks = cut_lineage(ranks)
        return ranks.drop("weight")

    def spread_out(self, start: DataFrame, reset: float, iterations: int, cut_every: int) -> DataFrame:
        """Rounds in which only the starting vertices get the reset, one walk per tag."""
        base = cut_lineage(start.withColumns({"rank": F.lit(float(reset)), "weight": F.lit(None).cast("double")}))
        self.walks = base.count()
        ranks = self.weighted(base.drop("rank", "weight"), 1.0)
        for done in range(1, iterations + 1):
            moved = self.step(ranks, base, 1.0 - reset).drop("weight")
            ranks = moved.join(self.weights, [*self.by, "id"], "left")
            if done % cut_every == 0 and done < iterations:
                ranks = cut_lineage(ranks)
        return ranks.drop("weight")


def _scaled(ranks: DataFrame, by: Sequence[str], total: Column) -> DataFrame:
    """Scale the ranks of each group so that they add up to ``total`` (an aggregate).

    The ranks are kept first, as they are read twice.  Without groups the factor is one number; with
    groups the ranks of a large one are spread over tasks, or the factors go to them if they are few.
    """
    ranks = cut_lineage(ranks)
    factor = (total / F.sum("rank")).alias("_factor")
    if not by:
        found = ranks.agg(factor).first()["_factor"]
        return ranks.withColumn("rank", F.col("rank") * F.lit(found))
    sums = cut_lineage(ranks.groupBy(*by).agg(factor))
    joined = spread_join(ranks, sums, by, [F.col("id")], HotKeys(ranks, by), sums.count())
    return joined.withColumn("rank", F.col("rank") * F.col("_factor")).drop("_factor")


def pagerank(
    vertices: DataFrame,
    edges: DataFrame,
    iterations: int = 10,
    reset: float = 0.15,
    by: Sequence[str] = LAYER,
    cut_every: int = 1,
) -> DataFrame:
    """PageRank with a fixed number of rounds: ``by..., id, rank``, ranks of a group add up to N."""
    ranks = Walk(edges, by).rounds(vertices.select(*by, "id").distinct(), reset, iterations, cut_every)
    return _scaled(ranks, by, F.count(F.lit(1)))


def pagerank_until(
    vertices: DataFrame,
    edges: DataFrame,
    tolerance: float = 0.01,
    reset: float = 0.15,
    by: Sequence[str] = LAYER,
    most_rounds: int = 200,
) -> DataFrame:
    """PageRank until no rank moves by more than ``tolerance``; ranks that do not settle are an error."""
    walk = Walk(edges, by)
    base = cut_lineage(walk.weighted(vertices.select(*by, "id").distinct(), reset))
    ranks = base.withColumn("rank", F.lit(1.0))
    for _ in range(most_rounds):
        latest = cut_lineage(walk.step(ranks, base, 1.0 - reset))
        before = ranks.select(*by, "id", F.col("rank").alias("_before"))
        moved = latest.join(before, [*by, "id"]).agg(F.max(F.abs(F.col("rank") - F.col("_before"))).alias("d")).first()["d"]
        ranks = latest
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"ranks still move by {moved} after {most_rounds} rounds")
    return _scaled(ranks.drop("weight"), by, F.count(F.lit(1)))


def personalized_pagerank(
    edges: DataFrame,
    sources: DataFrame,
    iterations: int = 10,
    reset: float = 0.15,
    by: Sequence[str] = LAYER,
    cut_every: int = 1,
) -> DataFrame:
    """PageRank seen from each source: ``by..., source, id, rank``; ranks of a source add up to 1.

    ``sources`` holds ``by..., id``.  Only vertices that a source reaches are kept.
    """
    start = sources.select(*by, F.col("id").alias("source"), "id").distinct()
    ranks = Walk(edges, by, ["source"]).spread_out(start, reset, iterations, cut_every)
    return _scaled(ranks, [*by, "source"], F.lit(1.0)).select(*by, "source", "id", "rank")


def run_ranking(graph: LayerGraph, algorithm: str = "pagerank", **options) -> LayerGraph:
    """Rank the vertices of a graph by name of the algorithm; an unknown name changes nothing."""
    if algorithm.lower() != "pagerank":
        import warnings

        warnings.warn(f"unknown ranking {algorithm!r}; the graph is unchanged", stacklevel=2)
        return graph
    ranks = pagerank_until(graph.vertices, graph.edges, **options)
    return LayerGraph(graph.vertices.join(ranks, ["layer", "id"], "left"), transition_edges(graph.edges))


def connected_components(
    vertices: DataFrame, edges: DataFrame, by: Sequence[str] = LAYER, most_rounds: int = 100
) -> DataFrame:
    """``by..., id, component``: the smallest id that a vertex is connected to, directions ignored.

    Alternating large-star and small-star rounds: the edge list never grows, and the number of
    rounds is logarithmic even for long chains.  A hub's rows are spread before its join.
    """
    keys = [*by, "u"]
    smaller, larger = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = keep_table(
        edges.filter(F.col("src") != F.col("dst")).select(*by, larger.alias("u"), smaller.alias("v")).distinct()
    )

    def settled(df: DataFrame) -> tuple[bool, int, int]:
        """Whether every vertex points at one root that points nowhere; pairs; vertices."""
        ends = df.select(*by, F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")),
        )).alias("end"))
        seen = ends.groupBy(*by, F.col("end.x")).agg(F.sum("end.up").alias("ups"), F.count(F.lit(1)).alias("n"))
        wrong = (F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1))
        row = seen.agg(F.coalesce(F.max(wrong.cast("int")), F.lit(0)).alias("wrong"), F.sum("ups").alias("rows"), F.count(F.lit(1)).alias("nodes")).first()
        return row["wrong"] == 0, row["rows"] or 0, row["nodes"]

    def towards_minimum(df: DataFrame, rows: int) -> DataFrame:
        """Add ``m``: the smallest neighbour of ``u`` or ``u`` itself."""
        lowest = df.groupBy(*keys).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return spread_join(df, lowest, keys, [F.col("v")], HotKeys(df, keys, rows), nodes)

    done, count, nodes = settled(pairs)
    for _ in range(most_rounds):
        if done:
            break
        both = pairs.unionByName(pairs.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            towards_minimum(both, 2 * count).filter(F.col("v") > F.col("u"))
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = cut_lineage(large)
        small = towards_minimum(large, count)
        rewired = small.filter(F.col("v") != F.col("m")).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy(*keys).agg(F.min("v").alias("v"))
        pairs = cut_lineage(rewired.unionByName(own).distinct())
        done, count, _ = settled(pairs)
    if not done:
        raise RuntimeError("components did not settle")
    roots = pairs.select(*by, F.col("u").alias("id"), F.col("v").alias("_root"))
    return vertices.select(*by, "id").join(roots, [*by, "id"], "left").select(
        *by, "id", F.coalesce("_root", "id").alias("component")
    )
