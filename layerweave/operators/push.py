"""Ranks by residuals: only vertices that still move send, and only along their own edges.

Every vertex holds what it has settled and a residual that has yet to be spread.  A round takes the vertices whose
residual is above a bound, adds it to their rank and sends its damped share along their edges.  The edges lie in
buckets by their source, and a round reads the buckets of its senders; edges of settled vertices are not sent again.
While most buckets have senders, the edges of hubs are read by target instead, and what they send is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.graph import BUCKET_SHARE, LAYER, Hubs, _scaled, out_weights
from layerweave.operators.skew import HotKeys, fits_broadcast, spread_join, tasks_for
from layerweave.session import cut_lineage, forget_table, keep_in_buckets, keep_table

# Folders over which the edges are dealt; a round lists them at most.
BUCKETS = 64


class EdgeBuckets:
    """``by..., src, dst`` in folders and buckets by a hash of the source, and what a source sends along each edge.

    The edges of hubs are kept a second time, by target, for rounds in which most folders have senders.
    """

    def __init__(self, edges: DataFrame, by: Sequence[str]):
        self.by, keys = list(by), [*by, "src"]
        listed = keep_table(edges.select(*by, "src", "dst"))
        rows = listed.count()
        self.tasks = max(BUCKETS, tasks_for(listed, rows, BUCKET_SHARE))
        self.weights = cut_lineage(out_weights(listed, by, "id"))
        self.sources = self.weights.count()
        self.hubs = Hubs(self.weights, by, 1, len(keys) + 2)
        marked = self.hubs.marked(listed)
        self.of_hubs = self.hubs.by_target(marked.dropna(subset=keys), self.tasks)
        # A task holds one bucket and one folder.
        placed = marked.withColumn("bucket", self._folder(*keys)).repartition(self.tasks, *keys)
        self.rows = keep_in_buckets(placed, keys, self.tasks, ["bucket"])
        self.hot = HotKeys(self.rows, keys)
        forget_table(listed)

    def _folder(self, *keys: str) -> Column:
        return F.pmod(F.pmod(F.hash(*keys), F.lit(self.tasks)), F.lit(BUCKETS)).cast("int")

    def bucket(self) -> Column:
        return self._folder(*self.by, "id")

    def of(self, buckets: Sequence[int], hubs: bool = True) -> DataFrame:
        """The edges of some buckets, with those of hubs or without; other folders are not read."""
        found = self.rows.filter(F.col("bucket").isin(list(buckets)))
        return (found if hubs else found.filter(~F.col("hub"))).drop("bucket", "hub")

    def carried(self, senders: DataFrame, buckets: Sequence[int], rows: int, hub_rows: int) -> DataFrame:
        """Edges with what ``senders`` (``by..., src, hub, each``) send along them.  Few folders are read for themselves."""
        keys, spread_by = [*self.by, "src"], [F.col("dst")]
        if self.of_hubs is None or len(buckets) <= BUCKETS // 2 or not fits_broadcast(hub_rows, len(senders.columns) - 1):
            return spread_join(self.of(buckets), senders.drop("hub"), keys, spread_by, self.hot, rows)
        own = self.of_hubs.join(F.broadcast(senders.filter("hub").drop("hub")), keys)
        if self.hubs.all:
            return own
        others = senders.filter(~F.col("hub")).drop("hub")
        return own.unionByName(spread_join(self.of(buckets, hubs=False), others, keys, spread_by, self.hot, rows - hub_rows))


def spread(
    edges: EdgeBuckets, start: DataFrame, bound: float, per_edge: bool, damping: float = 0.85, tags: Sequence[str] = (), most_rounds: int = 500
) -> tuple[DataFrame, list[int]]:
    """``by..., tags..., id, rank, rest`` from residuals ``by..., tags..., id, rest``, and the number of senders per round.

    A vertex sends while its residual is above ``bound``; with ``per_edge`` while the residual per edge is.  Nothing left
    is above the bound at the end, so a rank is too small by what the residuals would still bring, at most their sum
    times damping / (1 - damping) besides its own.
    """
    by, keys = edges.by, [*edges.by, *tags, "id"]
    weight = F.coalesce("weight", F.lit(1.0))
    moves = F.col("rest") * weight > F.lit(bound) if per_edge else F.col("rest") > F.lit(bound)

    def weighed(rows: DataFrame) -> DataFrame:
        return spread_join(rows, edges.weights, [*by, "id"], [F.xxhash64(*keys)], HotKeys(rows, [*by, "id"]), edges.sources, "left")

    first = start.groupBy(*keys).agg(F.sum("rest").alias("rest")).withColumn("rank", F.lit(0.0))
    state = keep_table(weighed(first).select(*keys, "rank", "rest", "weight"))
    sent: list[int] = []
    for _ in range(most_rounds):
        hub = edges.hubs.among()
        counts = state.filter(moves).groupBy(edges.bucket().alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(hub.cast("long")).alias("hubs")).collect()  # a row per bucket
        if not counts:
            return state.select(*keys, "rank", "rest"), sent
        sent.append(sum(r["n"] for r in counts))
        senders = state.filter(moves & F.col("weight").isNotNull()).select(
            *by, *tags, F.col("id").alias("src"), hub.alias("hub"), (F.lit(damping) * F.col("rest") * F.col("weight")).alias("each"))
        carried = edges.carried(senders, [r["bucket"] for r in counts], sent[-1], sum(r["hubs"] for r in counts))
        arrived = weighed(carried.groupBy(*by, *tags, F.col("dst").alias("id")).agg(F.sum("each").alias("rest")))
        stayed = state.select(*keys, (F.col("rank") + F.when(moves, F.col("rest")).otherwise(0.0)).alias("rank"), F.when(moves, 0.0).otherwise(F.col("rest")).alias("rest"), "weight")
        both = stayed.unionByName(arrived.select(*keys, F.lit(0.0).alias("rank"), "rest", "weight"))
        after = keep_table(both.groupBy(*keys).agg(F.sum("rank").alias("rank"), F.sum("rest").alias("rest"), F.max("weight").alias("weight")))
        forget_table(state)
        state = after
    raise RuntimeError(f"residuals are still above {bound} after {most_rounds} rounds")


def pagerank_by_residuals(
    vertices: DataFrame, edges: DataFrame, tolerance: float = 0.01, reset: float = 0.15, by: Sequence[str] = LAYER
) -> tuple[DataFrame, list[int]]:
    """PageRank until no vertex has more than ``tolerance`` left to add: ``by..., id, rank``, a group adds up to N."""
    start = vertices.select(*by, "id").distinct().withColumn("rest", F.lit(float(reset)))
    ranks, sent = spread(EdgeBuckets(edges, by), start, tolerance, False, 1.0 - reset)
    return _scaled(ranks.drop("rest"), by, F.count(F.lit(1))), sent


def push_from(
    edges: DataFrame, sources: DataFrame, bound: float = 1e-5, reset: float = 0.15, by: Sequence[str] = LAYER
) -> tuple[DataFrame, list[int]]:
    """Personalized PageRank of many sources at once: ``by..., source, id, rank`` of the vertices that were reached.

    ``sources`` holds ``by..., id``.  A residual stays where it is once its share per edge is below ``bound``, so the cost
    follows the neighbourhoods of the sources and not the graph; ranks are below the exact ones by at most
    ``bound`` times the degree, summed over the walk.
    """
    start = sources.select(*by, F.col("id").alias("source"), "id").distinct().withColumn("rest", F.lit(float(reset)))
    ranks, sent = spread(EdgeBuckets(edges, by), start, bound, True, 1.0 - reset, ["source"])
    return ranks.filter(F.col("rank") > 0).select(*by, "source", "id", "rank"), sent
