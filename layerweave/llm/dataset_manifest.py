"""Merkle manifest of a dataset: one tree over the rows of every group, one over the groups, proofs for every row.

Nodes carry nested-interval labels: the half-open interval of leaf ranks they cover.  A node's ancestors are the nodes
whose intervals contain its own, and its siblings are what its parent's interval holds besides.  Four levels of a tree
lie together in one row of a block table, so a block of 81 nodes is grouped once and not once per level; blocks meet the
blocks above them in a containment join that is bucketed by the width of their level.  Everything is built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.ordering import dense_index
from layerweave.operators.skew import HotKeys, spread_join
from layerweave.session import keep_table

# Children of a node, and levels that one row of a block table spans.
FANOUT = 3
DEPTH = 4
BLOCK = FANOUT ** DEPTH
SIDES = "array<struct<left:string, right:string>>"


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 in lower hex over the values: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _blocks(nodes: DataFrame, stratum: int) -> DataFrame:
    """``tree, size, bucket, level0..level4, whole, top`` from ``tree, size, node``: nodes with their intervals.

    ``whole`` says that the block is its whole tree; ``top`` is its one highest node.
    """
    width = F.lit(BLOCK ** (stratum + 1))
    rows = nodes.groupBy("tree", "size", F.expr(f"node.lo div {BLOCK ** (stratum + 1)}").alias("bucket")).agg(F.sort_array(F.collect_list("node")).alias("level0"))
    # Which block is its whole tree is known from the sizes alone.
    rows = rows.withColumn("whole", F.col("size") <= width)
    top = F.col("level0")[0]
    for level in range(1, DEPTH + 1):
        below = F.col(f"level{level - 1}")

        def parent(first: Column) -> Column:
            run = F.slice(below, first * FANOUT + 1, F.lit(FANOUT))
            return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(_joined(run), 256).alias("digest"))

        done = F.col("whole") & (F.size(below) <= 1)
        made = F.transform(F.sequence(F.lit(0), F.expr(f"(size(level{level - 1}) - 1) div {FANOUT}")), parent)
        rows = rows.withColumn(f"level{level}", F.when(~done, made).otherwise(F.array().cast("array<struct<lo:long, hi:long, digest:string>>")))
    bare = F.struct(top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"))
    for level in range(1, DEPTH + 1):
        bare = F.when(F.size(f"level{level}") > 0, F.col(f"level{level}")[0]).otherwise(bare)
    return rows.withColumn("top", bare)


def _sides(x: Column) -> Column:
    """The path of a node of ``level0`` inside its block: at every level the digests left and right of it in its parent."""
    steps = []
    for level in range(DEPTH):
        here, above = F.col(f"level{level}"), F.col(f"level{level + 1}")
        parent = F.filter(above, lambda p: (p["lo"] <= x["lo"]) & (x["hi"] <= p["hi"]))[0]
        left = F.filter(here, lambda c: (c["lo"] >= parent["lo"]) & (c["hi"] <= x["lo"]))
        right = F.filter(here, lambda c: (c["lo"] >= x["hi"]) & (c["hi"] <= parent["hi"]))
        steps.append(F.when(F.size(above) > 0, F.struct(_joined(left).alias("left"), _joined(right).alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


class Forest:
    """Trees over ranked leaves: ``tree, size, rank, digest`` and any ``payload`` columns that proofs carry along."""

    def __init__(self, leaves: DataFrame, payload: Sequence[str] = ()):
        self.payload = list(payload)
        label = [F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("digest")]
        nodes = leaves.select("tree", "size", F.struct(*label, *self.payload).alias("node"))
        largest = leaves.agg(F.max("size")).first()[0] or 0
        self.strata: list[DataFrame] = []
        while not self.strata or largest > BLOCK ** len(self.strata):
            self.strata.append(keep_table(_blocks(nodes, len(self.strata))))
            nodes = self.strata[-1].filter(~F.col("whole")).select("tree", "size", F.col("top").alias("node"))

    def roots(self) -> DataFrame:
        """``tree, root``: a single leaf is its own root."""
        parts = [blocks.filter("whole").select("tree", F.col("top.digest").alias("root")) for blocks in self.strata]
        made = parts[0]
        for part in parts[1:]:
            made = made.unionByName(part)
        return made

    def nodes(self) -> DataFrame:
        """``tree, level, lo, hi, digest`` of every node: level 0 are the leaves."""
        parts = []
        for stratum, blocks in enumerate(self.strata):
            for level in range(0 if stratum == 0 else 1, DEPTH + 1):
                node = F.explode(f"level{level}").alias("node")
                parts.append(blocks.select("tree", node).select("tree", F.lit(stratum * DEPTH + level).alias("level"), "node.lo", "node.hi", "node.digest"))
        made = parts[0]
        for part in parts[1:]:
            made = made.unionByName(part)
        return made

    def paths(self, above: DataFrame) -> DataFrame:
        """``tree, rank, digest, payload..., path`` and what ``above`` has of each tree: ``tree, path`` and more columns.

        ``path`` lists from the leaf upwards the digests left and right of it inside each parent, and goes on with the
        path that ``above`` gives for the tree's root.
        """
        more = [c for c in above.columns if c not in ("tree", "path")]
        found = None
        for stratum in reversed(range(len(self.strata))):
            blocks = self.strata[stratum]
            ends = blocks.filter("whole").join(above.hint("merge"), "tree")
            if found is not None:
                # A block lies inside the interval of the node above it; nodes of one level share no bucket.
                covers = F.col("top.lo").between(F.col("above_lo"), F.col("above_hi") - 1) & (F.col("top.hi") <= F.col("above_hi"))
                lower = blocks.filter(~F.col("whole")).join(found.hint("merge"), ["tree", "bucket"]).filter(covers)
                ends = ends.unionByName(lower.drop("above_lo", "above_hi"))
            taken = self.payload if stratum == 0 else []
            way = F.transform("level0", lambda x: F.struct(
                x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"), *[x[c].alias(c) for c in taken], _sides(x).alias("inside")))
            found = ends.select("tree", *more, "path", F.explode(way).alias("x")).select(
                "tree", *more, F.col("x.lo").alias("above_lo"), F.col("x.hi").alias("above_hi"), F.col("x.digest").alias("digest"), *[F.col(f"x.{c}").alias(c) for c in taken],
                F.concat("x.inside", "path").alias("path"))
            if stratum:
                found = found.withColumn("bucket", F.expr(f"above_lo div {BLOCK ** stratum}")).drop("digest")
        return found.withColumnRenamed("above_lo", "rank").drop("above_hi")


def proof_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, from the leaf up to the root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


class Manifest:
    """Trees of the rows of every group, in the order of ``key``, and a tree over the groups' roots.

    ``rows`` holds ``group`` (a string, null is a group of its own and comes first), ``key``, ``digest`` and ``payload``
    columns.  Rows of equal key follow each other by digest; null keys come first; repeated rows are leaves of their own.
    A group that holds most rows is cut into blocks like any other.
    """

    def __init__(self, rows: DataFrame, payload: Sequence[str] = ()):
        payload = ["key", *payload]
        order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest")]
        placed = dense_index(rows.select("group", "digest", *payload), order, "place", ties=True)
        sizes = placed.groupBy("group").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size"))
        self.groups = keep_table(dense_index(sizes, [F.col("group").asc_nulls_first()], "tree"))
        count, chars = self.groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("group")), F.lit(0))).first()
        # A join takes no null key: the null group is one name beside a flag.
        named = [F.col("group").isNotNull().alias("named"), F.coalesce("group", F.lit("")).alias("name")]
        left = placed.select(*named, "place", "digest", *payload)
        right = self.groups.select(*named, "tree", "start", "size")
        joined = spread_join(left, right, ["named", "name"], [F.col("place")], HotKeys(left, ["named", "name"]), count, text_bytes=chars)
        self.rows = Forest(joined.select("tree", "size", (F.col("place") - F.col("start")).alias("rank"), "digest", *payload), payload)
        subroots = self.rows.roots().select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("rank"), F.col("root").alias("digest"))
        self.tops = Forest(subroots)
        self.root: str | None = next((r["root"] for r in self.tops.roots().collect()), None)

    def proofs(self) -> DataFrame:
        """``tree, rank, key, payload..., digest, subroot, root, path``: one row per row of the dataset."""
        start = self.tops.roots().select("tree", F.array().cast(SIDES).alias("path"))
        above = self.tops.paths(start).select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "path")
        return self.rows.paths(above).withColumn("root", F.lit(self.root))

    def nodes(self) -> DataFrame:
        """``group, level, lo, hi, digest`` of the trees of the groups."""
        return self.rows.nodes().join(self.groups.select("tree", "group").hint("merge"), "tree").drop("tree")


DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def verify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of documents, some of which are changed.

    The leaf of a row covers the columns in ``DOCUMENT``; groups are sources, keys are ids.  Where crc32 of the id in
    decimal is even, the row that is checked has lost the line breaks of its text; a null id is never changed, nor is a
    null text.  ``folded_root`` is the root that the checked row's leaf gives with the original siblings, and ``verified``
    says whether it is the manifest's.  Nulls, empty texts, repeated rows and equal ids are rows like others; other
    columns are not read; an empty table gives no rows.
    """
    columns = [F.col(c) for c in DOCUMENT]
    broken = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    checked = F.when(broken, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select(
        F.col("source").alias("group"), F.col("doc_id").alias("key"), row_digest(columns).alias("digest"), row_digest([*columns[:-1], checked]).alias("checked"))
    made = Manifest(rows, ["checked"]).proofs()
    return made.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("checked"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
