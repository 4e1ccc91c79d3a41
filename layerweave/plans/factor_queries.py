"""Queries: factors, stacks, exports and the small steps of an incremental update."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import graph as G
from layerweave.operators import incremental as I
from layerweave.operators import layers as L
from layerweave.operators import scores as S
from layerweave.operators import tensor as T
from layerweave.plans.als_sql import md5_start
from layerweave.plans.graph_queries import _NATIONS, nation_layer
from layerweave.plans.incremental_queries import _SAMPLE_SIZES, _SAMPLES
from layerweave.plans.inputs import BAND_SQL
from layerweave.plans.registry import query, table
from layerweave.plans.table_queries import in_file_order
from layerweave.plans.tensor_queries import _FLAGS, SALES, _by_flag, fixed_factor, fixed_sql, rounded, sales_tensor
from layerweave.session import scratch_path
from layerweave.sources import delimited as D
from layerweave.sources import tables as Tb


@query(
    "factor_filled",
    "WITH rich AS (SELECT c_nationkey AS idx, count(*)::DOUBLE AS f0 FROM customer WHERE c_acctbal > 9900 GROUP BY ALL) "
    "SELECT g.idx, coalesce(f0, 0) AS f0 FROM range((SELECT max(n_nationkey) + 1 FROM nation)) g(idx) LEFT JOIN rich ON g.idx = rich.idx",
)
def factor_filled(spark, folder):
    """All rows of a factor, zeros for nations without a rich customer."""
    length = T.extent(table(spark, folder, "nation"), ("n_nationkey",))[0]
    rich = table(spark, folder, "customer").filter(F.col("c_acctbal") > 9900)
    rows = rich.groupBy(F.col("c_nationkey").cast("long").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("f0"))
    return T.Factor(rows, length, 1).filled()


@query("columns_by_name", "SELECT c_custkey, c_nationkey FROM customer")
def columns_by_name(spark, folder):
    """The key columns of the customers, chosen by prefix and suffix."""
    customers = table(spark, folder, "customer")
    return customers.select(*S.columns_like(customers, "c_", "key"))


@query("sorted_one_file", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name DESC, n_nationkey) - 1 AS place FROM nation WHERE false UNION ALL SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 FROM nation")
def sorted_one_file(spark, folder):
    """The nations sorted by name in one file, by a sort inside the partition."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    path = D.write_sorted_csv(nations, scratch_path(spark, "nations"), ["n_name", "n_nationkey"], single_file=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nations.schema)
    return in_file_order(spark.read.csv(path, header=True, schema=schema))


@query(
    "results_export",
    "SELECT 'community' AS name, c_custkey::BIGINT AS id, c_acctbal::DOUBLE AS value FROM customer UNION ALL SELECT 'lambda', n_nationkey::BIGINT, n_regionkey::DOUBLE FROM nation",
)
def results_export(spark, folder):
    """Named result tables written as CSV folders and read back."""
    tables = {
        "community": table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")),
        "lambda": table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("value")),
        "input": None,
    }
    paths = Tb.export_results(tables, scratch_path(spark, "results"))
    parts = [
        spark.read.csv(path, header=True, schema="id long, value double").select(F.lit(name).alias("name"), "id", "value") for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])


@query("tensor_stack", f"WITH {_FLAGS} SELECT i, j, 0::BIGINT AS k, value FROM ra UNION ALL SELECT i, j, 1, value FROM rr")
def tensor_stack(spark, folder):
    """Two matrices as the slices of one tensor."""
    matrices = [_by_flag(spark, folder, True), _by_flag(spark, folder, False)]
    return T.stack([m.cells for m in matrices], matrices[0].shape).cells


_LAYER_EDGES = " UNION ALL ".join(
    f"SELECT a.id AS src, b.id AS dst, {k}::BIGINT AS k, (a.z + b.z) / 2.0 AS value FROM people a JOIN people b ON a.id <> b.id AND {BAND_SQL[layer]}"
    for k, layer in enumerate(("AGR", "NEU"))
)


@query(
    "layer_tensor",
    f"WITH {_NATIONS}, idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM people), edges AS ({_LAYER_EDGES}) "
    "SELECT s.n AS i, d.n AS j, k, round(value, 6) AS value FROM edges JOIN idx s ON src = s.id JOIN idx d ON dst = d.id WHERE value <> 0",
)
def layer_tensor(spark, folder):
    """Two layers over the nations, stacked into one tensor of vertex indexes."""
    people = nation_layer(spark, folder)
    both = people.unionByName(people.withColumn("layer", F.lit("NEU")))
    cells, index = G.indexed_edges(G.build_graph(both, rules=L.RULES))
    return rounded(T.from_layers(cells, ["AGR", "NEU"], index.count()).cells, "value", digits=6)


@query(
    "tensors_close",
    f"WITH {_FLAGS} SELECT 'moved a little' AS pair, bool_and(abs((value + 5e-7) - value) <= 1e-6) AS close FROM ra UNION ALL "
    "SELECT 'other lines', bool_and(abs(coalesce(ra.value, 0) - coalesce(rr.value, 0)) <= 1e-6) FROM ra FULL JOIN rr ON ra.i = rr.i AND ra.j = rr.j",
)
def tensors_close(spark, folder):
    """Whether two matrices agree cell by cell."""
    one, other = _by_flag(spark, folder, True), _by_flag(spark, folder, False)
    moved = T.Tensor(one.cells.withColumn("value", F.col("value") + 5e-7), one.shape, one.modes)
    return spark.createDataFrame([("moved a little", T.is_close(one, moved)), ("other lines", T.is_close(one, other))], "pair string, close boolean")


@query(
    "initial_factors",
    "SELECT s_suppkey AS idx, " + ", ".join(f"{md5_start(1, r, 6, 's_suppkey')} AS f{r}" for r in (0, 1))
    + " FROM supplier UNION ALL SELECT 0, " + ", ".join(md5_start(1, r, 6, "'0'") for r in (0, 1)) + " WHERE NOT EXISTS (FROM supplier WHERE s_suppkey = 0)",
)
def initial_factors(spark, folder):
    """Starting values for a factor as long as the suppliers."""
    length = T.extent(table(spark, folder, "supplier"), ("s_suppkey",))[0]
    return T.initial_factor(spark, length, 2, 6, 1, "md5").rows


def _brand_factor(spark, folder, shift: int):
    tensor = sales_tensor(spark, folder)
    return tensor, fixed_factor(spark, tensor.shape[1], 2, shift)


_BRANDS = "range((SELECT max(j) + 1 FROM sales)) b(idx)"


@query(
    "sub_factor",
    f"WITH {SALES}, {_SAMPLES} SELECT m1.new AS idx, {fixed_sql('m1.idx', 0, 1)} AS f0, {fixed_sql('m1.idx', 1, 1)} AS f1 FROM m1",
)
def sub_factor(spark, folder):
    """Factor rows of the sampled brands, renumbered."""
    tensor, factor = _brand_factor(spark, folder, 1)
    chosen = I.weighted_sample(I.slice_weights(tensor, 1), _SAMPLE_SIZES[1], 0, 1)
    return I.restrict_factor(factor, chosen, _SAMPLE_SIZES[1]).rows


def _holed(r: int) -> str:
    return f"CASE WHEN idx % 3 = {r} THEN 0 ELSE {fixed_sql('idx', r, 1)} END"


@query(
    "zero_cells",
    f"WITH {SALES} SELECT idx, " + ", ".join(f"CASE WHEN abs({_holed(r)}) < 1e-7 THEN {fixed_sql('idx', r, 4)} ELSE {_holed(r)} END AS f{r}" for r in (0, 1))
    + f" FROM {_BRANDS}",
)
def zero_cells(spark, folder):
    """New entries taken over only where the known entry is zero."""
    tensor, factor = _brand_factor(spark, folder, 1)
    holes = {f"f{r}": F.when(F.col("idx") % 3 == r, 0.0).otherwise(F.col(f"f{r}")) for r in (0, 1)}
    known = T.Factor(factor.rows.withColumns(holes), factor.length, 2)
    return I.fill_zero_cells(known, fixed_factor(spark, tensor.shape[1], 2, 4).rows).rows


def _centred(r: int, shift: int) -> str:
    return f"({fixed_sql('idx', r, shift)} - 1)"


@query(
    "rescale",
    f"WITH {SALES} " + " UNION ALL ".join(
        f"SELECT {r} AS component, round(sqrt(sum({_centred(r, 4)} * {_centred(r, 4)})) / sqrt(sum({_centred(r, 1)} * {_centred(r, 1)})) "
        f"* CASE WHEN sum(CASE WHEN {_centred(r, 4)} >= 0 THEN 1 ELSE -1 END * CASE WHEN {_centred(r, 1)} >= 0 THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE -1 END, 9) AS scale "
        f"FROM {_BRANDS}"
        for r in (0, 1)
    ),
)
def rescale(spark, folder):
    """The scale and sign that bring new components in line with the known ones."""
    tensor, new = _brand_factor(spark, folder, 1)
    known = fixed_factor(spark, tensor.shape[1], 2, 4)
    centred = [T.Factor(f.rows.withColumns({c: F.col(c) - 1 for c in f.columns}), f.length, 2) for f in (new, known)]
    everyone = spark.range(tensor.shape[1]).select(F.col("id").alias("idx"), F.col("id").alias("new"))
    scales = I.align_scales(I._side_by_side(everyone, *centred), 2)
    return spark.createDataFrame([(r, round(float(s), 9)) for r, s in enumerate(scales)], "component int, scale double")
