"""Queries: tensor and matrix operators on a tensor of sales, and the decompositions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from layerweave.operators import cp
from layerweave.operators import tensor as T
from layerweave.plans.als_sql import als_sql
from layerweave.plans.inputs import MONEY
from layerweave.plans.registry import query, table
from layerweave.session import keep_table


def sales_cells(spark, folder):
    """``i, j, k, value``: supplier nation × brand × ship year, counted from the first one → revenue."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    first_year = lines.agg(F.min(F.year("l_shipdate")).alias("y")).first()["y"] or 0
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("i"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") - 1
    parts = table(spark, folder, "part").select("p_partkey", brand.alias("j"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    year = (F.year("l_shipdate") - first_year).cast("long").alias("k")
    amount = F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("value")
    return joined.groupBy("i", "j", year).agg(amount)


def sales_tensor(spark, folder) -> T.Tensor:
    """The stored cells, as long in every mode as their indexes reach."""
    cells = keep_table(sales_cells(spark, folder))
    return T.Tensor(cells, T.extent(cells))


SALES = (
    "sales AS MATERIALIZED (SELECT s_nationkey::BIGINT AS i, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT - 1 AS j, "
    "(year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem))::BIGINT AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS value "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
)


def fixed_factor(spark, length: int, rank: int, shift: int) -> T.Factor:
    """Factor entries from index arithmetic, the same in both engines."""
    columns = [(((F.col("id") * (r + 2) + r + shift) % 7 + 1) / 4.0).alias(f"f{r}") for r in range(rank)]
    return T.Factor(spark.range(length).select(F.col("id").alias("idx"), *columns), length, rank)


def fixed_sql(index: str, r: int, shift: int) -> str:
    return f"((({index} * {r + 2} + {r + shift}) % 7 + 1) / 4.0)"


RANK = 3


def fixed_factors(spark, shape):
    return [fixed_factor(spark, n, RANK, shift) for shift, n in enumerate(shape)]


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("sales_tensor", f"WITH {SALES} SELECT i, j, k, round(value, 4) AS value FROM sales")
def sales(spark, folder):
    return rounded(sales_cells(spark, folder), "value")


@query("tensor_extent", f"WITH {SALES} SELECT max(i) + 1 AS i, max(j) + 1 AS j, max(k) + 1 AS k, count(*) AS cells, round(sqrt(sum(value * value)), 4) AS norm FROM sales")
def tensor_extent(spark, folder):
    """Length of every mode, stored cells and Frobenius norm."""
    tensor = sales_tensor(spark, folder)
    row = (*tensor.shape, T.stored_cells(tensor), round(T.norm(tensor), 4))
    return spark.createDataFrame([row], "i long, j long, k long, cells long, norm double")


for _mode, (_row, _column) in enumerate((
    ("i", "k * (SELECT max(j) + 1 FROM sales) + j"), ("j", "k * (SELECT max(i) + 1 FROM sales) + i"), ("k", "i * (SELECT max(j) + 1 FROM sales) + j"),
)):
    def _unfolded(spark, folder, mode=_mode):
        """Matrix form of the sales tensor along one mode."""
        return rounded(T.unfold(sales_tensor(spark, folder), mode).cells, "value")

    query(f"unfold_mode{_mode + 1}", f"WITH {SALES} SELECT {_row} AS i, {_column} AS j, round(value, 4) AS value FROM sales")(_unfolded)


@query(
    "tensor_mode_vector",
    f"WITH {SALES} SELECT i, k, round(sum(value * {fixed_sql('j', 0, 1)}), 4) AS value FROM sales GROUP BY ALL",
)
def tensor_mode_vector(spark, folder):
    """Sum the brands out against a weight per brand."""
    tensor = sales_tensor(spark, folder)
    vector = fixed_factor(spark, tensor.shape[1], 1, 1).rows.select("idx", F.col("f0").alias("value"))
    return rounded(T.contract_vector(tensor, 1, vector, tensor.shape[1]).cells, "value")


@query(
    "tensor_contract",
    f"WITH {SALES}, stock AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT - 1 AS i, p_size::BIGINT AS j, count(*)::DOUBLE AS value FROM part GROUP BY ALL) "
    "SELECT s.i AS i, s.k AS j, t.j AS k, round(sum(s.value * t.value), 4) AS value FROM sales s JOIN stock t ON s.j = t.i GROUP BY ALL",
)
def tensor_contract(spark, folder):
    """Contract the brand mode with a brand × size matrix."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") - 1
    stock = table(spark, folder, "part").groupBy(brand.alias("i"), F.col("p_size").cast("long").alias("j")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    sold, (brands, sizes) = sales_tensor(spark, folder), T.extent(stock, ("i", "j"))
    brands = max(brands, sold.shape[1])
    sold = replace(sold, shape=T.updated(sold.shape, 1, brands))
    out = T.contract(sold, 1, T.Tensor(stock, (brands, sizes), ("i", "j")), 0)
    return rounded(out.cells, "value")


def _by_flag(spark, folder, returned: bool) -> T.Tensor:
    """Quantities by supplier and line number: the lines of flag A, or all others."""
    lines = table(spark, folder, "lineitem")
    shape = T.extent(lines, ("l_suppkey", "l_linenumber"))
    cells = lines.filter((F.col("l_returnflag") == "A") == returned).groupBy(
        F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")
    ).agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("value"))
    return T.Tensor(cells, shape, ("i", "j"))


_FLAGS = ", ".join(
    f"{name} AS (SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS value "
    f"FROM lineitem WHERE l_returnflag {test} 'A' GROUP BY ALL)"
    for name, test in (("ra", "="), ("rr", "<>"))
)


@query(
    "tensor_subtract",
    f"WITH {_FLAGS} SELECT coalesce(ra.i, rr.i) AS i, coalesce(ra.j, rr.j) AS j, round(coalesce(ra.value, 0) - coalesce(rr.value, 0), 4) AS value "
    "FROM ra FULL JOIN rr ON ra.i = rr.i AND ra.j = rr.j",
)
def tensor_subtract(spark, folder):
    """Cell-wise difference; a missing cell is zero."""
    return rounded(T.subtract(_by_flag(spark, folder, True), _by_flag(spark, folder, False)).cells, "value")


@query(
    "hadamard",
    f"WITH {_FLAGS} SELECT ra.i, ra.j, round(ra.value * rr.value, 4) AS value FROM ra JOIN rr ON ra.i = rr.i AND ra.j = rr.j",
)
def hadamard(spark, folder):
    """Cell-wise product of the cells present on both sides."""
    return rounded(T.hadamard(_by_flag(spark, folder, True), _by_flag(spark, folder, False)).cells, "value")


@query(
    "tensor_append",
    f"WITH {_FLAGS} SELECT i, j, value FROM ra UNION ALL SELECT i, j + (SELECT max(l_linenumber) + 1 FROM lineitem), value FROM rr",
)
def tensor_append(spark, folder):
    """One matrix behind the other along the second mode, indexes shifted."""
    return T.append_mode(_by_flag(spark, folder, True), _by_flag(spark, folder, False), 1).cells


@query(
    "matrix_multiply",
    f"WITH {_FLAGS} SELECT ra.j AS i, rr.j AS j, round(sum(ra.value * rr.value), 4) AS value FROM ra JOIN rr ON ra.i = rr.i GROUP BY ALL",
)
def matrix_multiply(spark, folder):
    """Transposed matrix times matrix, joined on the supplier."""
    left, right = _by_flag(spark, folder, True), _by_flag(spark, folder, False)
    return rounded(T.multiply(T.transpose(left), right).cells, "value")


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "gram",
    "SELECT r, s, value FROM (" + " UNION ALL ".join(
        f"SELECT {r} AS r, {s} AS s, round(sum(CAST({a} AS DECIMAL(12,2)) * CAST({b} AS DECIMAL(12,2)))::DOUBLE, 2) AS value FROM lineitem"
        for r, a in enumerate(_LINE_COLUMNS) for s, b in enumerate(_LINE_COLUMNS)
    ) + ")",
)
def gram(spark, folder):
    """XᵀX of the four measure columns of all order lines: one aggregate."""
    measures = table(spark, folder, "lineitem").select(*[F.col(c).cast("decimal(12,2)").alias(c) for c in _LINE_COLUMNS])
    square = T.gram(measures, _LINE_COLUMNS)
    rows = [(r, s, round(float(square[r][s]), 2)) for r in range(4) for s in range(4)]
    return spark.createDataFrame(rows, "r int, s int, value double")


@query(
    "column_norms",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round({c} / (SELECT sqrt(sum(CAST({c} AS DECIMAL(12,2)) * CAST({c} AS DECIMAL(12,2)))::DOUBLE) FROM lineitem), 9) AS {c}" for c in _LINE_COLUMNS
    ) + " FROM lineitem",
)
def column_norms(spark, folder):
    """Order lines with every measure column scaled to length one."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_COLUMNS)
    exact = lines.select(*[F.col(c).cast("decimal(12,2)").alias(c) for c in _LINE_COLUMNS])
    scaled = T.scale_columns(lines, _LINE_COLUMNS, T.column_norms(exact, _LINE_COLUMNS))
    return rounded(scaled, *_LINE_COLUMNS, digits=9)


@query(
    "khatri_rao",
    "WITH a AS (SELECT c_nationkey::BIGINT AS p, count(*)::DOUBLE AS f0, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / 1000 AS f1 FROM customer GROUP BY ALL), "
    "b AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT - 1 AS q, count(*)::DOUBLE AS f0, sum(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE / 1000 AS f1 FROM part GROUP BY ALL) "
    "SELECT p * (SELECT max(q) + 1 FROM b) + q AS idx, round(a.f0 * b.f0, 4) AS f0, round(a.f1 * b.f1, 4) AS f1 FROM a, b",
)
def khatri_rao(spark, folder):
    """Row-wise products of a nation matrix and a brand matrix."""
    total = lambda c: (F.sum(F.col(c).cast(MONEY)).cast("double") / 1000).alias("f1")
    count = F.count(F.lit(1)).cast("double").alias("f0")
    nations = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("idx")).agg(count, total("c_acctbal"))
    brand = (F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") - 1).alias("idx")
    brands = table(spark, folder, "part").groupBy(brand).agg(count, total("p_retailprice"))
    left, right = (T.Factor(rows, T.extent(rows, ("idx",))[0], 2) for rows in (nations, brands))
    return rounded(T.khatri_rao(left, right).rows, "f0", "f1")


def whole_factor(spark, length: int, rank: int, shift: int) -> T.Factor:
    """Whole-number entries: with cells in cents every sum is exact, whatever the order of adding."""
    columns = [((F.col("id") * (r + 2) + r + shift) % 7 + 1).cast("double").alias(f"f{r}") for r in range(rank)]
    return T.Factor(spark.range(length).select(F.col("id").alias("idx"), *columns), length, rank)


def _mttkrp_sql(mode: int) -> str:
    index = T.MODES[mode]
    others = [(T.MODES[n], n) for n in range(3) if n != mode]
    sums = ", ".join(
        "sum(cents * " + " * ".join(f"(({m} * {r + 2} + {r + n}) % 7 + 1)" for m, n in others) + f")::DOUBLE AS f{r}" for r in range(RANK)
    )
    return f"WITH {SALES}, counted AS (SELECT i, j, k, round(value * 100)::BIGINT AS cents FROM sales) SELECT {index} AS idx, {sums} FROM counted GROUP BY ALL"


for _mode in range(3):
    def _products(spark, folder, mode=_mode):
        """All ranks of the matricised product in one pass over the sales tensor, in whole cents."""
        tensor = sales_tensor(spark, folder)
        cents = replace(tensor, cells=tensor.cells.withColumn("value", F.round(F.col("value") * 100)))
        return T.mttkrp(cents, [whole_factor(spark, n, RANK, shift) for shift, n in enumerate(tensor.shape)], mode).rows

    query(f"mttkrp_mode{_mode + 1}", _mttkrp_sql(_mode))(_products)


_WEIGHTS = (2.0, 0.5, 1.5)
_ESTIMATE = "(" + " + ".join(
    f"{w} * " + " * ".join(fixed_sql(m, r, n) for n, m in enumerate(T.MODES)) for r, w in enumerate(_WEIGHTS)
) + ")"


@query("cp_value", f"WITH {SALES} SELECT i, j, k, round({_ESTIMATE}, 7) AS estimate FROM sales")
def cp_value(spark, folder):
    """A model's value at every stored cell."""
    tensor = sales_tensor(spark, folder)
    return rounded(T.evaluate(tensor.cells.select(*T.MODES), fixed_factors(spark, tensor.shape), _WEIGHTS), "estimate", digits=7)


@query(
    "cp_error",
    f"WITH {SALES}, e AS (SELECT value, {_ESTIMATE} AS m FROM sales), g AS (SELECT sum({_ESTIMATE} * {_ESTIMATE}) AS mm FROM "
    "range((SELECT max(i) + 1 FROM sales)) a(i), range((SELECT max(j) + 1 FROM sales)) b(j), range((SELECT max(k) + 1 FROM sales)) c(k)) SELECT round(sqrt(sum((m - value) * (m - value)) / sum(value * value)), 6) AS masked, "
    "round(sqrt((sum(value * value) - 2 * sum(value * m) + any_value(mm)) / sum(value * value)), 6) AS full_error FROM e, g",
)
def cp_error(spark, folder):
    """Relative error of a model: over stored cells, and with absent cells as zeros."""
    import numpy as np

    tensor = sales_tensor(spark, folder)
    model = cp.CPModel(tuple(fixed_factors(spark, tensor.shape)), np.array(_WEIGHTS))
    rows = [(round(model.error(tensor, masked=True), 6), round(model.error(tensor), 6))]
    return spark.createDataFrame(rows, "masked double, full_error double")


@query(
    "cp_reconstruct",
    "WITH a AS (SELECT c_nationkey::BIGINT AS i, count(*) / 10.0::DOUBLE AS f FROM customer GROUP BY ALL), "
    "b AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT - 1 AS j, count(*) / 10.0::DOUBLE AS f FROM part GROUP BY ALL), "
    "c AS (SELECT (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders))::BIGINT AS k, count(*) / 100.0::DOUBLE AS f FROM orders GROUP BY ALL) "
    "SELECT g.i, h.j, l.k, round(coalesce(2.0 * a.f * b.f * c.f, 0), 4) AS value FROM range((SELECT max(i) + 1 FROM a)) g(i) CROSS JOIN range((SELECT max(j) + 1 FROM b)) h(j) "
    "CROSS JOIN range((SELECT max(k) + 1 FROM c)) l(k) LEFT JOIN a ON a.i = g.i LEFT JOIN b ON b.j = h.j LEFT JOIN c ON c.k = l.k",
)
def cp_reconstruct(spark, folder):
    """All cells of a rank-one model built from nation, brand and year counts."""
    def share(name, key, scale):
        rows = table(spark, folder, name).groupBy(key.cast("long").alias("idx")).agg((F.count(F.lit(1)) / scale).alias("f0"))
        return T.Factor(rows, T.extent(rows, ("idx",))[0], 1)

    first_year = table(spark, folder, "orders").agg(F.min(F.year("o_orderdate")).alias("y")).first()["y"] or 0

    factors = [
        share("customer", F.col("c_nationkey"), 10.0),
        share("part", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") - 1, 10.0),
        share("orders", F.year("o_orderdate") - first_year, 100.0),
    ]
    return rounded(T.reconstruct(factors, [2.0]).cells, "value")


@query(
    "cp_als",
    f"WITH {SALES}, {als_sql('sales', 25, 0.002)}, lengths AS (" + " UNION ALL ".join(
        f"SELECT {n} AS mode, '{m}' AS name, unnest(range((SELECT max({m}) + 1 FROM sales))) AS idx" for n, m in enumerate(T.MODES)
    ) + ") SELECT l.idx, round(coalesce(f0, 0), 4) AS x_r0, round(coalesce(f1, 0), 4) AS x_r1, l.name AS mode, round(e.error, 4) AS error, st.converged "
    "FROM stopped st JOIN errors e ON e.sweep = st.sweep CROSS JOIN lengths l LEFT JOIN solution s ON s.sweep = st.sweep AND s.mode = l.mode AND s.idx = l.idx",
)
def cp_als(spark, folder):
    """Rank-two decomposition of the sales tensor: every factor entry, with the final error."""
    model = cp.cp_als(sales_tensor(spark, folder), rank=2, max_sweeps=25, tolerance=0.002, init="md5")
    parts = [cp.factor_table(f, "x").withColumn("mode", F.lit(m)) for m, f in zip(T.MODES, model.factors)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.withColumns({"error": F.lit(float(model.errors[-1])), "converged": F.lit(model.converged)})
    return rounded(rows, "x_r0", "x_r1", "error")


@query(
    "cp_fit",
    f"WITH {SALES}, {als_sql('sales', 40, 0.0001, strict_fit=True)} SELECT round(w0, 2) AS lambda_r0, round(w1, 2) AS lambda_r1, round(1 - error, 6) AS fit, "
    "converged FROM stopped JOIN errors USING (sweep)",
)
def cp_fit(spark, folder):
    """The variant that stops on the fit: its weights and the fit it reached."""
    model = cp.cp_fit(sales_tensor(spark, folder), rank=2, init="md5")
    weights = rounded(cp.weight_table(model), "lambda_r0", "lambda_r1", digits=2)
    return weights.withColumns({"fit": F.lit(round(1.0 - model.errors[-1], 6)), "converged": F.lit(model.converged)})
