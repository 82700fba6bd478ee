"""Queries of the matrix, learning, trace and result operators on the supplied tables, each over its whole tables.

Embeddings are the tall matrix E (rows by ``vec_id`` from 0, 64 columns); orders, customers and parts give long vectors; the logs give the traces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels, numeric
from quern.operators import generators, learn, results, timeline
from quern.operators.matrix import Matrix, as_matrix, as_scalar, column_of, column_sums, contingency, gram, matvec
from quern.operators.tiles import from_tiles, row_tiles, tile_map, tile_matmul, tile_sum, tile_transpose, tile_with_transposed
from quern.plans.materialize import drop_later, shared_folder
from quern.queries.reference_sql import ORACLE  # noqa: F401 - part of this module
from quern.sources import datasets, logs
from quern.sources.matrices import read_matrix, write_matrix
from quern.sources.tables import table

M = 64


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("i"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _cells(spark: SparkSession, folder: str) -> Matrix:
    e = table(spark, folder, "embeddings")
    return Matrix.from_arrays(e, "vec_id", "embedding", e.count(), M, base=0)


def _round(c: Column, digits: int) -> Column:
    # adding 0.0 makes -0.0 the zero that both engines print alike
    return F.round(c, digits) + F.lit(0.0)


# matrix programs


def ceil_mean(spark: SparkSession, folder: str) -> DataFrame:
    m = _cells(spark, folder).map(lambda v: numeric.ceil(v * 8), zero_safe=True)
    # through a 1 x 1 matrix and back, as the programs do
    mean = as_scalar(as_matrix(spark, m.df.agg(m.mean().alias("x")).first()["x"]))
    return spark.createDataFrame([(round(mean, 9),)], "mean_ceil double")


def _trade(spark: SparkSession, folder: str) -> Matrix:
    """Quantities sold from the nation of the supplier (columns) to that of the customer (rows), in hundreds."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    sold = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    m = contingency(sold, F.col("c_nationkey") + 1, F.col("s_nationkey") + 1, 25, 25, F.col("l_quantity"))
    return m.map(lambda v: v / 100, zero_safe=True)


def transpose_add_ceil_mean(spark: SparkSession, folder: str) -> DataFrame:
    m = _trade(spark, folder)
    total = m.cellwise(m.t(), lambda x, y: numeric.ceil(x + y))
    return total.df.agg(F.round(total.mean(), 9).alias("mean_ceil"))


def transpose_add(spark: SparkSession, folder: str) -> DataFrame:
    m = _trade(spark, folder).densify()
    return m.cellwise(m.t(), lambda x, y: x + y).df.select("i", "j", F.round("v", 6).alias("v"))


def sin_mul_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Four rounds of sin(x * y) for E, eight times as large, and its mirror image; both are columns of one base."""
    both = _rows(spark, folder).select("i", F.explode(F.arrays_zip(F.col("v").alias("x"), F.reverse("v").alias("y"))).alias("_c")).select("i", (F.col("_c.x") * 8).alias("x"), (F.col("_c.y") * 8).alias("y"))
    x = F.col("x")
    for _ in range(4):
        x = F.sin(x * F.col("y"))
    return both.groupBy("i").agg(_round(F.avg(x), 6).alias("mean_sin"))


def right_index(spark: SparkSession, folder: str) -> DataFrame:
    m = _cells(spark, folder).index((101, 400), (15, 50))
    return m.df.agg(F.count("*").alias("n_cells"), F.max("i").alias("n_rows"), F.round(m.mean(), 9).alias("mean"))


def contains_zero(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.agg(*(F.coalesce(F.bool_or(F.col(c) == 0), F.lit(False)).alias(f"{c}_has_zero") for c in ("l_discount", "l_tax", "l_quantity")))


def matrix_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Sum, mean, minimum and zero test of the sparse matrix of discounts, summed by part and supplier, with its unlisted cells."""
    line = table(spark, folder, "lineitem")
    shape = line.agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s")).first()
    m = contingency(line, F.col("l_partkey") + 1, F.col("l_suppkey") + 1, shape["p"] + 1, shape["s"] + 1, F.col("l_discount"))
    return m.df.agg(F.round(m.sum(), 4).alias("total"), F.round(m.mean(), 9).alias("mean"), F.round(m.min(), 9).alias("least"), m.contains(0).alias("has_zero"))


def matvec_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    n = rows.count()
    means = [r["v"] / n for r in column_sums(rows, M).orderBy("j").collect()]  # one number a column
    return matvec(rows, means).select("i", _round(F.col("v"), 6).alias("v"))


def gram_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return gram(_rows(spark, folder), M).select("j", "k", _round(F.col("v"), 6).alias("v"))


def tile_gram(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    tiles = row_tiles(rows, rows.count(), M, 32)
    product = tile_matmul(tile_transpose(tiles), tiles)
    return from_tiles(product, M, M, 32).df.select(F.col("i").alias("j"), F.col("j").alias("k"), _round(F.col("v"), 6).alias("v"))


def tile_transpose_add(spark: SparkSession, folder: str) -> DataFrame:
    """ceil(8 (G + t(G))) for the square matrix G of the products of the first columns' rows: E times t(E) by tiles, each of which meets its mirror image."""
    rows = _rows(spark, folder)
    n = rows.count()
    tiles = row_tiles(rows, n, M, 128)
    square = tile_map(tile_matmul(tiles, tile_transpose(tile_map(tiles, lambda t: t * np.arange(1, t.shape[1] + 1)))), lambda t: np.round(t, 6))
    total = tile_sum(tile_with_transposed(square, lambda x, y: np.ceil(8 * (x + y) + 0.0301)))
    return total.select(F.col("total").alias("total"), F.col("n_cells").cast("long").alias("n_cells"))


def xty(spark: SparkSession, folder: str) -> DataFrame:
    return gram(_rows(spark, folder), M, "label").filter("k = 0").select("j", _round(F.col("v"), 6).alias("v"))


def _label_means(spark: SparkSession, folder: str) -> np.ndarray:
    """A centre for each label: the mean of its rows, in order of label. Labels are few."""
    cells = _rows(spark, folder).select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x")).collect()
    names = sorted({r["label"] for r in cells})
    out = np.zeros((len(names), M))
    for r in cells:
        out[names.index(r["label"]), r["j"]] = r["x"]
    return out


def matmul(spark: SparkSession, folder: str) -> DataFrame:
    """E times the transposed matrix of label means."""
    centres = _rows(spark, folder).select("label", F.posexplode("v").alias("_p", "x")).groupBy("label", "_p").agg(F.avg("x").alias("v"))
    n = table(spark, folder, "embeddings").agg(F.max("label")).first()[0]
    c = Matrix(centres.select((F.col("label") + 1).cast("long").alias("i"), (F.col("_p") + 1).cast("long").alias("j"), "v"), (n or 0) + 1, M)
    return _cells(spark, folder).matmul(c.t()).df.select("i", "j", _round(F.col("v"), 6).alias("v"))


def onehot(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return contingency(rows, F.col("i"), F.col("label") + 1, rows.count(), 10).df


def onehot_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).groupBy("label").agg(F.count("*").alias("n"))


def cell_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Five rounds of X = (X * Y / X + X - Y * X) * 5 over two aligned vectors."""
    both = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"), ((F.col("o_custkey") % 89 + 1) / 90).alias("y"))
    y = F.col("y")
    step = lambda x: (numeric.ieee_div(x * y, x) + x - y * x) * 5
    # many results are decimal ties, which engines round either way; the cut is moved beside them
    return both.select("o_orderkey", F.floor(numeric.repeated(F.col("x"), 5, step) * 1e4 + 0.123).alias("x_e4"))


def cell_join(spark: SparkSession, folder: str) -> DataFrame:
    """One round of the chain over two vectors that lie apart: order totals, and the price summed over an order's lines (0 where it has none)."""
    orders = table(spark, folder, "orders")
    n = orders.agg(F.max("o_orderkey").alias("n")).first()["n"] + 1
    one = F.lit(1).cast("long")
    x = Matrix(orders.select((F.col("o_orderkey") + 1).alias("i"), one.alias("j"), (F.col("o_totalprice") / 1e5).alias("v")), n, 1, dense=False)
    y = contingency(table(spark, folder, "lineitem"), F.col("l_orderkey") + 1, F.lit(1), n, 1, F.col("l_quantity"))
    m = x.cellwise(y, lambda a, b: numeric.ieee_div(a * b, a) + a - b * a)
    return m.df.select("i", F.round("v", 9).alias("v"))


def div_ieee(spark: SparkSession, folder: str) -> DataFrame:
    """How often each quotient occurs, as text, as NaN is equal to nothing; taxes hold exact zeros."""
    q = numeric.ieee_div((F.col("l_linenumber") - 4).cast("double"), F.col("l_tax"))
    text = F.when(F.isnan("q"), "nan").when(F.col("q") == float("inf"), "inf").when(F.col("q") == -float("inf"), "-inf").otherwise(F.col("q").try_cast("decimal(12,2)").cast("string"))
    return table(spark, folder, "lineitem").select(q.alias("q")).groupBy(text.alias("quotient")).agg(F.count("*").alias("n"))


def floor_vals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", numeric.floor(F.col("o_totalprice") / 1e3).alias("v"))


def indicator(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", numeric.less_equal(F.col("o_totalprice") / 1e5, F.lit(1.0)).alias("v"))


def compare(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("o_totalprice") / 1e5, F.col("o_custkey").cast("double") / 100
    return table(spark, folder, "orders").select("o_orderkey", numeric.less(a, b).alias("lt"), numeric.greater(a, b).alias("gt"), numeric.less_equal(a, b).alias("le"))


def clamp_ifelse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", numeric.clamp(F.col("p_size").cast("double"), F.lit(10.0), F.lit(40.0)).alias("v"))


def abs_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The minimum of abs applied 200 and 100 times: one application."""
    v = numeric.repeated_abs(numeric.repeated_abs(F.col("c_acctbal"), 200), 100)
    return table(spark, folder, "customer").agg(F.min(v).alias("least"))


def sqrt_chain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.round(numeric.repeated_sqrt(F.abs("c_acctbal"), 20), 9).alias("v"))


def seq_vec(spark: SparkSession, folder: str) -> DataFrame:
    return column_of(spark, 1, 100_000, 3).df.select("i", "v")


def rand_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return generators.rand(spark, 1000, 200, sparsity=0.3, seed=7).df


def rand_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return generators.rand(spark, 1000, 200, low=-2.0, high=3.0, seed=7).df


def rand_normal(spark: SparkSession, folder: str) -> DataFrame:
    return generators.rand(spark, 1000, 200, seed=7, pdf="normal").df


def rand_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Whether generated cells have the number, range, mean and spread that their distribution says (within five standard errors)."""
    kinds = {"uniform": generators.rand(spark, 1000, 200, low=-2.0, high=3.0, seed=7), "normal": generators.rand(spark, 1000, 200, seed=7, pdf="normal"), "sparse": generators.rand(spark, 1000, 200, sparsity=0.3, seed=7)}
    want = {"uniform": (200_000, -2.0, 3.0, 0.5, 25 / 12), "normal": (200_000, -9.0, 9.0, 0.0, 1.0), "sparse": (60_000, 0.0, 1.0, 0.5, 1 / 12)}
    out = None
    for kind, m in kinds.items():
        n, low, high, mean, var = want[kind]
        near = lambda c, x, se: F.abs(c - x) <= 5 * se
        row = m.df.agg(
            F.lit(kind).alias("kind"), near(F.count("*"), n, 205.0 if kind == "sparse" else 0.0).alias("count_ok"), ((F.min("v") >= low) & (F.max("v") < high)).alias("range_ok"),
            near(F.avg("v"), mean, (var / n) ** 0.5).alias("mean_ok"), near(F.var_samp("v"), var, var * (2 / n) ** 0.5).alias("spread_ok"), (F.count_distinct("i", "j") == F.count("*")).alias("cells_once"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def blobs_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Points of 8 blobs: whether each of them is nearest to the centre of its label, by label."""
    x, c, y = generators.blobs(spark, 20_000, 16, 8, 1.0, 0.02, 7)
    centres = np.zeros((8, 16))
    for r in c.df.collect():  # k x m
        centres[r["i"] - 1, r["j"] - 1] = r["v"]
    told = learn.assign(x, centres).withColumnRenamed("y", "nearest").join(y, "i")
    return told.groupBy(F.col("y").cast("long").alias("label")).agg((F.sum((F.col("nearest") != F.col("y")).cast("int")) == 0).alias("all_near"))


def dataset_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The programs' data, built a thousandth as large and asked for again: what the first and the second call wrote."""
    import uuid

    root = f"{shared_folder(spark)}/data-{uuid.uuid4().hex}"
    first, second = (datasets.build_datasets(spark, root, 0.001) for _ in range(2))
    out = spark.createDataFrame([(a["name"], a["nrow"], a["ncol"], a["written"], b["written"]) for a, b in zip(first, second)], "name string, nrow long, ncol long, first boolean, again boolean")
    drop_later(spark, root)
    return out


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    x, _, y = generators.blobs(spark, 20_000, 16, 8, 0.9, 0.1, 7)
    return x.join(y, "i")


# learning


def lloyd_assign(spark: SparkSession, folder: str) -> DataFrame:
    return learn.assign(_rows(spark, folder), _label_means(spark, folder)).select("i", "y")


def lloyd_3(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    centres = _label_means(spark, folder)
    for _ in range(3):
        centres, _ = learn.lloyd_step(rows, centres)
    return learn.assign(rows, centres).select("i", "y")


def kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return learn.kmeans(_rows(spark, folder), 10, runs=1, max_iter=30, eps=1e-4, seed=7)[1]


def kmeans_given(spark: SparkSession, folder: str) -> DataFrame:
    """Three steps from given centres."""
    return learn.kmeans(_rows(spark, folder), 10, max_iter=3, eps=0.0, centres=_label_means(spark, folder))[1].select("i", "y")


def pca_norms(spark: SparkSession, folder: str) -> DataFrame:
    """The squared length of each row projected on all components: that of the centred row."""
    projected, _, _ = learn.pca(_rows(spark, folder), M)
    return projected.select("i", _round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def pca_total_variance(spark: SparkSession, folder: str) -> DataFrame:
    _, _, variances = learn.pca(_rows(spark, folder), M)
    return spark.createDataFrame([(round(float(variances.sum()), 6),)], "total_variance double")


def pca(spark: SparkSession, folder: str) -> DataFrame:
    return learn.pca(_rows(spark, folder), 16)[0]


def lm_cg(spark: SparkSession, folder: str) -> DataFrame:
    beta = learn.lm_cg(_rows(spark, folder), "label")
    return spark.createDataFrame([(j + 1, round(float(b), 5) + 0.0) for j, b in enumerate(beta)], "j long, beta double")


# traces


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "compute_event_log")


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    spans = [table(spark, folder, f"{n}_event_log") for n in ("compute", "disk_read", "disk_write")]
    return timeline.bounds(spans, table(spark, folder, "cache_size_event_log"), ["run_id"])


def thread_count(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.thread_counts(_log(spark, folder), ["run_id"])


def caller_totals(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.caller_totals(_log(spark, folder))


def idle_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.idle_gaps(_log(spark, folder), ties=["logged_at", "span_id"])


def islands(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.merge_segments(timeline.segments(_log(spark, folder), include_idle=False))


def segment_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Busy and idle time of every thread."""
    parts = timeline.segments(_log(spark, folder), ties=["logged_at", "span_id"])
    idle = F.col("label").eqNullSafe(F.lit(timeline.IDLE))
    return parts.groupBy(*timeline.THREAD).agg(F.sum(F.when(idle, 0).otherwise(F.col("duration_ns"))).alias("busy_ns"), F.sum(F.when(idle, F.col("duration_ns")).otherwise(0)).alias("idle_ns"), F.count("*").alias("n_segments"))


def rel_time(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    rel = timeline.relative_times(log, timeline.bounds([log], groups=["run_id"]), "ms", ["run_id"])
    return rel.select("run_id", "span_id", "logged_at", F.round("start_rel", 6).alias("start_ms"), F.round("duration_rel", 6).alias("duration_ms"))


def caller_index(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.caller_index(_log(spark, folder))


def ordered_unique(spark: SparkSession, folder: str) -> DataFrame:
    return results.ordered_unique(table(spark, folder, "results"), "experiment", "record_id")


def cache_series(spark: SparkSession, folder: str) -> DataFrame:
    series = timeline.cache_series(table(spark, folder, "cache_size_event_log"), table(spark, folder, "run_settings"))
    return series.withColumn("seconds", F.round("seconds", 9))


def limits(spark: SparkSession, folder: str) -> DataFrame:
    """Soft and hard limit of each run; none of them if one is missing."""
    both = F.col("cache_eviction_limit").isNotNull() & F.col("cache_hard_limit").isNotNull()
    return table(spark, folder, "run_settings").select("run_id", F.when(both, F.col("cache_eviction_limit")).alias("soft"), F.when(both, F.col("cache_hard_limit")).alias("hard"))


def limits_file(spark: SparkSession, folder: str) -> DataFrame:
    """The limits of a settings file, written from the settings of the first run that has both."""
    first = table(spark, folder, "run_settings").filter("cache_hard_limit is not null and cache_eviction_limit is not null").orderBy("run_id").limit(1)
    path = _csv(first.select(F.col("cache_hard_limit").alias("CacheHardLimit"), F.col("cache_eviction_limit").alias("CacheEvictionLimit")), "settings")
    soft, hard = logs.read_limits(spark, path)
    return spark.createDataFrame([(soft, hard)], "soft long, hard long")


# results and labels


def _conf_texts(spark: SparkSession, folder: str) -> DataFrame:
    part, key = table(spark, folder, "part"), F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    text = F.when(key == 0, F.concat(F.lit("java -Xmx"), size, F.lit("g -jar"))).when(key == 1, F.concat(size, F.lit("MiB"))).when(key == 2, F.concat(size, F.lit(" k"))).when(key == 3, F.concat(F.lit("cfg"), size)).otherwise(F.concat(size, F.lit(".5t")))
    made = part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("tbl"), text.alias("conf"))
    runs = table(spark, folder, "run_settings").select(F.col("run_id").alias("id"), F.lit("run_settings").alias("tbl"), "conf")
    return made.unionByName(runs).unionByName(table(spark, folder, "results").select(F.col("record_id").alias("id"), F.lit("results").alias("tbl"), "conf"))


def conf_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return _conf_texts(spark, folder).select("tbl", "id", labels.conf_bytes(F.col("conf")).alias("bytes"))


def conf_order(spark: SparkSession, folder: str) -> DataFrame:
    return results.conf_order(table(spark, folder, "results"), "conf", "record_id")


def xmx_mb(spark: SparkSession, folder: str) -> DataFrame:
    return _conf_texts(spark, folder).select("tbl", "id", labels.heap_megabytes(F.col("conf")).alias("heap_mb"), labels.value_megabytes(F.col("conf")).alias("value_mb"))


def dim_format(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_partkey") * F.col("p_size") * 500
    return table(spark, folder, "part").select("p_partkey", labels.dimension(n).alias("label"))


def dim_extract(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    shape = F.concat_ws(" ", (F.col("p_size") * 1000).cast("string"), F.col("p_partkey").cast("string"), F.lit("1.0"))
    script = F.when(F.col("p_partkey") % 7 == 0, F.lit("no arguments here")).when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("run_args=( x "), shape, F.lit(" )")))
    script = script.otherwise(F.concat(F.lit("mode=cp\nrun_args=( "), shape, F.lit(" )\nfor x in 1 2")))
    return part.select("p_partkey", labels.script_dimensions(script).alias("dims"))


def setup_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scheduling_results").select("record_id", labels.setup_label(F.col("setup")).alias("label"))


def exp_title(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("kmeans_warm_"), F.lower("p_type")).alias("name"))
    both = made.unionByName(table(spark, folder, "results").select(F.col("record_id").alias("id"), F.col("experiment").alias("name")))
    return both.select("id", "name", labels.experiment_title(F.col("name")).alias("title"))


def last_metric(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", labels.last_metric(F.col("text"), "took").alias("took"))


def run_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", labels.run_status(F.col("text"), "ERROR|stream closed").alias("status"))


def _latest_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results").withColumn("mode", F.lower(F.trim("mode")))
    return results.latest(rows, ["experiment", "mode", "conf"], ["recorded_at", "record_id"], ["rep1"])


def result_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The latest result of every experiment, mode and conf, NaN (written as text) where there is none."""
    grid = results.result_grid(_latest_results(spark, folder), "mode", "conf", F.col("rep1"), ["experiment"])
    return grid.select("experiment", "mode", "conf", F.when(F.isnan("value"), "nan").otherwise(F.round("value", 3).cast("decimal(20,3)").cast("string")).alias("value"))


EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def mode_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Events by user: the summed value of each type in a column of its own."""
    sums = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    wide = results.pivoted(sums, ["user_id"], "event_type", EVENT_TYPES)
    return wide.select("user_id", *(F.col(c).alias(f"v_{c}") for c in EVENT_TYPES))


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The table of each experiment: by mode, the settings by size and the latest results beside them."""
    latest = table(spark, folder, "results").withColumn("mode", F.lower(F.trim("mode")))
    latest = results.latest(latest, ["experiment", "mode", "conf"], ["recorded_at", "record_id"], ["rep1", "record_id"])
    rows = results.result_rows(latest, "mode", "conf", "record_id", F.col("rep1"), ["experiment"])
    return rows.select("experiment", "mode", F.array_join("confs", ";").alias("confs"), F.array_join("cells", ";").alias("cells"))


def sched_axis(spark: SparkSession, folder: str) -> DataFrame:
    plain = table(spark, folder, "scheduling_results").filter("runtime_s is not null and not isnan(runtime_s)")
    return results.axis_limit(plain, F.col("runtime_s"), ["setup"], finite=False).select("setup", "top", F.round("axis_top", 6).alias("axis_top"))


def sched_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The strict grid of setups by execution mode: the longest plain time of those setups that every mode has run."""
    rows = table(spark, folder, "scheduling_results").filter("runtime_s is not null and not isnan(runtime_s)").withColumn("mode", F.lower(F.trim("exec_mode"))).filter("mode is not null")
    longest = rows.groupBy("setup", "mode").agg(F.max("runtime_s").alias("v"))
    modes = longest.agg(F.count_distinct("mode").alias("n")).first()["n"]
    whole = longest.groupBy("setup").agg(F.count("*").alias("n")).filter(F.col("n") == modes).select("setup")
    return results.result_grid(longest.join(whole, "setup", "left_semi"), "mode", "setup", F.col("v"), strict=True)


def result_axis(spark: SparkSession, folder: str) -> DataFrame:
    return results.axis_limit(table(spark, folder, "results"), F.col("rep1"), ["experiment"]).select("experiment", "top", F.round("axis_top", 6).alias("axis_top"))


# sources and sinks: written as CSV to the shared folder, and read by the loaders


def _csv(df: DataFrame, name: str) -> str:
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    drop_later(df.sparkSession, path)
    df.write.option("header", True).option("nanValue", "nan").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def spans_load(spark: SparkSession, folder: str) -> DataFrame:
    named = _log(spark, folder).select("span_id", *(F.col(v).alias(k) for k, v in logs.SPAN_COLUMNS.items()))
    return logs.read_spans(spark, _csv(named, "spans")).groupBy("thread_id").agg(F.count("*").alias("n"), F.min("start_nanos").alias("first_start"), F.max("end_nanos").alias("last_end"), F.count_distinct("caller_id").alias("n_callers"))


def cache_load(spark: SparkSession, folder: str) -> DataFrame:
    names = logs.CACHE_COLUMNS | logs.CACHE_OPTIONAL
    whole = table(spark, folder, "cache_size_event_log")
    return logs.read_cache_samples(spark, _csv(whole.select(*(F.col(v).alias(k) for k, v in names.items())), "cache"))


def results_load(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results")
    path = _csv(rows.select("mode", "conf", "rep1", "rep2", "rep3"), "results")
    loaded = logs.read_results(spark, path)
    return loaded.groupBy("mode", "conf").agg(F.count("*").alias("n"), F.sum(F.isnan("rep1").cast("int")).alias("n_failed"), F.round(F.sum(F.when(~F.isnan("rep2"), F.col("rep2"))), 3).alias("rep2"))


def matrix_files(spark: SparkSession, folder: str) -> DataFrame:
    """E written with its shape and read again: the sum of each row."""
    import uuid

    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    drop_later(spark, path)
    drop_later(spark, f"{path}.mtd")
    write_matrix(_cells(spark, folder), path)
    m = read_matrix(spark, path)
    return m.df.groupBy("i").agg(F.count("*").alias("n_cells"), _round(F.sum("v"), 6).alias("total")).withColumn("n_rows", F.lit(m.nrow).cast("long"))


def sched_load(spark: SparkSession, folder: str) -> DataFrame:
    whole = table(spark, folder, "scheduling_results")
    path = _csv(whole.select(F.col("setup").alias("Setup"), F.col("exec_mode").alias("ExecMode"), F.col("runtime_s").alias("Runtime [s]")), "scheduling")
    known = F.when(~F.isnan("runtime_s"), F.col("runtime_s"))
    return logs.read_scheduling(spark, path).groupBy("setup", "exec_mode").agg(F.count("*").alias("n"), F.round(F.sum(known), 3).alias("total_s"))


def results_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Results appended to a file in two goes, and read again."""
    import uuid

    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    drop_later(spark, path)
    rows = table(spark, folder, "results").select("record_id", "mode", "conf", "rep1", "rep2", "rep3").filter("mode is not null and conf is not null")
    for half in (0, 1):  # by turns; both are the whole table
        logs.append_results(rows.filter(F.col("record_id") % 2 == half).drop("record_id"), path)
    return logs.read_results(spark, path).groupBy("mode", "conf").agg(F.count("*").alias("n"), F.sum(F.isnan("rep1").cast("int")).alias("n_failed"), F.round(F.sum(F.when(~F.isnan("rep3"), F.col("rep3"))), 3).alias("rep3"))


QUERIES = [
    ceil_mean, transpose_add_ceil_mean, transpose_add, sin_mul_chain, right_index, contains_zero, matrix_aggregates, matvec_means, gram_matrix, tile_gram, tile_transpose_add, xty, matmul, onehot, onehot_counts,
    cell_chain, cell_join, div_ieee, floor_vals, indicator, compare, clamp_ifelse, abs_chain, sqrt_chain, seq_vec, rand_sparse, rand_uniform, rand_normal, rand_moments, blobs, blobs_labels, dataset_matrix,
    lloyd_assign, lloyd_3, kmeans, kmeans_given, pca_norms, pca_total_variance, pca, lm_cg,
    bounds, thread_count, caller_totals, idle_gaps, islands, segment_totals, rel_time, caller_index, ordered_unique, cache_series, limits, limits_file,
    conf_bytes, conf_order, xmx_mb, dim_format, dim_extract, setup_label, exp_title, last_metric, run_status, result_pivot, mode_pivot, result_rows, sched_pivot, sched_axis, result_axis,
    spans_load, cache_load, results_load, sched_load, results_sink, matrix_files,
]
