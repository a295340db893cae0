"""Graphs, provenance logs and run logs that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailgraph.graph import PropertyGraph

# The vocabulary of the derived run log.
ALGORITHMS = ["BFS", "PageRank", "SSSP", "WCC"]
DATASETS = [
    "cit-Patents", "datagen-7_5-fb", "datagen-7_9-fb", "datagen-8_4-fb", "datagen-8_8-zf",
    "graph500-22",
]
SETUPS = [
    "Baseline", "Tracing", "CompleteProvenance", "ProvenanceGraphPruning", "DataGraphPruning",
    "CombinedPruning",
]
FORMATS = [
    "TextFile()", "TextFile(true)", "ParquetFile()", "ORCFile()", "CSVFile(true)",
    "JSONFormat()", "JSONFormat(true)",
]
SIZE_KINDS = ["vertices", "edges", "BFS", "PageRank", "SSSP", "WCC"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(values: list[str], number: Column) -> Column:
    """The value at ``number`` modulo their count."""
    array = F.array(*[F.lit(value) for value in values])
    return F.element_at(array, (number % len(values) + 1).cast("int"))


# graphs


def part_seq_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, with the lowest price.

    Copies of a line are merged before the join, so they do not multiply.
    """
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("src")
    ).agg(F.min("l_extendedprice").alias("price"))
    second = lines.select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_partkey").alias("dst"),
    ).distinct()
    return (
        first.join(second, ["l_orderkey", "l_linenumber"])
        .groupBy("src", "dst")
        .agg(F.min("price").alias("attr"))
    )


def part_seq(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_edges(part_seq_edges(spark, sf_dir))


def line_seq(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Lines that follow each other in an order, with the lowest price of the
    first: as many components as orders, with dangling and lone vertices."""
    number = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy(number.alias("id")).agg(
        F.min("l_extendedprice").alias("attr")
    )
    following = lines.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    edges = lines.withColumnRenamed("id", "src").join(following, "src").select("src", "dst", "attr")
    return PropertyGraph.from_edges(edges, lines.select("id"))


def part_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """``part_seq`` over all parts, with the size of the part as attribute."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("attr")
    )
    return PropertyGraph.from_edges(part_seq_edges(spark, sf_dir), parts)


def cust_supp(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and the suppliers they got goods from, with the highest price."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    edges = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
        )
        .agg(F.max("l_extendedprice").alias("attr"))
    )
    return PropertyGraph.from_edges(edges)


# a provenance log: an order is a run, its lines are the operations


def prov_edges_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("l_quantity").cast("bigint") % 6).cast("int")
    event_type = one_of(
        ["operation", "operation", "operation", "pregelIteration", "operation", "algorithm"], kind
    )
    event_name = one_of(
        ["joinVertices", "mapVertices", "outerJoinVertices", "PregelIteration", "unpersist", "BFS"],
        kind,
    )
    number = F.col("l_linenumber").cast("string")
    supplier = F.col("l_suppkey").cast("string")
    params = (
        F.when(kind == 3, F.create_map(F.lit("i"), number))
        .when(kind == 5, F.create_map(F.lit("source"), supplier))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    target = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        target.alias("seq"),
        (target - 1).alias("source"),
        target.alias("target"),
        event_type.alias("event_type"),
        event_name.alias("event_name"),
        params.alias("params"),
    )


def prov_nodes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = prov_edges_log(spark, sf_dir)
    nodes = (
        edges.select("run_id", F.col("source").alias("node_id"))
        .union(edges.select("run_id", "target"))
        .distinct()
    )
    stored = (F.col("run_id").cast("bigint") + F.col("node_id")) % 5 == 0
    path = F.concat_ws("/", F.lit("snapshots"), "run_id", F.col("node_id").cast("string"))
    return nodes.withColumn("location", F.when(stored, path))


def prov_metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time per operation, and a gauge of active messages per graph."""
    lines = table(spark, sf_dir, "lineitem")
    run = F.col("l_orderkey").cast("string").alias("run_id")
    owner = F.col("l_linenumber").cast("bigint").alias("owner_id")
    times = lines.select(
        run, F.lit("edge").alias("owner"), owner, F.lit("time").alias("kind"),
        F.lit("operationTime").alias("name"),
        F.floor("l_extendedprice").cast("double").alias("value"), F.lit("ns").alias("unit"),
    )
    gauges = lines.select(
        run, F.lit("node").alias("owner"), owner, F.lit("gauge").alias("kind"),
        F.lit("activeMessages").alias("name"), F.col("l_quantity").alias("value"),
        F.lit(None).cast("string").alias("unit"),
    )
    return times.unionByName(gauges)


# a run log: an order is a run


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    fields = table(spark, sf_dir, "orders").select(
        order.alias("run_nr"),
        one_of(ALGORITHMS, order).alias("algorithm"),
        one_of(DATASETS, customer).alias("dataset"),
        one_of(SETUPS, F.floor(order / 4)).alias("setup"),
        one_of(FORMATS, F.floor(customer / 6)).alias("any_format"),
        F.floor(F.col("o_totalprice") * 1000).cast("bigint").alias("bytes"),
        (F.col("o_totalprice") / 1000).alias("duration_s"),
        (order % 10 + 1).alias("iterations"),
        F.when(F.col("o_orderstatus") == "F", "FAILURE").otherwise("SUCCESS").alias("status"),
    )
    complete = F.col("setup") == "CompleteProvenance"
    storing = ~F.col("setup").isin("Baseline", "Tracing")
    return fields.select(
        "run_nr", "algorithm", "dataset", "setup",
        F.when(complete, F.col("any_format")).otherwise("TextFile()").alias("storage_format"),
        F.when(storing, F.col("bytes")).otherwise(0).alias("total_size"),
        "duration_s", "iterations", "status",
    )


def dataset_size_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dataset, kind, size)``: bytes of the files of each dataset."""
    customer = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .select(
            one_of(DATASETS, customer).alias("dataset"),
            one_of(SIZE_KINDS, F.floor(customer / 6)).alias("kind"),
            F.floor(F.abs("c_acctbal") * 1000).cast("bigint").alias("bytes"),
        )
        .groupBy("dataset", "kind")
        .agg(F.sum("bytes").alias("size"))
    )


def paired_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with lineage next to their twins without."""
    runs = run_log(spark, sf_dir)
    return runs.select(
        F.col("run_nr").cast("string").alias("run"),
        "algorithm",
        "dataset",
        (F.col("duration_s") * (1 + (F.col("run_nr") % 7) / 10)).alias("with_lineage"),
        F.col("duration_s").alias("without_lineage"),
        "iterations",
        F.transform(
            F.sequence(F.lit(0), (F.col("iterations") - 1).cast("int")),
            lambda i: F.struct(
                i.alias("idx"), (F.col("run_nr") % 1000 * (i + 1)).alias("messageCount")
            ),
        ).alias("rounds"),
    )


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested ``(experiment, inputs, outputs)`` records of the same runs."""
    run = run_log(spark, sf_dir)
    nanos = F.floor(F.col("duration_s") * 1_000_000_000)

    def repeated(kind: str, times: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), times.cast("int")), lambda i: F.struct(F.lit(kind).alias("type"))
        )

    edges = F.concat(
        repeated("operation", F.col("iterations") + 2),
        repeated("pregelIteration", F.col("iterations")),
    )
    sizes = F.array(
        *[F.struct(F.floor(F.col("total_size") / part).alias("size")) for part in (1, 2, 3)]
    )
    return run.select(
        F.concat(F.lit("experiment-"), F.col("run_nr").cast("string")).alias("experiment"),
        F.struct(
            F.struct(
                "setup", "algorithm", "dataset", F.col("run_nr").alias("runNr"),
                F.col("storage_format").alias("storageFormat"),
                (F.col("run_nr") % 8).alias("numExecutors"),
            ).alias("parameters")
        ).alias("inputs"),
        F.struct(
            F.struct(edges.alias("edges")).alias("graph"),
            sizes.alias("sizes"),
            F.struct(nanos.cast("double").alias("amount")).alias("duration"),
        ).alias("outputs"),
    )


def dataset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(graph, n_vertices, algorithms)``: one descriptor per dataset."""
    customer = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .groupBy(one_of(DATASETS, customer).alias("graph"))
        .agg(
            F.count(F.lit(1)).alias("n_vertices"),
            F.sort_array(F.collect_set(one_of(ALGORITHMS, customer))).alias("algorithms"),
        )
    )
