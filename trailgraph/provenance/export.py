"""The provenance graph as JSON and DOT lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.provenance.events import ALGORITHM_PARAMETERS
from trailgraph.provenance.tables import typed

# Edge colours of the drawn graph; anything else is black.
EDGE_COLOURS = {
    "operation": "indianred2",
    "pregel": "green",
    "pregelStart": "darkviolet",
    "pregelIteration": "darkorchid1",
}
ALGORITHM_COLOUR = "darkorange"
#: Metrics in one line of an export, about.
PART_METRICS = 1_000
COLOURED_ALGORITHMS = ["PageRank", "BFS", "SSSP", "WCC"]
NODE_COLOUR = "cadetblue1"


def relationship() -> Column:
    """The event of a ``prov_edges`` row as text, such as ``BFS(1)``."""
    name = F.col("event_name")
    text = F.when(F.col("event_type") == "operation", F.concat(F.lit("Operation("), name, F.lit(")")))
    for algorithm, parameters in ALGORITHM_PARAMETERS.items():
        values = [F.element_at("params", parameter) for parameter in parameters]
        arguments = F.concat_ws(",", *values) if values else F.lit("")
        text = text.when(
            (F.col("event_type") == "algorithm") & (name == algorithm),
            F.concat(F.lit(f"{algorithm}("), arguments, F.lit(")")),
        )
    number = F.coalesce(F.element_at("params", "i"), F.lit(""))
    return text.otherwise(F.concat(name, F.lit("("), number, F.lit(")")))


def _amount() -> Column:
    """A metric as text, whole numbers with all of their digits."""
    return F.coalesce("text", F.col("exact").cast("string"), F.col("value").cast("bigint").cast("string"))


def json_edges(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON object per provenance edge, with the metrics taken on it.

    The metrics of an edge are a set, so copies are dropped before they are
    gathered.  An edge with more than ``PART_METRICS`` of them has several lines,
    with a ``part`` of its metrics each, so that no row holds them all.  Times
    and gauges are written as text.
    """
    amount = _amount()
    item = F.struct(
        F.col("kind").alias("type"),
        "name",
        F.struct(amount.alias("amount"), "unit").alias("value"),
    )
    sets = (
        typed(metrics).filter("owner = 'edge'")
        .select("run_id", F.col("owner_id").alias("seq"), item.alias("item"))
        .distinct()
    )
    counts = sets.groupBy("run_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    several = F.ceil(F.col("n") / PART_METRICS)
    many = counts.filter(F.col("n") > PART_METRICS).select("run_id", "seq", several.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("item"), F.col("parts")), F.lit(0)).cast("int")
    sets = (
        sets.join(many, ["run_id", "seq"], "left")
        .groupBy("run_id", "seq", part.alias("part"))
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    item_type = (
        "array<struct<type: string, name: string, value: struct<amount: string, unit: string>>>"
    )
    values = F.array(F.coalesce("items", F.array().cast(item_type)))
    return edges.join(sets, ["run_id", "seq"], "left").select(
        "run_id",
        "seq",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.to_json(
            F.struct(
                "source",
                "target",
                relationship().alias("relationship"),
                F.col("event_type").alias("type"),
                F.struct(F.lit("ObservationSet").alias("type"), values.alias("values")).alias(
                    "metrics"
                ),
            )
        ).alias("line"),
    )


def json_nodes(nodes: DataFrame) -> DataFrame:
    """One JSON object per provenance node; the location is empty if not stored."""
    location = F.coalesce("location", F.lit(""))
    return nodes.select(
        "run_id",
        "node_id",
        F.to_json(F.struct(F.col("node_id").alias("id"), location.alias("location"))).alias("line"),
    )


def json_node_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON object per metric of a provenance node, copies dropped.

    A node may have any number of metrics, so they are rows and not one list.
    A time has an amount and a unit; gauges and counters are written as text.
    """
    amount = _amount()
    head = [F.col("owner_id").alias("graphID"), F.col("kind").alias("type"), F.col("name")]
    timed = F.to_json(F.struct(*head, F.struct(amount.alias("amount"), "unit").alias("value")))
    plain = F.to_json(F.struct(*head, F.coalesce("text", F.col("exact").cast("string"), F.col("value").cast("string")).alias("value")))
    return (
        typed(metrics).filter("owner = 'node'")
        .select(
            "run_id",
            F.col("owner_id").alias("node_id"),
            "name",
            F.when(F.col("unit").isNotNull(), timed).otherwise(plain).alias("line"),
        )
        .distinct()
    )


def dot_edges(edges: DataFrame) -> DataFrame:
    colour = F.when(
        (F.col("event_type") == "algorithm") & F.col("event_name").isin(COLOURED_ALGORITHMS),
        ALGORITHM_COLOUR,
    )
    for event_type, name in EDGE_COLOURS.items():
        colour = colour.when(F.col("event_type") == event_type, name)
    return edges.select(
        "run_id",
        F.format_string(
            '  "G%s" -> "G%s" [label="%s", color="%s", fontcolor="%s", style="filled"]',
            F.col("source"),
            F.col("target"),
            relationship(),
            colour.otherwise("black"),
            colour.otherwise("black"),
        ).alias("line"),
    )


def dot_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "run_id",
        F.format_string(
            f'  "G%s" [fillcolor="{NODE_COLOUR}", style="filled", label="G%s\\n%s"]',
            F.col("node_id"),
            F.col("node_id"),
            F.coalesce("location", F.lit("")),
        ).alias("line"),
    )


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(run_id, part, line)``: the lines of one DOT digraph per run.

    ``part`` orders the lines: opening, nodes, edges, closing.
    """
    runs = nodes.select("run_id").distinct()
    return (
        runs.select("run_id", F.lit(0).alias("part"), F.lit("digraph {").alias("line"))
        .unionByName(dot_nodes(nodes).withColumn("part", F.lit(1)))
        .unionByName(dot_edges(edges).withColumn("part", F.lit(2)))
        .unionByName(runs.select("run_id", F.lit(3).alias("part"), F.lit("}").alias("line")))
    )
