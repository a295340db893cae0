"""The ten-vertex example graph and its published results."""

from trailgraph.graph import PropertyGraph

MAX = 9223372036854775807
INF = float("inf")

EDGES = [
    (1, 3, 0.5), (1, 5, 0.3), (2, 4, 0.1), (2, 5, 0.3), (2, 10, 0.12), (3, 1, 0.53),
    (3, 5, 0.62), (3, 8, 0.21), (3, 10, 0.52), (5, 3, 0.69), (5, 4, 0.53), (5, 8, 0.1),
    (6, 3, 0.23), (6, 4, 0.39), (7, 4, 0.83), (8, 1, 0.39), (9, 4, 0.69),
]

BFS = {1: 0, 2: MAX, 3: 1, 4: 2, 5: 1, 6: MAX, 7: MAX, 8: 2, 9: MAX, 10: 2}
SSSP = {1: 0.0, 2: INF, 3: 0.5, 4: 0.83, 5: 0.3, 6: INF, 7: INF, 8: 0.4, 9: INF, 10: 1.02}
WCC = {i: 1 for i in range(1, 11)}
PAGERANK = {
    1: 0.1477629166666667, 2: 0.04753375, 3: 0.1550469444444444, 4: 0.1597573611111111,
    5: 0.14624, 6: 0.04753375, 7: 0.04753375, 8: 0.1135740277777778, 9: 0.04753375,
    10: 0.08748375,
}
CDLP = {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1, 7: 2, 8: 3, 9: 2, 10: 1}
LCC = {
    1: 0.6666666666666666, 2: 0.1666666666666667, 3: 0.15, 4: 0.05, 5: 0.25,
    6: 0.0, 7: 0.0, 8: 0.8333333333333334, 9: 0.0, 10: 0.0,
}


def graph(spark, edges=EDGES, vertices=range(1, 11)):
    edge_frame = spark.createDataFrame(list(edges), "src long, dst long, attr double")
    vertex_frame = spark.createDataFrame([(v,) for v in vertices], "id long")
    return PropertyGraph.from_edges(edge_frame, vertex_frame)


def result(found):
    return {row["id"]: row["attr"] for row in found.vertices.collect()}
