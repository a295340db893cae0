"""The registered queries again, as SQL for another engine.

Iterative ones are chains of materialised CTEs with a fixed number of rounds,
more than the test tables need to settle.
"""

from __future__ import annotations

from trailgraph.functions.text import SIZE_UNITS
from trailgraph.views import ALGORITHMS, DATASETS, FORMATS, SETUPS, SIZE_KINDS

MAX = 9223372036854775807
BFS_ROUNDS = 16
SSSP_ROUNDS = 32
WCC_ROUNDS = 40

ORACLES: dict[str, str] = {}


def _one_of(values: list[str], number: str) -> str:
    items = ", ".join(f"'{value}'" for value in values)
    return f"([{items}])[CAST({number} AS BIGINT) % {len(values)} + 1]"


# graphs


PART_SEQ = """
        e AS MATERIALIZED (
            SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_extendedprice) AS attr
            FROM lineitem a JOIN lineitem b
              ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
            GROUP BY 1, 2),
        v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
LINE_SEQ = """
        v AS MATERIALIZED (SELECT DISTINCT l_orderkey * 16 + l_linenumber AS id FROM lineitem),
        e AS MATERIALIZED (
            SELECT l_orderkey * 16 + l_linenumber AS src, l_orderkey * 16 + l_linenumber + 1 AS dst,
                   min(l_extendedprice) AS attr
            FROM lineitem
            WHERE l_orderkey * 16 + l_linenumber + 1 IN (SELECT id FROM v) GROUP BY 1, 2)"""
PART_GRAPH = f"""{PART_SEQ},
        pv AS MATERIALIZED (
            SELECT ids.id, CAST(p_size AS BIGINT) AS attr
            FROM (SELECT id FROM v UNION SELECT p_partkey FROM part) ids
            LEFT JOIN part ON p_partkey = ids.id)"""
CUST_SUPP = """
        e AS MATERIALIZED (
            SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, max(l_extendedprice) AS attr
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
        v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
OUT = "(SELECT src AS id, count(*) AS n FROM e GROUP BY 1)"


def _on(graph: str, select: str) -> str:
    return f"WITH {graph}\n{select}"


ORACLES["edge_list"] = _on(PART_SEQ, "SELECT src, dst, attr FROM e")
ORACLES["graph_vertices"] = _on(PART_SEQ, "SELECT id FROM v")
ORACLES["num_vertices"] = _on(CUST_SUPP, "SELECT count(*) AS num_vertices FROM v")
ORACLES["out_degrees"] = _on(PART_SEQ, f"SELECT id, n AS attr FROM {OUT}")
ORACLES["vertices_minus_dangling"] = _on(
    CUST_SUPP, "SELECT id FROM v WHERE id NOT IN (SELECT src FROM e)"
)
ORACLES["map_vertices"] = _on(PART_GRAPH, "SELECT id, id * 10 + attr AS attr FROM pv")
ORACLES["map_edges"] = _on(
    PART_SEQ, "SELECT src, dst, round(attr + src - dst, 6) AS attr FROM e"
)
ORACLES["map_triplets_invdeg"] = _on(
    PART_SEQ, f"SELECT src, dst, 1.0::DOUBLE / n AS attr FROM e JOIN {OUT} d ON d.id = src"
)
ORACLES["triplets"] = _on(
    PART_GRAPH,
    """SELECT src, dst, e.attr, s.attr AS src_attr, d.attr AS dst_attr
       FROM e JOIN pv s ON s.id = src JOIN pv d ON d.id = dst""",
)
ORACLES["join_vertices"] = _on(
    PART_GRAPH,
    f"""SELECT pv.id, CASE WHEN n IS NULL THEN attr ELSE attr * 1000 + n END AS attr
        FROM pv LEFT JOIN (SELECT * FROM {OUT} WHERE n > 3) d ON d.id = pv.id""",
)
ORACLES["outer_join_vertices"] = _on(
    PART_GRAPH,
    f"SELECT pv.id, coalesce(n, -1) AS attr FROM pv LEFT JOIN {OUT} d ON d.id = pv.id",
)
ORACLES["inner_join_vertices"] = _on(
    CUST_SUPP, "SELECT id, id % 7 AS attr FROM v WHERE id NOT IN (SELECT src FROM e)"
)
ORACLES["remove_self_edges"] = _on(PART_SEQ, "SELECT src, dst, attr FROM e WHERE src <> dst")
ORACLES["subgraph"] = _on(
    PART_GRAPH,
    """SELECT src, dst, e.attr FROM e JOIN pv s ON s.id = src JOIN pv d ON d.id = dst
       WHERE s.attr > 10 AND d.attr > 10 AND e.attr > 2000 AND s.attr <= d.attr""",
)
ORACLES["subgraph_vertices"] = _on(PART_GRAPH, "SELECT id, attr FROM pv WHERE attr > 10")
ORACLES["canonical_edges"] = _on(
    PART_SEQ,
    """SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(attr) AS attr
       FROM e GROUP BY 1, 2""",
)
ORACLES["collect_edges"] = _on(
    CUST_SUPP,
    """SELECT id, other // 1000 AS part,
              string_agg(src || ':' || dst || ':' || CAST(round(attr * 100) AS BIGINT), ','
                         ORDER BY src, dst, attr) AS edges
       FROM (SELECT src AS id, dst AS other, * FROM e UNION ALL SELECT dst, src, * FROM e)
       GROUP BY 1, 2""",
)
ORACLES["collect_neighbors"] = _on(
    PART_GRAPH,
    """SELECT src AS id, dst // 1000 AS part,
              string_agg(dst || ':' || pv.attr, ',' ORDER BY dst, pv.attr) AS neighbors
       FROM e JOIN pv ON pv.id = dst GROUP BY 1, 2""",
)
ORACLES["aggregate_messages_sum"] = _on(
    PART_GRAPH,
    """SELECT id, CAST(sum(msg) AS BIGINT) AS msg FROM (
         SELECT dst AS id, s.attr AS msg FROM e JOIN pv s ON s.id = src JOIN pv d ON d.id = dst
         WHERE s.attr > d.attr
         UNION ALL SELECT src, d.attr * 2 FROM e JOIN pv d ON d.id = dst)
       GROUP BY id""",
)
ORACLES["aggregate_messages_min"] = _on(
    PART_SEQ, "SELECT dst AS id, min(attr) AS msg FROM e GROUP BY dst"
)


# algorithms


def _lowering(graph: str, first: str, message: str, edges: str, rounds: int) -> str:
    """CTEs d0 … d<rounds> of the minimum of the own value and the messages."""
    steps = [f"d0 AS MATERIALIZED (SELECT id, {first} AS x FROM v)"]
    for k in range(rounds):
        steps.append(
            f"""d{k + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (
                  SELECT id, x FROM d{k} UNION ALL
                  SELECT dst, {message} FROM d{k} JOIN {edges} ON src = id {_reached(first)})
                GROUP BY id)"""
        )
    return graph + ",\n" + ",\n".join(steps)


def _reached(first: str) -> str:
    return f"WHERE x < {MAX}" if str(MAX) in first else ""


_SOURCE = "CASE WHEN id = (SELECT min(id) FROM v) THEN {} ELSE {} END"
_HOPS = _lowering(
    PART_SEQ, _SOURCE.format("0::BIGINT", f"{MAX}::BIGINT"), "x + 1", "e", BFS_ROUNDS
)
_WEIGHTED = _SOURCE.format("0::DOUBLE", "'Infinity'::DOUBLE")
_TWO_WAY = "(SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"

ORACLES["bfs_part_seq"] = _on(_HOPS, f"SELECT id, x AS depth FROM d{BFS_ROUNDS}")
ORACLES["sssp_part_seq"] = _on(
    _lowering(PART_SEQ, _WEIGHTED, "x + attr", "e", SSSP_ROUNDS),
    f"SELECT id, round(x, 4) AS dist FROM d{SSSP_ROUNDS}",
)
ORACLES["sssp_line_seq"] = _on(
    _lowering(LINE_SEQ, _WEIGHTED, "x + attr", "e", SSSP_ROUNDS),
    f"""SELECT id, CASE WHEN isinf(x) THEN 'infinity' ELSE printf('%.2f', x) END AS dist
        FROM d{SSSP_ROUNDS}""",
)
ORACLES["wcc_line_seq"] = _on(
    _lowering(LINE_SEQ, "id", "x", _TWO_WAY, WCC_ROUNDS),
    f"SELECT id, x AS component FROM d{WCC_ROUNDS}",
)
ORACLES["wcc_line_seq_3_rounds"] = _on(
    _lowering(LINE_SEQ, "id", "x", _TWO_WAY, 3), "SELECT id, x AS component FROM d3"
)


def _ranks(graph: str, rounds: int) -> str:
    steps = [
        f"o AS MATERIALIZED (SELECT v.id, coalesce(n, 0) AS n FROM v LEFT JOIN {OUT} d USING (id))",
        "c AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS total FROM v)",
        "r0 AS MATERIALIZED (SELECT id, n, 1 / total AS x FROM o, c)",
    ]
    for k in range(rounds):
        steps.append(
            f"""g{k} AS MATERIALIZED (
                  SELECT dst AS id, sum(x / n) AS got FROM r{k} JOIN e ON src = id GROUP BY dst)"""
        )
        steps.append(
            f"""r{k + 1} AS MATERIALIZED (
                  SELECT r.id, n, (1 - 0.85::DOUBLE) / total + 0.85::DOUBLE * (coalesce(got, 0)
                    + (SELECT coalesce(sum(x), 0) FROM r{k} WHERE n = 0) / total) AS x
                  FROM r{k} r LEFT JOIN g{k} g ON g.id = r.id, c)"""
        )
    return graph + ",\n" + ",\n".join(steps)


ORACLES["pagerank_line_seq_10"] = _on(_ranks(LINE_SEQ, 10), "SELECT id, round(x, 10) AS rank FROM r10")
ORACLES["pagerank_part_seq_5"] = _on(
    _ranks(PART_SEQ, 5), "SELECT id, round(x, 10) AS rank FROM r5"
)


def _labels(graph: str, rounds: int) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT id, id AS x FROM v)"]
    for k in range(rounds):
        steps.append(
            f"""l{k + 1} AS MATERIALIZED (
                  SELECT l.id, coalesce(b.x, l.x) AS x FROM l{k} l LEFT JOIN (
                    SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY n DESC, x) AS place
                    FROM (SELECT dst AS id, x, count(*) AS n FROM {_TWO_WAY}
                          JOIN l{k} s ON s.id = src GROUP BY 1, 2)) b
                  ON b.id = l.id AND place = 1)"""
        )
    return graph + ",\n" + ",\n".join(steps)


ORACLES["cdlp_part_seq_3"] = _on(_labels(PART_SEQ, 3), "SELECT id, x AS label FROM l3")
ORACLES["lcc_part_seq"] = _on(
    f"""{PART_SEQ},
        both_ways AS MATERIALIZED (SELECT DISTINCT src AS u, dst AS x FROM {_TWO_WAY} WHERE src <> dst),
        links AS MATERIALIZED (
            SELECT a.u, count(*) AS links FROM both_ways a JOIN both_ways b ON a.u = b.u
            JOIN e ON e.src = a.x AND e.dst = b.x WHERE e.src <> e.dst GROUP BY 1),
        near AS MATERIALIZED (SELECT u, count(*) AS n FROM both_ways GROUP BY 1)""",
    """SELECT id, round(CASE WHEN n >= 2 THEN coalesce(links, 0) / CAST(n AS DOUBLE) / (n - 1)
                        ELSE 0.0::DOUBLE END, 10) AS coeff
       FROM v LEFT JOIN near ON near.u = id LEFT JOIN links ON links.u = id""",
)


def _raising(rounds: int) -> str:
    steps = ["m0 AS MATERIALIZED (SELECT id, greatest(attr, -1) AS x FROM pv)"]
    for k in range(rounds):
        steps.append(
            f"""m{k + 1} AS MATERIALIZED (SELECT id, max(x) AS x FROM (
                  SELECT id, x FROM m{k} UNION ALL
                  SELECT dst, x FROM m{k} JOIN e ON src = id) GROUP BY id)"""
        )
    return PART_GRAPH + ",\n" + ",\n".join(steps)


ORACLES["pregel_max_value"] = _on(_raising(BFS_ROUNDS), f"SELECT id, x AS attr FROM m{BFS_ROUNDS}")
ORACLES["verified_result"] = _on(
    _HOPS,
    f"""SELECT id, id % 7 = 0 AS missing FROM d{BFS_ROUNDS}
        WHERE id % 7 = 0 OR (x < {MAX} AND id % 7 IN (1, 3))""",
)


# provenance of runs

_DEPTHS = f"""{_HOPS},
        depth AS MATERIALIZED (SELECT id, x FROM d{BFS_ROUNDS}),
        rounds AS MATERIALIZED (
            SELECT unnest(range(0, (SELECT max(x) FROM depth WHERE x < {MAX}))) AS i)"""


def _state(round_number: str) -> str:
    return f"CASE WHEN x <= {round_number} + 1 THEN x ELSE {MAX}::BIGINT END"


ORACLES["bfs_rounds"] = _on(
    _DEPTHS,
    """SELECT CAST(i AS INTEGER) AS round, count(x) AS messages
       FROM rounds LEFT JOIN depth ON x = i + 2 GROUP BY 1""",
)
ORACLES["observed_rounds"] = _on(
    _DEPTHS,
    f"""SELECT CAST(i AS INTEGER) AS round, name,
              CASE name WHEN 'reached' THEN count_if(x <= i + 1) WHEN 'lowest' THEN min(x)
                ELSE max(CASE WHEN x <= i + 1 THEN x END) END AS value
        FROM rounds, depth, (VALUES ('reached'), ('lowest'), ('deepest')) AS names(name)
        GROUP BY i, name""",
)
ORACLES["snapshot_edges"] = _on(
    _DEPTHS,
    """SELECT 3 + i AS node_id, src, dst, attr AS value
       FROM rounds, e JOIN depth AS a ON a.id = src JOIN depth AS b ON b.id = dst
       WHERE a.x <= i + 1 AND b.x <= i + 1""",
)
ORACLES["aggregate_messages_gcd"] = _on(
    PART_SEQ, "SELECT dst AS id, list_reduce(list(src), lambda a, b: gcd(a, b)) AS msg FROM e GROUP BY 1"
)
ORACLES["prov_edges_bfs"] = _on(
    f"""{_DEPTHS},
        k AS (SELECT count(*) AS n FROM rounds),
        source AS (SELECT min(id) AS id FROM v)""",
    """SELECT 0::BIGINT AS seq, 0::BIGINT AS source, 1::BIGINT AS target,
              'operation' AS event_type, 'Operation(mapVertices)' AS relationship
       UNION ALL SELECT 1, 1, 2, 'operation', 'Operation(mapVertices)'
       UNION ALL SELECT 2, 1, 2, 'pregelStart', 'PregelLifecycleStart()'
       UNION ALL SELECT 3 + 2 * i, 2 + i, 3 + i, 'operation', 'Operation(joinVertices)' FROM rounds
       UNION ALL SELECT 4 + 2 * i, 2 + i, 3 + i, 'pregelIteration', 'PregelIteration(' || i || ')'
         FROM rounds
       UNION ALL SELECT 3 + 2 * n, 1, 2 + n, 'pregel', 'PregelAlgorithm()' FROM k
       UNION ALL SELECT 4 + 2 * n, 0, 2 + n, 'algorithm', 'BFS(' || id || ')' FROM k, source""",
)
_ROUND_SNAPSHOTS = f"""SELECT 3 + i AS node_id, 'joinVertices' AS event_name,
              CAST(i AS INTEGER) AS iteration, id, {_state("i")} AS value
       FROM rounds, depth"""
_SNAPSHOTS = f"""SELECT CAST(g AS BIGINT) AS node_id, 'mapVertices' AS event_name,
              CAST(NULL AS INTEGER) AS iteration, id, x AS value
       FROM d0, (SELECT unnest([1, 2]) AS g)
       UNION ALL {_ROUND_SNAPSHOTS}"""
ORACLES["snapshot_bfs"] = _on(_DEPTHS, _SNAPSHOTS)
# A line of the text format is "(id,value)" and its end.
ORACLES["snapshot_size_totals"] = _on(
    _DEPTHS,
    f"""SELECT node_id, CAST(sum(length('(' || id || ',' || value || ')') + 1) AS BIGINT) AS size
        FROM ({_SNAPSHOTS}) WHERE value < {MAX} GROUP BY 1""",
)
ORACLES["snapshot_bfs_pruned"] = _on(
    _DEPTHS, f"SELECT * FROM ({_ROUND_SNAPSHOTS}) WHERE value < {MAX}"
)
ORACLES["delta_capture"] = _on(
    _DEPTHS,
    f"""SELECT 3 + i AS node_id, 'joinVertices' AS event_name,
              CAST(i AS INTEGER) AS iteration, id, {_state("i - 1")} AS value
       FROM rounds, depth JOIN part ON p_partkey = id WHERE p_size >= 25""",
)
ORACLES["snapshot_pagerank_pruned"] = _on(
    _ranks(LINE_SEQ, 3),
    "SELECT 1::BIGINT AS node_id, 'outerJoinVertices' AS event_name, "
    "CAST(NULL AS INTEGER) AS iteration, id, CAST(n AS DOUBLE) AS value FROM o WHERE n <> 0"
    + "".join(
        f" UNION ALL SELECT {3 + k}, 'outerJoinVertices', {k - 1}, id, round(x, 10) FROM r{k}"
        for k in (1, 2, 3)
    ),
)


# provenance tables of many runs

_KIND = "CAST(l_quantity AS BIGINT) % 6"
_PROV = f"""
        pe AS (
            SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber AS BIGINT) AS seq,
                   CAST(l_linenumber - 1 AS BIGINT) AS source,
                   CAST(l_linenumber AS BIGINT) AS target,
                   CASE {_KIND} WHEN 3 THEN 'pregelIteration' WHEN 5 THEN 'algorithm'
                     ELSE 'operation' END AS event_type,
                   CASE {_KIND} WHEN 0 THEN 'joinVertices' WHEN 1 THEN 'mapVertices'
                     WHEN 2 THEN 'outerJoinVertices' WHEN 3 THEN 'PregelIteration'
                     WHEN 4 THEN 'unpersist' ELSE 'BFS' END AS event_name,
                   CASE {_KIND} WHEN 3 THEN 'PregelIteration(' || l_linenumber || ')'
                     WHEN 5 THEN 'BFS(' || l_suppkey || ')'
                     WHEN 0 THEN 'Operation(joinVertices)' WHEN 1 THEN 'Operation(mapVertices)'
                     WHEN 2 THEN 'Operation(outerJoinVertices)'
                     ELSE 'Operation(unpersist)' END AS relationship
            FROM lineitem),
        pn AS (
            SELECT run_id, node_id,
                   CASE WHEN (CAST(run_id AS BIGINT) + node_id) % 5 = 0
                        THEN 'snapshots/' || run_id || '/' || node_id END AS location
            FROM (SELECT run_id, source AS node_id FROM pe UNION SELECT run_id, target FROM pe))"""

ORACLES["prov_filter_joinvertices"] = _on(
    _PROV,
    """SELECT run_id, seq, source, target, event_type, event_name FROM pe
       WHERE event_type = 'operation' AND event_name = 'joinVertices'
         AND (CAST(run_id AS BIGINT) + source) % 5 <> 0
         AND (CAST(run_id AS BIGINT) + target) % 5 <> 0""",
)
ORACLES["prov_filter_nodes"] = _on(_PROV, "SELECT * FROM pn WHERE location IS NOT NULL")
ORACLES["prov_node_by_id"] = _on(_PROV, "SELECT * FROM pn WHERE run_id = '7' AND node_id = 2")
ORACLES["capture_decision"] = _on(
    _PROV,
    """SELECT run_id, target, seq, source, event_type, event_name FROM (
         SELECT pe.*, row_number() OVER (
           PARTITION BY run_id, target ORDER BY seq, source, event_type, event_name) AS place
         FROM pe JOIN pn USING (run_id)
         WHERE node_id = target AND location IS NULL
           AND event_name NOT IN ('mapVertices', 'unpersist'))
       WHERE place = 1""",
)
ORACLES["capture_decision_by_metric"] = _on(
    f"""{_PROV}, active AS (
         SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber AS BIGINT) AS node_id, max(l_quantity) AS most
         FROM lineitem GROUP BY 1, 2),
       busy AS (SELECT run_id, node_id FROM pn JOIN active USING (run_id, node_id)
                WHERE most > 10 AND (location IS NULL OR node_id > 2))""",
    """SELECT run_id, target, seq, source, event_type, event_name FROM (
         SELECT pe.*, row_number() OVER (
           PARTITION BY run_id, target ORDER BY seq, source, event_type, event_name) AS place
         FROM pe JOIN pn USING (run_id)
         WHERE node_id = target AND location IS NULL AND event_name <> 'unpersist'
           AND (run_id, source) IN (SELECT (run_id, node_id) FROM busy)
           AND (run_id, target) IN (SELECT (run_id, node_id) FROM busy))
       WHERE place = 1""",
)
ORACLES["appended_runs"] = """
       SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_id AS source, event_id + 1 AS target,
              'operation' AS event_type, event_type AS event_name FROM events"""
ORACLES["typed_metric_totals"] = """
       SELECT CAST(user_id AS VARCHAR) AS run_id, kind, name, count(*) AS observations,
              CAST(sum(exact) AS DECIMAL(38, 0)) AS exact_total, CAST(max(exact) AS DECIMAL(38, 0)) AS exact_highest,
              min(label) AS first_text, max(label) AS last_text
       FROM (SELECT user_id, 'counter' AS kind, 'bytes' AS name,
                    event_id::HUGEINT * 9007199254740993 AS exact, NULL AS label FROM events
             UNION ALL SELECT DISTINCT ON (user_id, event_id) user_id, 'gauge', 'state', NULL, event_type FROM events)
       GROUP BY ALL"""
ORACLES["paired_files"] = """
       SELECT CAST(user_id % 10 AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) AS run,
              'A' || (user_id % 3) AS algorithm, 'G' || (user_id % 5) AS dataset,
              count(*) / 2.0::DOUBLE AS with_lineage, count(*) / 4.0::DOUBLE AS without_lineage,
              CAST(count(DISTINCT event_type) AS INTEGER) AS iterations, CAST(user_id AS VARCHAR) AS lineage_id
       FROM events GROUP BY user_id"""
ORACLES["storage_overhead"] = """
       WITH stored AS (
         SELECT CAST(l_suppkey AS VARCHAR) AS lineage_id, sum(l_linenumber) AS bytes FROM lineitem GROUP BY 1
       ), plain AS (
         SELECT 'A' || (c_custkey % 3) AS algorithm, 'G' || (c_custkey % 5) AS dataset, max(c_custkey) AS bytes
         FROM customer GROUP BY 1, 2
       ), first AS (
         SELECT 'A' || (user_id % 3) AS algorithm, 'G' || (user_id % 5) AS dataset,
                arg_min(CAST(user_id AS VARCHAR), 'r' || CAST(user_id AS VARCHAR)) AS lineage_id
         FROM events WHERE user_id IN (SELECT l_suppkey FROM lineitem) GROUP BY 1, 2
       )
       SELECT algorithm, dataset, round(stored.bytes / plain.bytes, 8) AS fraction
       FROM first JOIN stored USING (lineage_id) JOIN plain USING (algorithm, dataset)"""
ORACLES["ordered_result"] = _on(
    PART_GRAPH,
    """SELECT row_number() OVER (ORDER BY id) AS place, concat_ws(' ', id, attr) AS line FROM pv""",
)
_METRICS = """
        pm AS (
            SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS run_id, 'edge' AS owner,
                   CAST(l_linenumber AS BIGINT) AS owner_id, 'time' AS kind,
                   'operationTime' AS name, floor(l_extendedprice) AS value
            FROM lineitem
            UNION ALL
            SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'node', CAST(l_linenumber AS BIGINT),
                   'gauge', 'activeMessages', l_quantity
            FROM lineitem)"""
ORACLES["metric_totals"] = _on(
    _METRICS,
    """SELECT run_id, owner, kind, name, count(*) AS observations, round(sum(value), 4) AS total,
              min(value) AS lowest, max(value) AS highest
       FROM pm GROUP BY 1, 2, 3, 4""",
)
ORACLES["counter_values"] = """
       SELECT CAST(user_id AS VARCHAR) AS run_id, 'steps' AS name,
              CAST(sum(CASE WHEN event_type = 'error' THEN -1
                            WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS value
       FROM events GROUP BY 1"""
ORACLES["prov_json_lines"] = _on(
    f"{_PROV}, {_METRICS}",
    """SELECT pe.run_id, pe.seq,
              '{"source":' || source || ',"target":' || target || ',"relationship":"' ||
              relationship || '","type":"' || event_type ||
              '","metrics":{"type":"ObservationSet","values":[[' || items || ']]}}' AS line
       FROM pe JOIN (
         SELECT run_id, owner_id AS seq, string_agg(
                  '{"type":"time","name":"operationTime","value":{"amount":"' ||
                  CAST(value AS BIGINT) || '","unit":"ns"}}', ','
                  ORDER BY CAST(CAST(value AS BIGINT) AS VARCHAR)) AS items
         FROM pm WHERE owner = 'edge' GROUP BY 1, 2) USING (run_id, seq)""",
)
ORACLES["prov_json_nodes"] = _on(
    _PROV,
    """SELECT run_id, node_id,
              '{"id":' || node_id || ',"location":"' || coalesce(location, '') || '"}' AS line
       FROM pn""",
)
ORACLES["prov_json_node_metrics"] = _on(
    _METRICS,
    """SELECT DISTINCT run_id, owner_id AS node_id, name,
              '{"graphID":' || owner_id || ',"type":"gauge","name":"activeMessages","value":"' ||
              CAST(value AS VARCHAR) || '"}' AS line
       FROM pm WHERE owner = 'node'""",
)
ORACLES["prov_dot_lines"] = _on(
    _PROV,
    """SELECT run_id, 0 AS part, 'digraph {' AS line FROM (SELECT DISTINCT run_id FROM pn)
       UNION ALL SELECT run_id, 1, '  "G' || node_id ||
         '" [fillcolor="cadetblue1", style="filled", label="G' || node_id || '\\n' ||
         coalesce(location, '') || '"]' FROM pn
       UNION ALL SELECT run_id, 2, '  "G' || source || '" -> "G' || target || '" [label="' ||
         relationship || '", color="' || colour || '", fontcolor="' || colour ||
         '", style="filled"]'
         FROM (SELECT *, CASE event_type WHEN 'operation' THEN 'indianred2'
                 WHEN 'pregelIteration' THEN 'darkorchid1' ELSE 'darkorange' END AS colour FROM pe)
       UNION ALL SELECT run_id, 3, '}' FROM (SELECT DISTINCT run_id FROM pn)""",
)


# run-log reports

_RUNS = f"""
        runs AS (
            SELECT run_nr, algorithm, dataset, setup,
                   CASE WHEN setup = 'CompleteProvenance' THEN any_format
                        ELSE 'TextFile()' END AS storage_format,
                   CASE WHEN setup IN ('Baseline', 'Tracing') THEN 0 ELSE bytes END AS total_size,
                   duration_s, iterations, status
            FROM (SELECT o_orderkey AS run_nr, {_one_of(ALGORITHMS, "o_orderkey")} AS algorithm,
                         {_one_of(DATASETS, "o_custkey")} AS dataset,
                         {_one_of(SETUPS, "o_orderkey // 4")} AS setup,
                         {_one_of(FORMATS, "o_custkey // 6")} AS any_format,
                         CAST(floor(o_totalprice * 1000) AS BIGINT) AS bytes,
                         o_totalprice / 1000 AS duration_s, o_orderkey % 10 + 1 AS iterations,
                         CASE o_orderstatus WHEN 'F' THEN 'FAILURE' ELSE 'SUCCESS' END AS status
                  FROM orders))"""
_LABEL = r"""regexp_extract(storage_format, '^([A-Za-z]+?)(?:File|Format)?\(', 1)"""
_COMPRESSED = f"""(contains(storage_format, '(true)')
              OR lower({_LABEL}) IN ('parquet', 'orc', 'avro'))"""
_LABELLED = f"{_LABEL} || CASE WHEN {_COMPRESSED} THEN '-C' ELSE '' END"
_SIZES = f"""
        sizes AS (
            SELECT {_one_of(DATASETS, "c_custkey")} AS dataset,
                   {_one_of(SIZE_KINDS, "c_custkey // 6")} AS kind,
                   CAST(sum(CAST(floor(abs(c_acctbal) * 1000) AS BIGINT)) AS BIGINT) AS size
            FROM customer GROUP BY 1, 2)"""
_DATASETS = f"""
        datasets AS (
            SELECT {_one_of(DATASETS, "c_custkey")} AS graph, count(*) AS n_vertices,
                   list(DISTINCT {_one_of(ALGORITHMS, "c_custkey")}) AS algorithms
            FROM customer GROUP BY 1)"""


def _human_size(size: str) -> str:
    whens = " ".join(
        f"WHEN {size} >= {float(1024**k)!r} THEN CAST(CAST(floor({size} / {float(1024**k)!r}) "
        f"AS BIGINT) AS VARCHAR) || ' {SIZE_UNITS[k]}'"
        for k in range(len(SIZE_UNITS) - 1, 0, -1)
    )
    return f"CASE {whens} ELSE CAST(CAST(floor({size}) AS BIGINT) AS VARCHAR) || ' B' END"


ORACLES["run_normalised"] = _on(
    f"{_RUNS}, {_DATASETS}",
    f"""SELECT 'experiment-' || run_nr AS experiment, lower(setup) AS setup, algorithm, dataset,
               run_nr, {_LABELLED} AS storage_format, {_COMPRESSED} AS compressed,
               total_size + total_size // 2 + total_size // 3 AS total_size,
               run_nr % 8 AS n_executors, n_vertices, CAST(iterations AS INTEGER) AS iterations,
               CAST(iterations + 2 AS INTEGER) AS n_operations,
               round(floor(duration_s * 1000000000) / 1e9, 5) AS duration_s
        FROM runs LEFT JOIN datasets ON graph = dataset""",
)
ORACLES["setup_flags"] = _on(
    _RUNS,
    """SELECT setup, setup <> 'Baseline' AS tracing,
              setup NOT IN ('Baseline', 'Tracing') AS storage, count(*) AS runs
       FROM runs GROUP BY 1, 2, 3""",
)
_STATS = """min({0}) AS min, avg({0}) AS mean, max({0}) AS max, stddev_samp({0}) AS std"""
ORACLES["run_stats"] = _on(
    _RUNS,
    f"""SELECT setup, algorithm, dataset, round(min, 6) AS min, round(mean, 6) AS mean,
               round(max, 6) AS max, round(std, 6) AS std
        FROM (SELECT setup, algorithm, dataset, {_STATS.format("duration_s")}
              FROM runs GROUP BY 1, 2, 3)""",
)
ORACLES["duration_table"] = _on(
    _RUNS,
    f"""SELECT setup, algorithm, replace(dataset, '_', '\\_') AS dataset, printf('%.2f', min) AS min,
               printf('%.2f', mean) AS mean, printf('%.2f', max) AS max, printf('%.2f', std) AS std
        FROM (SELECT setup, algorithm, dataset, {_STATS.format("duration_s")}
              FROM runs GROUP BY 1, 2, 3)""",
)
ORACLES["size_table"] = _on(
    _RUNS,
    f"""SELECT setup, algorithm, replace(dataset, '_', '\\_') AS dataset, {_human_size("min")} AS min,
               {_human_size("mean")} AS mean, {_human_size("max")} AS max
        FROM (SELECT setup, algorithm, dataset, {_STATS.format("total_size")}
              FROM runs GROUP BY 1, 2, 3)""",
)
_GRAPH_SIZES = f"""{_SIZES},
        graph_sizes AS (SELECT dataset, CAST(sum(size) AS BIGINT) AS size FROM sizes
                        WHERE kind IN ('vertices', 'edges') GROUP BY 1)"""
ORACLES["dataset_sizes"] = _on(
    _GRAPH_SIZES,
    f"SELECT dataset, size, {_human_size('size')} AS pretty_size FROM graph_sizes",
)
ORACLES["group_summary"] = _on(
    _RUNS,
    """SELECT setup, storage_format, count(*) AS runs,
              CAST(sum(total_size) AS BIGINT) AS total_size,
              CAST(sum(iterations) AS BIGINT) AS iterations,
              count(*) FILTER (total_size > 0) AS stored_runs,
              count(DISTINCT duration_s) AS distinct_durations,
              round(quantile_cont(duration_s, 0.5), 6) AS median_duration
       FROM runs GROUP BY 1, 2""",
)
_MEANS = """(SELECT algorithm, dataset, avg(duration_s) AS base FROM runs
             WHERE setup = 'Baseline' GROUP BY 1, 2)"""
ORACLES["run_overhead"] = _on(
    _RUNS,
    f"""SELECT run_nr, algorithm, dataset, round(duration_s / base, 6) AS overhead_duration
        FROM runs JOIN {_MEANS} USING (algorithm, dataset) WHERE setup <> 'Baseline'""",
)
ORACLES["run_size_overhead"] = _on(
    f"{_RUNS}, {_SIZES}",
    """SELECT run_nr, algorithm, runs.dataset, round(total_size / size, 6) AS overhead_size
       FROM runs JOIN sizes ON kind = algorithm AND sizes.dataset = runs.dataset
       WHERE total_size > 0""",
)
ORACLES["run_blowup"] = _on(
    f"{_RUNS}, {_GRAPH_SIZES}",
    """SELECT run_nr, algorithm, dataset, round(total_size / size, 6) AS blowup
       FROM runs JOIN graph_sizes USING (dataset)""",
)
_COMPARED = f"""{_RUNS},
        labelled AS (SELECT * REPLACE ({_LABELLED} AS storage_format) FROM runs
                     WHERE setup = 'CompleteProvenance'),
        plain AS (SELECT algorithm, dataset, avg(duration_s) AS d, avg(total_size) AS s
                  FROM labelled WHERE storage_format = 'Text' GROUP BY 1, 2)"""
ORACLES["format_compare"] = _on(
    _COMPARED,
    """SELECT run_nr, algorithm, dataset, storage_format,
              round(duration_s / d, 6) AS overhead_duration,
              round(total_size / s, 6) AS overhead_size
       FROM labelled JOIN plain USING (algorithm, dataset)""",
)
ORACLES["format_order"] = _on(
    _COMPARED,
    """SELECT algorithm, storage_format, round(avg(duration_s / d), 6) AS mean
       FROM labelled JOIN plain USING (algorithm, dataset) GROUP BY 1, 2""",
)
ORACLES["replaced_format"] = _on(
    _COMPARED,
    """SELECT storage_format, count(*) AS runs, CAST(sum(total_size) AS BIGINT) AS total_size
       FROM (SELECT storage_format, total_size FROM labelled WHERE storage_format <> 'Text'
             UNION ALL SELECT 'Text', total_size FROM runs WHERE setup = 'DataGraphPruning')
       GROUP BY 1""",
)
ORACLES["scenario_summary"] = _on(
    _RUNS,
    """SELECT setup AS scenario, count(*) AS runs, round(min(duration_s), 6) AS min,
              round(quantile_cont(duration_s, 0.25), 6) AS q1,
              round(quantile_cont(duration_s, 0.5), 6) AS median,
              round(quantile_cont(duration_s, 0.75), 6) AS q3, round(max(duration_s), 6) AS max
       FROM runs GROUP BY 1""",
)
ORACLES["scenario_size_summary"] = _on(
    _RUNS,
    """SELECT setup AS scenario, count(*) AS runs, min(total_size) AS min,
              round(quantile_cont(CAST(total_size AS DOUBLE), 0.25), 6) AS q1,
              round(quantile_cont(CAST(total_size AS DOUBLE), 0.5), 6) AS median,
              round(quantile_cont(CAST(total_size AS DOUBLE), 0.75), 6) AS q3,
              max(total_size) AS max
       FROM runs WHERE total_size > 1048576 GROUP BY 1""",
)
_FORMAT_ROWS = ", ".join(f"'{value}'" for value in FORMATS)
_SETUP_ROWS = ", ".join(f"'{value}'" for value in SETUPS)
ORACLES["run_coverage"] = _on(
    f"""{_RUNS}, {_DATASETS},
        planned AS (
            SELECT graph AS dataset, algorithm, setup,
                   unnest(CASE setup WHEN 'CompleteProvenance' THEN [{_FORMAT_ROWS}]
                          ELSE ['TextFile()'] END) AS storage_format
            FROM (SELECT graph, algorithm, unnest([{_SETUP_ROWS}]) AS setup
                  FROM (SELECT graph, unnest(algorithms) AS algorithm FROM datasets)
                  WHERE algorithm IN ('BFS', 'PageRank', 'WCC')))""",
    """SELECT dataset, algorithm, setup, storage_format, run_nr
       FROM planned, (SELECT unnest(range(1, (SELECT max(run_nr) // 24 + 2 FROM runs))) AS run_nr)
       EXCEPT ALL SELECT dataset, algorithm, setup, storage_format, run_nr // 24 + 1 FROM runs
       WHERE status = 'SUCCESS'""",
)
_PAIRED = f"""{_RUNS},
        paired AS (
            SELECT run_nr, algorithm, dataset, iterations, duration_s AS alone,
                   duration_s * (1 + CAST(run_nr % 7 AS DOUBLE) / 10) AS traced
            FROM runs)"""
ORACLES["messages_per_round"] = _on(
    _PAIRED,
    """SELECT CAST(run_nr AS VARCHAR) AS run, algorithm, dataset,
              CAST(i + 1 AS INTEGER) AS round, run_nr % 1000 * (i + 1) AS messages
       FROM (SELECT *, unnest(range(0, iterations)) AS i FROM paired)""",
)
ORACLES["iterations_per_dataset"] = _on(
    _PAIRED,
    """SELECT algorithm, dataset, round(avg(iterations), 6) AS mean,
              round(stddev_pop(iterations), 6) AS std
       FROM paired GROUP BY 1, 2""",
)


def _paired(ratio: str) -> str:
    return f"""SELECT algorithm, dataset, round(avg(o), 6) AS mean, round(stddev_pop(o), 6) AS std
       FROM (SELECT algorithm, dataset, CASE WHEN p > 100 THEN p - 100 ELSE p END AS o
             FROM (SELECT *, {ratio} * 100 AS p FROM paired)) GROUP BY 1, 2"""


ORACLES["paired_overhead"] = _on(_PAIRED, _paired("traced / alone"))
ORACLES["paired_overhead_per_round"] = _on(_PAIRED, _paired("traced / alone / iterations"))
ORACLES["overhead_describe"] = _on(
    _RUNS,
    f"""SELECT setup, algorithm, count(*) FILTER (o <= 0.6 OR o >= 2.0) AS left_out,
               printf('%.2f', stddev_samp(o) FILTER (o > 0.6 AND o < 2.0)) AS std,
               printf('%.2f', min(o) FILTER (o > 0.6 AND o < 2.0)) AS min,
               printf('%.2f', quantile_cont(o, 0.5) FILTER (o > 0.6 AND o < 2.0)) AS median,
               printf('%.2f', max(o) FILTER (o > 0.6 AND o < 2.0)) AS max
        FROM (SELECT setup, algorithm, duration_s / base AS o
              FROM runs JOIN {_MEANS} USING (algorithm, dataset) WHERE setup <> 'Baseline')
        GROUP BY ALL HAVING count_if(o > 0.6 AND o < 2.0) > 0""",
)
ORACLES["summed_baseline"] = _on(
    _RUNS,
    """SELECT run_nr, setup, algorithm, dataset, round(duration_s / base, 8) AS overhead
       FROM runs JOIN (SELECT algorithm, dataset, sum(duration_s) AS base FROM runs
                       WHERE setup = 'Baseline' GROUP BY 1, 2) USING (algorithm, dataset)
       WHERE setup <> 'Baseline'""",
)


ORACLES["report_filters"] = _on(
    _RUNS,
    """SELECT setup, count(*) AS runs, max(duration_s) AS longest FROM runs
       WHERE NOT (algorithm = 'WCC' AND dataset = 'datagen-8_8-zf')
         AND dataset <> 'graph500-22' AND duration_s <= 300
       GROUP BY 1""",
)


# text functions

ORACLES["human_size"] = f"""
       SELECT l_orderkey, l_linenumber, bytes, {_human_size("CAST(bytes AS DOUBLE)")} AS size
       FROM (SELECT l_orderkey, l_linenumber,
                    CAST(floor(l_extendedprice * 100) AS BIGINT) << ((l_linenumber - 1) * 6)
                      AS bytes
             FROM lineitem)"""


def _plural(count: str, unit: str) -> str:
    return f"""CASE WHEN {count} = 1 THEN '1 {unit}'
                    WHEN {count} > 1 THEN {count} || ' {unit}s' END"""


ORACLES["human_duration"] = f"""
       SELECT o_orderkey,
              concat_ws(' ', {_plural("s // 86400", "day")}, {_plural("s // 3600 % 24", "hour")},
                {_plural("s // 60 % 60", "minute")}, {_plural("s % 60", "second")}) AS duration,
              CASE WHEN t >= 3600 THEN printf('%dh %dm %ds', t // 3600, t // 60 % 60, t % 60)
                   ELSE printf('%02d:%02d', t // 60, t % 60) END AS clock
       FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 // 1000000000
                      AS s,
                    CAST(floor(o_totalprice) AS BIGINT) AS t
             FROM orders)"""
ORACLES["name_lists"] = """
       SELECT p_partkey, array_to_string(list_filter(list_transform(
                string_split(' #' || regexp_replace(p_name, ' +', ' , ', 'g') || ',, ' || p_brand,
                             ','), lambda w: trim(w)),
                lambda w: w <> '' AND NOT starts_with(w, '#')), '|') AS names
       FROM part"""


# files written and read again


_WEIGHT = "CASE WHEN attr >= 20000 THEN attr ELSE 0 END AS attr"
ORACLES["text_edges"] = _on(PART_SEQ, f"SELECT src, dst, {_WEIGHT} FROM e")
ORACLES["text_vertices"] = "SELECT p_partkey AS id FROM part"
ORACLES["text_graph_edges"] = _on(
    PART_SEQ,
    f"SELECT src, dst, {_WEIGHT} FROM e UNION ALL SELECT dst, src, {_WEIGHT} FROM e",
)
ORACLES["text_graph_vertices"] = _on(PART_GRAPH, "SELECT id FROM pv")
ORACLES["text_descriptors"] = """
       SELECT 'c' || c_custkey AS graph, c_custkey AS n_vertices, c_custkey % 2 = 0 AS directed,
              CASE WHEN c_custkey % 3 = 0 THEN 'BFS|PageRank' ELSE 'SSSP|WCC' END AS algorithms,
              CAST('0.' || c_custkey % 10 AS DOUBLE) AS pr_damping
       FROM customer"""
ORACLES["text_expected"] = f"""
       SELECT p_partkey AS id,
              CASE WHEN p_partkey % 7 = 0 THEN {MAX} ELSE CAST(p_size AS BIGINT) END AS value
       FROM part"""
ORACLES["result_file"] = _on(PART_GRAPH, "SELECT id, attr AS value FROM pv")
ORACLES["report_file"] = ORACLES["run_stats"]
ORACLES["snapshot_formats"] = _on(
    PART_GRAPH,
    """SELECT storage_format, node_id, id, attr AS value
       FROM pv, (VALUES ('TextFile()', 0::BIGINT), ('TextFile(true)', 1), ('ObjectFile()', 2),
                        ('ParquetFile()', 3), ('ORCFile()', 4), ('CSVFile()', 5),
                        ('CSVFile(true)', 6), ('JSONFormat()', 7), ('JSONFormat(true)', 8)
                ) formats(storage_format, node_id)""",
)
ORACLES["size_listing"] = """
       SELECT CAST(l_orderkey AS VARCHAR) AS lineage_id, CAST(l_linenumber AS INTEGER) AS iteration,
              CAST(floor(l_extendedprice) AS BIGINT) AS size
       FROM lineitem WHERE l_linenumber % 4 <> 0"""
ORACLES["output_size_listing"] = _on(
    _RUNS,
    """SELECT algorithm, dataset, max(run_nr) FILTER (setup <> 'Baseline') AS with_lineage,
              max(run_nr) FILTER (setup = 'Baseline') AS without_lineage
       FROM runs GROUP BY 1, 2""",
)
ORACLES["recorded_runs"] = _on(
    _DEPTHS,
    """SELECT 'experiment-1' AS experiment, 'combinedpruning' AS setup, 'BFS' AS algorithm,
              'part-seq' AS dataset, 1::BIGINT AS run_nr, 'Text' AS storage_format,
              (SELECT count(*) FROM v) AS n_vertices,
              (SELECT CAST(count(*) AS INTEGER) FROM rounds) AS iterations, TRUE AS stored
       UNION ALL
       SELECT 'experiment-2', 'tracing', 'PageRank', 'part-seq', 2, 'Text',
              (SELECT count(*) FROM v), 3, FALSE""",
)
ORACLES["recorded_messages"] = _on(
    _DEPTHS,
    """SELECT count(x) AS messages
       FROM rounds LEFT JOIN depth ON x = i + 2 GROUP BY i""",
)
