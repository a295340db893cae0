"""The algorithms against published results, brute force and each other."""

import random

import pytest
from pyspark.sql import functions as F

from tests import example
from tests.example import INF, MAX, graph, result
from trailgraph.operators.aggregate import Send
from trailgraph.plans.prepared import PreparedGraph


def close(found, expected):
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, abs=1e-7), key


def test_published_results(spark):
    g = graph(spark)
    ready = PreparedGraph(g)
    assert result(g.bfs(1, prepared=ready)) == example.BFS
    close(result(g.sssp(1, prepared=ready)), example.SSSP)
    assert result(g.wcc(prepared=ready)) == example.WCC
    close(result(g.pagerank(2, prepared=ready)), example.PAGERANK)
    assert result(g.cdlp(2, prepared=ready)) == example.CDLP
    close(result(g.lcc(prepared=ready)), example.LCC)
    ready.release()


def random_graph(spark, seed, vertices=40, edges=120, hub=True):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(vertices), rng.randrange(vertices), float(rng.randrange(1, 9)))
        for _ in range(edges)
    ]
    if hub:
        rows += [(0, v, 1.0) for v in range(0, vertices, 2)]
        rows += [(v, 1, 2.0) for v in range(1, vertices, 2)]
    ids = list(range(vertices + 5))
    return rows, ids, graph(spark, rows, ids)


def brute_distances(rows, ids, source, weight):
    best = {i: INF for i in ids}
    best[source] = 0
    for _ in ids:
        for s, d, w in rows:
            best[d] = min(best[d], best[s] + weight(w))
    return best


def brute_components(rows, ids, rounds=None):
    label = {i: i for i in ids}
    done = 0
    while rounds is None or done < rounds:
        new = dict(label)
        for s, d, _ in rows:
            new[d] = min(new[d], label[s])
            new[s] = min(new[s], label[d])
        if new == label:
            break
        label, done = new, done + 1
    return label


def brute_lcc(rows, ids):
    out = {i: [] for i in ids}
    near = {i: set() for i in ids}
    for s, d, _ in rows:
        if s != d:
            out[s].append(d)
            near[s].add(d)
            near[d].add(s)
    found = {}
    for i in ids:
        n = len(near[i])
        links = sum(1 for u in near[i] for v in out[u] if v in near[i])
        found[i] = links / (n * (n - 1)) if n > 1 else 0.0
    return found


def brute_cdlp(rows, ids, rounds):
    label = {i: i for i in ids}
    for _ in range(rounds):
        counts = {i: {} for i in ids}
        for s, d, _ in rows:
            counts[d][label[s]] = counts[d].get(label[s], 0) + 1
            counts[s][label[d]] = counts[s].get(label[d], 0) + 1
        label = {
            i: min(c, key=lambda l: (-c[l], l)) if c else label[i] for i, c in counts.items()
        }
    return label


def brute_pagerank(rows, ids, rounds, d=0.85):
    n = len(ids)
    rank = {i: 1 / n for i in ids}
    degree = {i: sum(1 for r in rows if r[0] == i) for i in ids}
    for _ in range(rounds):
        dangling = sum(rank[i] for i in ids if degree[i] == 0)
        got = {i: 0.0 for i in ids}
        for s, t, _ in rows:
            got[t] += rank[s] / degree[s]
        rank = {i: (1 - d) / n + d * (got[i] + dangling / n) for i in ids}
    return rank


@pytest.mark.parametrize("min_hot_rows", [None, 3])
def test_against_brute_force(spark, min_hot_rows):
    """With every busy vertex treated as a hub, and with none."""
    rows, ids, g = random_graph(spark, 7)
    ready = PreparedGraph(g, min_hot_rows=min_hot_rows)
    assert (ready.outgoing.hot is not None) == (min_hot_rows is not None)
    hops = brute_distances(rows, ids, 0, lambda w: 1)
    assert result(g.bfs(0, prepared=ready)) == {
        i: MAX if h == INF else h for i, h in hops.items()
    }
    assert result(g.sssp(0, prepared=ready)) == brute_distances(rows, ids, 0, lambda w: w)
    for first_rounds in (0, 1, 6):
        found = g.wcc(prepared=ready, first_rounds=first_rounds)
        assert result(found) == brute_components(rows, ids)
    assert result(g.wcc(1, prepared=ready)) == brute_components(rows, ids, 1)
    ranks = result(g.pagerank(5, prepared=ready))
    close(ranks, brute_pagerank(rows, ids, 5))
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-9)
    assert result(g.cdlp(3, prepared=ready)) == brute_cdlp(rows, ids, 3)
    slots = 5 if min_hot_rows else 10_000_000
    close(result(g.lcc(prepared=ready, candidates_per_slot=slots)), brute_lcc(rows, ids))
    largest = g.map_vertices("id").pregel(
        F.lit(-1).cast("long"),
        lambda _, attr, msg: F.greatest(attr, msg),
        [Send("dst", "src_attr", "src_attr > dst_attr")],
        F.max,
        prepared=ready,
    )
    expected = {i: i for i in ids}
    for _ in ids:
        for s, d, _w in rows:
            expected[d] = max(expected[d], expected[s])
    assert result(largest) == expected
    ready.release()


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    rows = [(a, b, 0.0) for a, b in zip(order, order[1:]) if a % 50 and b % 50]
    g = graph(spark, rows, order)
    assert result(g.wcc()) == brute_components(rows, order)
    assert result(g.wcc(first_rounds=0)) == brute_components(rows, order)


def test_components_ignore_direction(spark):
    rows, ids, g = random_graph(spark, 11, edges=25, hub=False)
    turned = graph(spark, [(d, s, w) for s, d, w in rows], ids)
    assert result(g.wcc()) == result(turned.wcc()) == brute_components(rows, ids)


def test_edge_cases(spark):
    none = graph(spark, [], [1, 2])
    assert result(none.bfs(1)) == {1: 0, 2: MAX}
    assert result(none.wcc()) == {1: 1, 2: 2}
    assert result(none.wcc(2)) == {1: 1, 2: 2}
    assert result(none.wcc(first_rounds=0)) == {1: 1, 2: 2}
    close(result(none.pagerank(3)), {1: 0.5, 2: 0.5})
    assert result(none.cdlp(2)) == {1: 1, 2: 2}
    assert result(none.lcc()) == {1: 0.0, 2: 0.0}

    odd = graph(spark, [(1, 1, 1.0), (1, 2, 5.0), (1, 2, 3.0), (2, 9, 1.0)], [1, 2, 4])
    assert result(odd.bfs(77)) == {1: MAX, 2: MAX, 4: MAX, 9: MAX}
    assert result(odd.sssp(1)) == {1: 0.0, 2: 3.0, 4: INF, 9: 4.0}
    assert result(odd.wcc()) == {1: 1, 2: 1, 4: 4, 9: 1}
    close(result(odd.pagerank(0)), {i: 0.25 for i in (1, 2, 4, 9)})


@pytest.mark.parametrize("max_iter", [0, -1])
def test_rounds_must_be_positive(spark, max_iter):
    g = graph(spark)
    with pytest.raises(ValueError):
        g.wcc(max_iter)
    with pytest.raises(ValueError):
        g.cdlp(max_iter)
    with pytest.raises(ValueError):
        g.pregel(F.lit(0), lambda i, a, m: m, [Send("dst", "1")], F.min, max_iter)
