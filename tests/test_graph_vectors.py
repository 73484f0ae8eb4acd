"""Cliques (properties), valid extensions, silhouette against brute force, mean pooling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from comboscore.operators import cliques as G
from comboscore.operators import vectors as V


def random_graph(spark, n=40, p=0.35, seed=1):
    rnd = random.Random(seed)
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < p]
    return spark.createDataFrame(edges, "id_a int, id_b int"), set(edges)


def test_sampled_cliques_are_cliques(spark):
    pairs, edges = random_graph(spark)
    adj = G.adjacency(pairs)
    draws = spark.range(400).select(F.col("id").alias("draw"))
    out = G.sample_cliques(adj, draws, seed=11).collect()
    assert 0 < len(out) < 400                     # some draws hit dead ends and are dropped
    for r in out:
        c = r.combo
        assert len(c) == r.target and 2 <= r.target <= 5 and len(set(c)) == len(c)
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                assert (min(c[i], c[j]), max(c[i], c[j])) in edges
    again = G.sample_cliques(adj, draws.repartition(7), seed=11).collect()
    assert sorted((r.draw, tuple(r.combo)) for r in again) == sorted((r.draw, tuple(r.combo)) for r in out)


def test_adjacency_and_valid_extensions(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3), (3, 4)], "id_a int, id_b int")
    adj = {r.id: r.neighbours for r in G.adjacency(pairs).collect()}
    assert adj == {1: [2, 3], 2: [1, 3], 3: [1, 2, 4], 4: [3]}
    groups = spark.createDataFrame([(1, [1, 2], 3), (2, [1, 2], 4), (3, [], 4)],
                                   "key int, members array<int>, new_id int")
    got = {r.key: r.valid for r in G.valid_extensions(groups, G.edges(pairs)).collect()}
    assert got == {1: True, 2: False, 3: True}


def hub_graph(spark, n=3000):
    """Item 0 neighbours everything; the others stand in a ring and in triples."""
    pairs = [(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, n - 1)] + [(i, i + 2) for i in range(1, n - 2, 3)]
    return spark.createDataFrame(pairs + pairs[:50] + [(5, 5)], "id_a int, id_b int"), {frozenset(p) for p in pairs}


def test_blocks_bound_a_hub(spark):
    pairs, _ = hub_graph(spark)
    b = G.adjacency_blocks(pairs, size=100)
    assert b.agg(F.max(F.size("neighbours"))).first()[0] <= 100
    assert b.where("id = 0").count() == 30
    whole = {r.id: r.neighbours for r in G.whole_lists(b).collect()}
    assert whole == {r.id: r.neighbours for r in G.adjacency(pairs).collect()}
    assert {(r.id, r.block): r.neighbours for r in G.in_blocks(G.adjacency(pairs), 100).collect()} == \
        {(r.id, r.block): r.neighbours for r in b.collect()}


def test_blocks_do_not_change_cliques(spark):
    pairs, edges = hub_graph(spark, 400)
    pairs = pairs.where("id_a <> id_b")
    draws = spark.range(300).select(F.col("id").alias("draw"))
    got = [{(r.draw, r.target, tuple(r.combo)) for r in G.sample_cliques(G.adjacency_blocks(pairs, size=s), draws, 3, size=s).collect()}
           for s in (1000, 7)]
    assert got[0] == got[1] and len(got[0]) > 100
    for _, target, combo in got[0]:
        assert len(combo) == target and all(frozenset((a, b)) in edges for i, a in enumerate(combo) for b in combo[:i])


def test_common_neighbours_with_hubs_and_odd_groups(spark):
    pairs, edges = hub_graph(spark, 200)
    groups = [(1, [0, 1]), (2, [1, 2, 0]), (3, [7]), (4, [0]), (5, [9999, 0]), (6, []), (7, [3, 3, 0]), (8, None), (9, [5, 5])]
    df = spark.createDataFrame(groups, "combo_id int, ids array<int>")
    ids = {x for e in edges for x in e}
    got = {r.combo_id: r.candidates for r in G.common_neighbours(df, G.adjacency_blocks(pairs, size=16)).collect()}
    for key, members in groups:
        expected = sorted(c for c in ids if members and c not in members and all(frozenset((c, m)) in edges for m in members))
        assert got[key] == expected, key


def test_symmetric_keeps_two_way_edges(spark):
    adj = spark.createDataFrame([(1, [2, 3]), (2, [1]), (3, [])], "id int, neighbours array<int>")
    got = {r.id: r.neighbours for r in G.symmetric(adj).collect()}
    assert got == {1: [2], 2: [1]}


def silhouette_brute(x, labels, sq=False):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    if sq:
        d = d ** 2
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean"])
def test_silhouette_matches_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)).astype(np.float32)
    labels = np.array([i % 3 for i in range(59)] + [9])         # label 9 is a singleton
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(60)],
                               "vid int, v array<float>, lab int")
    got = {r.vid: r.score for r in V.silhouette_samples(df, "vid", "v", "lab", metric=metric,
                                                        block_rows=16, block_labels=2).collect()}
    want = silhouette_brute(x.astype(np.float64), labels, sq=(metric == "sqeuclidean"))
    assert np.allclose([got[i] for i in range(60)], want, atol=1e-9)
    assert got[59] == 0.0


def test_linear_silhouette_with_many_labels(spark):
    """More labels than any former limit: statistics are a table, in several blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 3))
    labels = np.arange(2400) % 1200
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(2400)],
                               "vid int, v array<double>, lab int")
    got = {r.vid: r.score for r in V.silhouette_samples(df, "vid", "v", "lab", metric="sqeuclidean").collect()}
    assert len(got) == 2400
    want = silhouette_brute(x, labels, sq=True)
    assert np.allclose([got[i] for i in range(2400)], want, atol=1e-7)


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, v array<double>")
    assert {r.k: r.v for r in V.mean_pool(df, "k", "v").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def test_pca_matches_numpy_with_fixed_signs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ np.diag([5.0, 3.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(80)], "k int, v array<double>")
    got = np.array([r.xy for r in V.project_2d(df, "v").orderBy("k").collect()])
    # Spark ML PCA projects the uncentred data on the top-2 principal axes
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for j in range(2):
        axis = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.allclose(got[:, j], x @ axis, atol=1e-6)


def test_draws_keep_candidates_as_bits(spark):
    """The rows that the sampler sorts hold words of bits: short whatever the degree, and never the item itself."""
    pairs = spark.createDataFrame([(1, i) for i in range(0, 3000)] + [(70, 63), (70, 64)], "id_a int, id_b int")
    for adj in (G.adjacency(pairs), G.adjacency_blocks(pairs, size=100)):
        rows = G.bit_blocks(adj, 200).collect()
        assert {len(r.bits) for r in rows} == {4}
        got = {(r.id, r.block * 200 + 64 * w + b) for r in rows for w, x in enumerate(r.bits) for b in range(64) if x >> b & 1}
        assert got == {(1, i) for i in range(3000) if i != 1} | {(i, 1) for i in range(3000) if i != 1} | {(70, 63), (63, 70), (70, 64), (64, 70)}


def test_groups_are_read_once(spark):
    """The groups' rows are made once, not for the longest group and again for the lists."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b
    pairs, _ = hub_graph(spark, 50)
    groups = spark.createDataFrame([(1, [0, 1]), (2, [3, 4, 0])], "combo_id int, ids array<int>").mapInPandas(count, "combo_id int, ids array<int>")
    assert G.common_neighbour_blocks(groups, G.adjacency(pairs)).count() > 0
    assert made.value == 2
