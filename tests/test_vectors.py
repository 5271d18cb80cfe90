import numpy as np
import pytest
from cairnsearch.operators import cells as cells_module
from cairnsearch.operators import nearest as near
from cairnsearch.operators import neighbour_join as join
from cairnsearch.operators.cells import append_cells, build_cells, read_cells, search_cells, write_cells
from cairnsearch.session import shared_folder


def brute_force(vectors, queries, k):
    found = {}
    for query_id, query in queries.items():
        scored = []
        for row_id, vector in vectors.items():
            norm = np.linalg.norm(vector) * np.linalg.norm(query)
            distance = 1 - float(np.dot(vector, query)) / norm if norm else float("nan")
            scored.append((np.isnan(distance), round(distance, 9) if norm else 0, row_id))
        found[query_id] = [row_id for _, _, row_id in sorted(scored)[:k]]
    return found


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).astype(np.float32) for i in range(400)}
    for i in range(100, 250):  # more than a third of the rows are copies of one vector
        vectors[i] = vectors[100]
    vectors[7] = np.zeros(8, np.float32)
    queries = {i: rng.normal(size=8) for i in range(12)}
    queries[12] = vectors[100].astype(float)
    return vectors, queries


@pytest.fixture(scope="module")
def tables(spark, data):
    vectors, queries = data
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(9000, None)]
    asked = [(i, q.tolist()) for i, q in queries.items()] + [(90, None), (91, [])]
    return (
        spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5),
        spark.createDataFrame(asked, "query_id long, query_vec array<double>"),
    )


def by_query(hits):
    found = {}
    for row in hits.orderBy("query_id", "r").collect():
        found.setdefault(row["query_id"], []).append(row["id"])
    return found


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_nearest_matches_brute_force(data, tables, strategy):
    assert by_query(near.nearest(*tables, 10, strategy=strategy)) == brute_force(*data, 10)


def test_zero_vectors_come_last(data, tables):
    vectors, queries = data
    found = by_query(near.nearest(*tables, 1000))
    assert all(ids[-1] == 7 and len(ids) == len(vectors) for ids in found.values())


def test_small_blocks_split_every_cell(data, tables):
    """A cell that holds a third of the rows becomes many blocks, and no vector is in two of them."""
    held = tables[0].filter("embedding IS NOT NULL")
    centres = join.sampled_centres(held, 400)
    assert len(centres) == 20
    placed = join.with_cells(held, centres)
    cells = join.bounds_of(centres, join.measured(placed))
    visits = tables[1].filter("size(query_vec) > 0").crossJoin(placed.select("cell").distinct())
    asked = {row["cell"]: row["count"] for row in visits.groupBy("cell").count().collect()}
    scored = join.score_visits(placed, visits, cells, asked, 10, vector_block=30, query_block=4)
    assert by_query(near.top_k_per_query(scored, 10, "dist", "id")) == brute_force(*data, 10)
    blocks = join.blocks_of(cells.counts, asked, 30, 4)
    assert max(blocks.values()) >= 150 * 13 // 120
    sizes = held.sparkSession.createDataFrame(list(blocks.items()), "cell int, blocks int")
    resting = join.place_vectors(placed, sizes)
    assert resting.count() == held.count() == resting.select("id").distinct().count()
    assert "Generate" not in resting._jdf.queryExecution().executedPlan().toString()


def clustered(n, seed, centres=20, dim=16):
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(centres, dim))
    return (places[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_exact_search_leaves_most_cells_unread(spark, strategy, monkeypatch):
    vectors = dict(enumerate(clustered(600, 5)))
    queries = {i: v.astype(float) for i, v in enumerate(clustered(600, 5)[:9] * 3)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, embedding array<float>")
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in queries.items()], "query_id long, query_vec array<double>")
    index = write_cells(build_cells(rows, lists=20), shared_folder(spark, "cells"))
    read = []
    for module, name in ((cells_module, "_score_few"), (join, "score_visits")):
        kept = getattr(module, name)

        def counting(*args, kept=kept, name=name):
            # chosen cells are the last argument but one of the one, a dictionary; counts per cell of the other
            named = args[4] if name == "_score_few" else {0: list(args[3])}
            read.extend(int(c) for cells in named.values() for c in cells)
            return kept(*args)

        monkeypatch.setattr(module, name, counting)
    assert by_query(search_cells(index, asked, 5, strategy=strategy)) == brute_force(vectors, queries, 5)
    assert len(set(read)) < 16


@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_exact_search_with_zero_vectors_and_copies(spark, data, tables, strategy):
    index = write_cells(build_cells(tables[0], lists=6), shared_folder(spark, "cells"))
    assert by_query(search_cells(index, tables[1], 10, strategy=strategy)) == brute_force(*data, 10)
    many = by_query(search_cells(index, tables[1], 1000, strategy=strategy))
    assert all(ids[-1] == 7 and len(ids) == len(data[0]) for ids in many.values())
    zero = spark.createDataFrame([(1, [0.0] * 8)], "query_id long, query_vec array<double>")
    assert by_query(search_cells(index, zero, 3, strategy=strategy)) == {1: [0, 1, 2]}


def test_join_of_empty_sides(spark, tables):
    assert near.nearest(tables[0].limit(0), tables[1], 3, strategy="blocks").count() == 0
    assert near.nearest(tables[0], tables[1].limit(0), 3, strategy="blocks").count() == 0
    zeros = spark.createDataFrame([(2, [0.0, 0.0]), (1, [0.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(5, [1.0, 2.0])], "query_id long, query_vec array<double>")
    assert by_query(near.nearest(zeros, asked, 3, strategy="blocks")) == {5: [1, 2]}


def test_nearest_to_one(data, tables):
    vectors, queries = data
    found = near.nearest_to_one(tables[0], queries[3].tolist(), 10)
    assert [r["id"] for r in found.collect()] == brute_force(vectors, {3: queries[3]}, 10)[3]
    assert near.nearest_to_one(tables[0], [], 10).count() == 0


def test_top_k_is_pruned_before_the_shuffle(tables):
    plan = near.nearest(*tables, 10, strategy="broadcast")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    single = near.nearest_to_one(tables[0], [1.0] * 8, 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in single


def test_dimension_mismatch_fails(spark, tables):
    wrong = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<double>")
    with pytest.raises(Exception, match="dimensions"):
        near.nearest(tables[0], wrong, 3).collect()
    ragged = spark.createDataFrame(
        [(1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, embedding array<float>"
    ).coalesce(1)
    with pytest.raises(Exception, match="dimensions"):
        near.nearest(ragged, wrong, 3).collect()


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_all_cells_probed_is_exact_and_fewer_recall_most(spark, data, tables, strategy):
    index = write_cells(build_cells(tables[0], lists=6), shared_folder(spark, "cells"))
    exact = brute_force(*data, 10)
    assert by_query(search_cells(index, tables[1], 10, probes=99, strategy=strategy)) == exact
    some = by_query(search_cells(index, tables[1], 10, probes=3, strategy=strategy))
    shared = sum(len(set(some[q]) & set(exact[q])) for q in exact)
    assert shared >= 0.6 * sum(map(len, exact.values()))


@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_few_probes_read_few_cells(spark, tables, strategy):
    index = write_cells(build_cells(tables[0], lists=6), shared_folder(spark, "cells"))
    found = search_cells(index, tables[1].limit(1), 5, probes=1, strategy=strategy)
    filters = found._jdf.queryExecution().toString().split("PartitionFilters: [")[1:]
    assert any("cell" in f.split("]")[0] and (" = " in f.split("]")[0] or " IN " in f.split("]")[0]) for f in filters)


def test_a_stored_index_is_reopened_and_appended_to(spark, data, tables):
    path = shared_folder(spark, "cells")
    early, late = tables[0].filter("id % 3 > 0"), tables[0].filter("id % 3 = 0")
    written = write_cells(build_cells(early, lists=6), path)
    assert np.allclose(read_cells(spark, path).centroids, written.centroids)
    append_cells(late, path)
    index = read_cells(spark, path)
    assert by_query(search_cells(index, tables[1], 10, probes=99)) == brute_force(*data, 10)


def test_the_last_round_copies_queries_to_few_groups(spark, monkeypatch):
    """Vectors without structure rule out no cells; a query then goes to groups of them, not to each."""
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=12).astype(np.float32) for i in range(900)}
    queries = {i: rng.normal(size=12) for i in range(40)}
    queries[3] = vectors[5].astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, embedding array<float>")
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in queries.items()], "query_id long, query_vec array<double>")
    seen, kept = [], join.score_visits

    def counting(vectors, visits, *args):
        seen.append(visits.count())
        return kept(vectors, visits, *args)

    monkeypatch.setattr(join, "score_visits", counting)
    monkeypatch.setattr(join, "GROUP_VECTORS", 300, raising=False)
    assert by_query(near.nearest(rows, asked, 10, strategy="blocks")) == brute_force(vectors, queries, 10)
    assert seen[-1] <= 3 * len(queries)  # of 30 cells
    monkeypatch.setattr(join, "TASK_PAIRS", 500)  # vectors are copied to strips of the queries
    monkeypatch.setattr(join, "GROUP_VECTORS", 20)
    assert by_query(near.nearest(rows, asked, 10, strategy="blocks")) == brute_force(vectors, queries, 10)
    monkeypatch.setattr(join, "GROUP_VECTORS", 300)
    twice = by_query(near.nearest(rows.unionByName(rows), asked, 10, strategy="blocks"))  # rows that come twice count twice
    assert twice == {q: [i for i in found[:5] for _ in range(2)] for q, found in brute_force(vectors, queries, 5).items()}


def test_more_queries_than_vectors_copy_the_vectors():
    counts = np.array([100, 70_000])
    asked = {0: 1_000_000, 1: 10}
    blocks = join.blocks_of(counts, asked, 65_536, 16)
    assert blocks == {0: 1, 1: 2}
    assert join.strips_of(counts, asked, blocks, 1_000_000) == {0: 100, 1: 1}


def test_groups_of_cells_are_even_and_complete():
    rng = np.random.default_rng(2)
    cells = join.CellBounds(join.unit_rows(rng.normal(size=(200, 6))), np.zeros(200), rng.integers(0, 50, 200))
    group = join.neighbouring_cells(cells, 16)
    sizes = np.bincount(group, cells.counts, 16)
    assert sorted(set(group)) == list(range(16)) and sizes.max() < 3 * sizes.mean()
    assert list(join.neighbouring_cells(join.CellBounds(np.ones((2, 3)), np.zeros(2), np.array([0, 9])), 5)) == [0, 1]


@pytest.mark.parametrize("kind", ["normal", "integers"])
def test_screening_in_single_precision_loses_nothing(kind, monkeypatch):
    monkeypatch.setattr(near, "CACHED", 90)
    monkeypatch.setattr(near, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(near, "SCORED_AT_ONCE", 700)
    rng = np.random.default_rng(4)
    make = rng.normal if kind == "normal" else lambda size: rng.integers(0, 3, size=size)
    vectors, queries = np.asarray(make(size=(300, 5)), np.float32), np.asarray(make(size=(20, 5)), float)
    vectors[3] = 0
    want = brute_force(dict(enumerate(vectors)), dict(enumerate(queries)), 6)
    for bound in (None, np.full(20, np.inf)):
        best = near.RunningTopK(queries, 6, bound)
        for ids in np.array_split(rng.permutation(300), 3):
            best.offer(ids, vectors[ids])
        found = {q: best.id[best.query == q].tolist() for q in range(20)}
        assert {q: f for q, f in found.items() if queries[q].any()} == {q: w for q, w in want.items() if queries[q].any()}
    near_enough = near.RunningTopK(queries, 6, best.bound)
    near_enough.offer(np.arange(300), vectors)
    assert near_enough.id.tolist() == best.id.tolist()


@pytest.mark.parametrize("dim", [3, 26, 64])
def test_leaves_give_what_all_pairs_give(dim):
    """Also with equal, zero and nearly equal vectors, queries without a direction or a bound, and loose bounds."""
    rng = np.random.default_rng(dim)
    centres = rng.gamma(1.0, size=(4, dim))
    vectors = (centres[rng.integers(4, size=5000)] + rng.normal(scale=0.05, size=(5000, dim))).astype(np.float32)
    vectors[100:160], vectors[7], vectors[8] = vectors[100], 0, np.nan
    queries = np.concatenate([vectors[90:110] * 3, centres[rng.integers(4, size=200)] + rng.normal(scale=0.2, size=(200, dim)), np.zeros((1, dim))])
    ids = rng.permutation(5000)
    exact = near.RunningTopK(queries, 20)
    exact.offer(ids, vectors)
    leaves = near.Leaves(vectors)
    assert sorted(np.concatenate([*leaves.members, leaves.rest])) == list(range(5000)) and list(leaves.rest) == [7, 8]
    for bound in (exact.bound, exact.bound * 1.5 + 1e-12, np.where(np.arange(221) % 3 == 0, np.nan, exact.bound)):
        plain, cut = near.RunningTopK(queries, 20, bound.copy()), near.RunningTopK(queries, 20, bound.copy())
        plain.offer(ids, vectors)
        cut.offer_leaves(ids, leaves)
        for one, two in ((plain.query, cut.query), (plain.id, cut.id), (plain.distance, cut.distance)):
            np.testing.assert_array_equal(one, two)


def test_leaves_rule_out_most_pairs():
    """Counts of letters in texts of many lengths: the pairs scored are a small part of all, and no leaf hides a neighbour."""
    rng = np.random.default_rng(1)
    words = rng.dirichlet(np.full(26, 0.7), size=4)
    counts = np.array([rng.multinomial(n, words[n % 4]) for n in rng.integers(100, 3000, size=20_000)])
    asked = np.array([rng.multinomial(n, words[n % 4]) for n in rng.integers(60, 300, size=300)]).astype(float)
    best = near.RunningTopK(asked, 20)
    best.offer(np.arange(20_000), counts)
    leaves = near.Leaves(counts)
    may = leaves.highest(best.unit) >= (1 - best.bound)[:, None]
    leaf_of = np.empty(20_000, int)
    for leaf, members in enumerate(leaves.members):
        leaf_of[members] = leaf
    assert may[best.query, leaf_of[best.id]].all()
    assert may.mean() < 0.3


def test_the_join_searches_groups_by_leaves(spark, monkeypatch):
    """The last round of a join through leaves finds what scoring every vector finds."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.gamma(1.0, size=6).round(3).tolist()) for i in range(6000)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, rng.gamma(1.0, size=6).tolist()) for i in range(700)], "query_id long, query_vec array<double>")
    exact = near.nearest(vectors, asked, 10, strategy="broadcast")
    for name in ("LAST_GROUPS", "GROUP_VECTORS", "LEAST_CUT"):
        monkeypatch.setattr(join, name, {"LAST_GROUPS": 3, "GROUP_VECTORS": 1500, "LEAST_CUT": 200}[name])
    found = near.nearest(vectors, asked, 10, strategy="blocks")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
