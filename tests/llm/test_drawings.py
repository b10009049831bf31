"""Problems 1, 2, 4 and 5 against brute force, with tiny blocks so that every cell is hot."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.llm import bounds as B
from drawloom.llm import collisions as C
from drawloom.llm import drawings as D
from drawloom.llm import fingerprints as P
from drawloom.llm import linkage as K
from drawloom.llm import neighbours as N
from drawloom.llm import overlap as O
from drawloom.llm import variety as V

SCHEMA = "row_id bigint, split string, x array<float>, y array<float>, source string, loaded_at int, v string, cell int, label string"


def drawing(rng, shape, noise=60):
    ink = (shape > 0) & (rng.random(784) > 0.05)
    return np.where(ink, np.clip(shape + rng.normal(0, noise, 784), 1, 255).round(), 0.0)


def shapes(rng, n):
    out = []
    for _ in range(n):
        grid = np.zeros((28, 28))
        for _ in range(9):
            r, c = rng.integers(3, 20, 2)
            grid[r : r + rng.integers(2, 7), c : c + rng.integers(2, 7)] = 200
        out.append(grid.reshape(-1))
    return out


def table(n=260, seed=0, bases=9):
    """Drawings of a few shapes, the first holding a third of all, with copies, moved copies, dim copies and dirt."""
    rng = np.random.default_rng(seed)
    forms = shapes(rng, bases)
    rows = []
    for i in range(n):
        base = 0 if i % 3 == 0 else int(rng.integers(bases))
        x = drawing(rng, forms[base])
        split = ["train", "Train ", "test", "valid", "train"][i % 5]
        y = [1.0 if j == base else 0.0 for j in range(10)]
        rows.append([i * 3 + 1, split, [float(v) for v in x], y, "S" if i % 2 else " s ", 1])
    for k in range(0, 60, 6):  # evaluation copies of train rows: equal, moved, dim
        x = np.array(rows[k][2])
        moved = [x, D.displaced(x[None], 1, -1)[0], D.displaced(x[None], 0, 1)[0], x / 255.0][(k // 6) % 4]
        rows.append([5000 + k, "test", [float(np.float32(v)) for v in moved], rows[k][3], None, 1])
    rows.append([9001, "train", None, rows[0][3], "S", 1])
    rows.append([9002, "train", rows[0][2][:-1], None, "S", 1])
    rows.append([9003, "train", [float("nan")] + rows[0][2][1:], None, "S", 1])
    rows.append([9004, "test", [None] + rows[0][2][1:], None, "S", 1])
    rows.append([9005, "train", [7.0] * 784, None, "S", 1])
    rows.append([9006, None, [float(v) for v in rng.integers(0, 255, 784)], [0.5, 0.5] + [0.0] * 8, None, None])
    rows.append([None, "train", rows[0][2], rows[0][3], "S", 1])
    rows.append([*rows[4][:5], 2])  # delivered again
    rows.append([*rows[0][:3], [0.0] * 9 + [1.0], "s", 3])
    return [(*r, "x", 7, "y") for r in rows]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def usable():
    seen = {}
    for r in table():
        x = r[2]
        if r[0] is None or x is None or len(x) != 784 or any(v is None or np.isnan(v) for v in x) or min(x) == max(x):
            continue
        seen[r[0]] = (np.array(x, np.float32).astype(float), (r[1] or "").strip().lower() == "train")
    ids = np.array(sorted(seen))
    return ids, np.array([seen[i][0] for i in ids]), np.array([seen[i][1] for i in ids])


def cosines(x):
    n = np.sqrt((x * x).sum(axis=1))
    return x @ x.T / (n[:, None] * n[None, :])


def expected_neighbours(ids, x, k=5, least=0.71):
    s = np.round(cosines(x), 6)
    np.fill_diagonal(s, -1)
    out = set()
    for i in range(len(ids)):
        near = [j for j in np.lexsort((ids, -s[i])) if s[i, j] >= least][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near}
    return out


def test_pack_and_unpack_are_exact():
    rows = [[float(v) for v in range(784)], [0.5] * 783 + [1.0], [3.0] * 784, None, [1.0], [float(i % 256) for i in range(784)], [-1.0] + [0.0] * 783]
    column = pa.array(rows, pa.list_(pa.float32()))
    ok, packed = D.pack(column)
    assert ok.tolist() == [True, True, False, False, False, True, True]
    assert np.array_equal(D.unpack(packed), np.array([rows[i] for i in (0, 1, 5, 6)], np.float32))
    ok, packed = D.pack(column.slice(3, 3))
    assert ok.tolist() == [False, False, True] and len(packed) == 1
    assert len(D.pack(pa.array([], pa.list_(pa.float32())))[1]) == 0
    assert D.unpack(pa.chunked_array([], pa.binary())).shape == (0, 784)


def test_displacement():
    x = np.arange(784.0)[None]
    grid = D.displaced(x, 1, -1).reshape(28, 28)
    assert grid[0].sum() == 0 and grid[:, -1].sum() == 0 and grid[1, 0] == 1.0
    assert np.array_equal(D.displaced(x, 0, 0), x)


def test_bitset_counts_are_counts():
    rng = np.random.default_rng(1)
    reps, u = D.unit(rng.random((150, 784)).astype(np.float32)), D.unit(rng.random((40, 784)).astype(np.float32))
    for threshold in (1, 18, 40, 64):
        index = C.Index(reps, np.arange(150), C.Parameters(threshold=threshold))
        p, values = u @ index.planes, reps @ index.planes
        inside = (np.abs(p[:, None, :] - values[None, :, :]) <= 0.2).sum(axis=2) >= threshold
        got = np.unpackbits(index.colliding(p, 0.2).view(np.uint8), axis=1, bitorder="little", count=150).astype(bool)
        assert np.array_equal(inside, got)


def test_collisions_find_the_near_ones():
    rng = np.random.default_rng(2)
    reps = D.unit(rng.normal(size=(700, 784)).astype(np.float32))
    u = D.unit((reps[rng.integers(0, 700, 800)] + rng.normal(0, 0.025, (800, 784))).astype(np.float32))
    where, best = C.Index(reps, np.arange(700)).nearest(u)
    s = u @ reps.T
    near = s.max(axis=1) >= 0.71
    assert near.mean() > 0.9
    assert (where[near] == s.argmax(axis=1)[near]).mean() > 0.97
    found = where >= 0
    assert np.allclose(best[found], s[found].max(axis=1), atol=1e-5)


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_equal_brute_force(examples, usable, block):
    ids, x, _ = usable
    got = N.nearest_drawings(examples, block=block).collect()
    pairs = {(min(r.row_id, r.other), max(r.row_id, r.other)) for r in got}
    assert pairs == expected_neighbours(ids, x)
    s = np.round(cosines(x), 6)
    at = {i: k for k, i in enumerate(ids)}
    assert all(r.cosine == s[at[r.row_id], at[r.other]] for r in got)
    assert {tuple(r) for r in N.similar_pairs(N.nearest_drawings(examples, block=block)).collect()} == pairs


def test_neighbours_across_cells_and_rounds(examples, usable):
    ids, x, _ = usable
    p = C.Parameters(sample=12, rounds=50)  # many rounds of small samples
    got = {(min(r.row_id, r.other), max(r.row_id, r.other)) for r in N.nearest_drawings(examples, p=p, block=20).collect()}
    assert got == expected_neighbours(ids, x)
    # cells much narrower than the neighbourhoods: guests make up for most of it
    narrow = C.Parameters(similarity=0.9, border=0.71, near_cells=0.6, radii=(0.45, 0.6), rounds=40)
    got = {(min(r.row_id, r.other), max(r.row_id, r.other)) for r in N.nearest_drawings(examples, p=narrow).collect()}
    want = expected_neighbours(ids, x)
    assert len(got & want) / len(want) >= 0.9


def test_rounds_go_on_until_nothing_is_left(examples, usable):
    ids, x, train = usable
    p = C.Parameters(sample=10, rounds=1)
    with pytest.warns(UserWarning, match="going on"):
        cells = C.build(D.compact(examples), p)
    assert cells.rows.where("cell < 0").isEmpty()
    assert len(cells.index.reps) > 1 and {r.row_id for r in cells.rows.collect()} == set(ids.tolist())
    with pytest.warns(UserWarning):
        got = {r.row_id: r.cluster_row for r in K.cluster_drawings(examples, p=p).collect()}
    assert got == components(ids[train], x[train])


def test_many_deliveries_of_one_row_are_placed(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in drawing(rng, shapes(rng, 1)[0])]
    df = spark.createDataFrame([(1, "train", x)] * 30, "row_id bigint, split string, x array<float>")
    cells = C.build(D.compact(df), C.Parameters(sample=1, rounds=1))
    assert cells.sizes == {0: 30} and cells.rows.count() == 30


@pytest.mark.parametrize("paired", [B.PAIRED, 0])
def test_neighbours_across_cells_are_all_found(spark, monkeypatch, paired):
    # forty pairs of cosine 0.93 whose drawings lie in cells of different representatives, these being at 0.72 to them
    monkeypatch.setattr(B, "PAIRED", paired)
    rng = np.random.default_rng(21)
    rows = []
    for k in range(12):
        e = np.linalg.qr(rng.standard_normal((784, 3)))[0].T
        turn = lambda degrees, e=e: np.cos(np.radians(degrees)) * e[0] + np.sin(np.radians(degrees)) * e[1]
        for j, degrees in enumerate((0, 43, 43 + 21.5, 43 + 21.5 + 43)):
            rows.append((100 * k + j, "train", [float(np.float32(v)) for v in turn(degrees) + 0.002 * j * e[2]]))
    df = spark.createDataFrame(rows, "row_id bigint, split string, x array<float>")
    x = np.array([r[2] for r in rows], np.float32).astype(float)
    s = np.round(cosines(x), 6)
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(len(rows)) if i != j and s[i, j] >= 0.71}
    got = {(r.row_id, r.other) for r in N.nearest_drawings(df, k=5).collect()}
    assert got == want and len([1 for i, j in want if j - i == 1]) == 36


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for v in drawing(rng, shapes(rng, 1)[0])]
    df = spark.createDataFrame([(i, "train", x) for i in range(9, 0, -1)], "row_id bigint, split string, x array<float>")
    got = {(r.row_id, r.other) for r in N.nearest_drawings(df, k=2, block=3).collect()}
    assert got == {(i, j) for i in range(1, 10) for j in sorted(set(range(1, 10)) - {i})[:2]}


def test_empty_tables(spark, examples):
    none = examples.where("false")
    assert N.nearest_drawings(none).count() == 0
    assert O.overlaps(none).count() == 0
    assert O.overlaps(examples.where("split not like '%rain%'")).count() == 0
    assert K.cluster_drawings(none).count() == 0
    assert K.describe_clusters(K.cluster_drawings(none)).count() == 0
    requests = spark.createDataFrame([("a", 3), ("b", None), ("c", 0)], "request_id string, subset_rows bigint")
    assert V.varied_subsets(none, requests).count() == 0
    assert V.varied_subsets(examples, requests.where("false")).count() == 0


def same_pairs(usable):
    ids, x, train = usable
    n = np.sqrt((x * x).sum(axis=1))
    want = {}
    for down, right in D.DISPLACEMENTS:
        s = D.displaced(x[~train], down, right) @ x[train].T / (n[~train][:, None] * n[train][None, :])
        for i, j in zip(*np.nonzero(s > O.SAME)):
            key = (int(ids[~train][i]), int(ids[train][j]))
            want[key] = max(want.get(key, 0), s[i, j])
    return want


@pytest.mark.parametrize("tasks_for", [40, O.RECORDS])
def test_overlaps_equal_brute_force(examples, usable, tasks_for):
    want = same_pairs(usable)
    assert len(want) >= 6
    got = {(r.eval_id, r.train_id): r.cosine for r in O.overlaps(examples, tasks_for=tasks_for).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("local", "tasks_for"), [(10, 10**6), (8, 50)])
def test_all_that_meet_within_the_radius_are_found(examples, usable, local, tasks_for):
    # also where the first bits of a block are told apart by tasks, and where tasks are dealt
    ids, x, train = usable
    u = D.unit(x.astype(np.float32))
    f = P.fit(u, 3_000_000, 20_000_000, O.SAME)
    f = dataclasses.replace(f, blocks=f.blocks[:4, :10], local_bits=local)
    want = set()
    e = (x[~train] / np.sqrt((x[~train] ** 2).sum(axis=1))[:, None]).astype(np.float32)
    zt = f.project(u[train])
    for move in D.DISPLACEMENTS:
        ze = f.project(D.displaced(e, *move))
        for i in range(len(ze)):
            apart = np.bitwise_count(P.fingerprint(ze[i : i + 1]) ^ P.fingerprint(zt)).sum(axis=1)
            both = np.any([P.met(np.repeat(ze[i : i + 1], len(zt), 0), zt, block) for block in f.blocks], axis=0)
            want |= {(int(ids[~train][i]), int(ids[train][j])) for j in np.flatnonzero(both & (apart <= f.radius))}
    got = O.candidates(D.compact(examples), f, int(train.sum()), 9 * int((~train).sum()), tasks_for=tasks_for)
    assert len(want) > 20 and {(r.eval_id, r.train_id) for r in got.collect()} == want


def test_drawings_disturbed_to_the_yardstick_meet():
    # other noise than the join was fitted to; strangers of the same shape seldom come within the radius
    rng = np.random.default_rng(8)
    forms = shapes(rng, 6)
    u = D.unit(np.array([drawing(rng, forms[i % 6]) for i in range(3000)], np.float32))
    f = P.fit(u[:2000], 1_000_000, 1_000_000, O.SAME)
    fresh = u[2000:]
    tried = 0
    for a, b in P.disturbed(fresh, O.SAME, np.random.default_rng(5)):
        za, zb = f.project(a), f.project(b.astype(np.float32))
        near = np.bitwise_count(P.fingerprint(za) ^ P.fingerprint(zb)).sum(axis=1) <= f.radius
        found = np.any([P.met(zb, za, block) for block in f.blocks], axis=0)
        assert (near & found).mean() > 0.97
        tried += len(a)
    assert tried > 2500
    codes = P.fingerprint(f.project(fresh))
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert (apart[np.triu_indices(len(codes), 1)] <= f.radius).mean() < 0.01


def test_pairs_of_turned_vectors(spark):
    # a train drawing far from the first, its equal turned further away from that
    rep = np.zeros(784)
    rep[:392] = 1
    away = np.zeros(784)
    away[392:] = 1
    turned = [np.round(120 * (np.cos(a) * rep + np.sin(a) * away)) for a in (np.arccos(0.72), np.arccos(0.72) + np.arccos(0.965))]
    df = spark.createDataFrame([(1, "train", [float(v) for v in 100 * rep]), (2, "train", [float(v) for v in turned[0]]), (3, "test", [float(v) for v in turned[1]])], "row_id bigint, split string, x array<float>")
    assert cosines(np.array([100 * rep, turned[1]]))[0, 1] < 0.62 and cosines(np.array(turned))[0, 1] > O.SAME
    assert [(r.eval_id, r.train_id) for r in O.overlaps(df).collect()] == [(3, 2)]


def test_pairs_among_separate_drawings(spark):
    # twenty pairs of cosine 0.966, all else far apart
    rng = np.random.default_rng(12)
    rows = []
    for k in range(20):
        a = rng.integers(0, 256, 784) * (rng.random(784) < 0.3)
        b = a + rng.normal(0, 1, 784) * np.linalg.norm(a) * 0.266 / 28
        rows += [(2 * k, "train", [float(np.float32(v)) for v in a]), (2 * k + 1, "valid", [float(np.float32(v)) for v in b])]
    x = np.array([r[2] for r in rows])
    s = cosines(x)
    want = {(2 * k + 1, 2 * k) for k in range(20) if s[2 * k, 2 * k + 1] > O.SAME}
    assert len(want) == 20 and np.sort(s - np.eye(40), axis=None)[-41] < 0.9
    df = spark.createDataFrame(rows, "row_id bigint, split string, x array<float>")
    assert {(r.eval_id, r.train_id) for r in O.overlaps(df).collect()} == want


def test_overlap_report(examples):
    pairs = O.overlaps(examples)
    rows = O.overlap_report(pairs, examples).collect()
    assert sum(r.n_pairs for r in rows) == pairs.count()
    assert {r.split for r in rows} <= {"test", "valid"} and "" in {r.source for r in rows}


def components(ids, x, least=0.71):
    s = cosines(x) >= least
    low = ids.copy()
    while True:
        new = np.array([low[s[i]].min() for i in range(len(ids))])
        if (new == low).all():
            return dict(zip(ids.tolist(), low.tolist()))
        low = new


@pytest.mark.parametrize(("block", "small"), [(5, 0), (40, 3), (2048, 100000)])
def test_clusters_equal_components(examples, usable, block, small):
    ids, x, train = usable
    got = {r.row_id: r.cluster_row for r in K.cluster_drawings(examples, block=block, small=small).collect()}
    assert got == components(ids[train], x[train])


@pytest.mark.parametrize("block", [2, 2048])
def test_chains_cross_cells_whose_representatives_are_far_apart(spark, block):
    # corners are the representatives, at cosine 0; of two steps between corners, each is at 0.5 to the other's corner
    corners = np.zeros((7, 784))
    for k in range(7):
        corners[k, 100 * k : 100 * k + 100] = 100
    x = [*corners, *(c for k in (0, 1, 2, 4) for c in (1.73 * corners[k] + corners[k + 1], corners[k] + 1.73 * corners[k + 1]))]
    x = np.round([v + (np.arange(784) == 783 - i) for i, v in enumerate(x)])
    ids = np.arange(1, len(x) + 1)
    df = spark.createDataFrame([(int(i), "train", [float(p) for p in v]) for i, v in zip(ids, x)], "row_id bigint, split string, x array<float>")
    want = components(ids, x)
    assert len(set(want.values())) == 3
    assert {r.row_id: r.cluster_row for r in K.cluster_drawings(df, block=block).collect()} == want


def test_bounds_keep_every_near_pair():
    rng = np.random.default_rng(6)
    forms = rng.random((6, 784)) ** 4
    cell = rng.integers(0, 6, 300)
    u = D.unit((forms[cell] * rng.random((300, 784)) + 0.3 * rng.random((300, 1)) * forms[rng.integers(0, 6, 300)]).astype(np.float32))
    for least in (0.5, 0.71, 0.8):
        bounds = B.Bounds(np.array([u[cell == c].mean(axis=0) for c in range(6)]), np.arange(6), float(np.arccos(least)))
        radii: dict = {}
        bounds.widest(u, cell, radii)
        bounds.radii = np.array([radii[c] for c in range(6)])
        chosen = set(zip(*(a.tolist() for a in bounds.candidates(u, cell))))
        i, j = np.nonzero((u @ u.T >= least) & (cell[:, None] != cell[None, :]))
        assert len(i) or least > 0.71
        assert all((a, cell[b]) in chosen for a, b in zip(i, j))


def test_cluster_descriptions(examples, usable):
    ids, x, train = usable
    clusters = components(ids[train], x[train])
    rows = K.describe_clusters(K.cluster_drawings(examples, block=30)).collect()
    sizes = {}
    for c in clusters.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r.cluster_row: r.size for r in rows} == sizes
    assert all(clusters[r.row_id] == r.cluster_row for r in rows)
    assert all(sum(r.cluster_row == c for r in rows) == min(3, n) for c, n in sizes.items())


def test_typical_rows_are_typical_of_their_whole_cluster(spark):
    rng = np.random.default_rng(10)
    form = shapes(rng, 1)[0]
    x = [drawing(rng, form) for _ in range(40)]
    s = cosines(np.array(x))
    x += [x[int(s.sum(axis=1).argmin())]] * 12  # copies of the least typical one have only each other as companions
    ids = np.arange(1, len(x) + 1)
    df = spark.createDataFrame([(int(i), "train", [float(p) for p in v]) for i, v in zip(ids, x)], "row_id bigint, split string, x array<float>")
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    others = u.sum(axis=0) - u
    typical = np.round((u * others).sum(axis=1) / np.linalg.norm(others, axis=1), 5)
    for block in (9, 2048):
        rows = sorted(K.describe_clusters(K.cluster_drawings(df, block=block)).collect(), key=lambda r: r.place)
        assert [r.row_id for r in rows] == ids[np.lexsort((ids, -typical))][:3].tolist() and rows[0].size == len(x)
        assert [r.typicality for r in rows] == pytest.approx(np.sort(typical)[::-1][:3], abs=1e-4)


def test_merging_by_mean_of_edges():
    a, b = np.array([1, 2, 3, 4, 7]), np.array([2, 3, 4, 5, 8])
    total = np.array([0.9, 0.8, 0.95, 0.5, 0.72])
    assert K.merge_rounds(a, b, total, np.ones(5), 0.71) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 7, 8: 7}
    # a repeated edge counts by its mean
    assert K.merge_rounds(np.array([1, 1]), np.array([2, 2]), np.array([0.9, 0.4]), np.ones(2), 0.71) == {1: 1, 2: 2}
    assert K.merge_rounds(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), 0.71) == {}


def test_distributed_rounds_equal_one_task(spark):
    rng = np.random.default_rng(5)
    edges = [(int(i), int(j), float(rng.uniform(0.71, 1)), 1) for i, j in rng.integers(0, 80, (90, 2)) if i != j]
    df = spark.createDataFrame(edges, "a bigint, b bigint, total double, n bigint")
    one, many = ({r.node: r.cluster for r in K.link(df, 0.71, small).collect()} for small in (1000, 0))
    assert one == many and len(set(one.values())) < len(one)


def test_farthest_first():
    z = np.array([[0.0, 0], [10, 0], [0, 1], [5, 5], [10, 0]], np.float32)
    picks, radii = V.farthest_first(z, 9)
    assert picks.tolist()[:3] == [0, 1, 3] and radii[0] == np.inf and radii[1] == 10 and radii[-1] == 0 and sorted(picks) == [0, 1, 2, 3, 4]
    assert len(V.farthest_first(np.zeros((0, 2), np.float32), 3)[0]) == 0


def test_varied_subsets(spark, examples, usable, monkeypatch):
    ids, x, train = usable
    requests = spark.createDataFrame([("small", 9), ("large", 60), ("all", 10_000)], "request_id string, subset_rows bigint")
    for gather in (V.GATHER, 7):  # 7: many rounds, each with few rows of the pool
        monkeypatch.setattr(V, "GATHER", gather)
        monkeypatch.setattr(V, "CHUNK", 40)
        monkeypatch.setattr(V, "LEAST", 20)
        rows = V.varied_subsets(examples, requests if gather > 7 else requests.where("request_id <> 'all'")).collect()
        got = {r: [q.row_id for q in rows if q.request_id == r] for r in ("small", "large", "all")}
        assert len(set(got["small"])) == 9 and len(set(got["large"])) == 60 and len(got["large"]) == 60
        assert set(got["small"]) <= set(got["large"]) <= set(ids[train].tolist())
        clusters = components(ids[train], x[train])
        # every shape is shown, and the one with a third of the rows takes no third
        hot = max(set(clusters.values()), key=list(clusters.values()).count)
        assert {clusters[i] for i in got["large"]} == set(clusters.values())
        share = sum(c == hot for c in clusters.values()) / len(clusters)
        assert sum(clusters[i] == hot for i in got["large"]) / 60 < share
        if gather > 7:
            assert sorted(got["all"]) == ids[train].tolist()
            whole = rows
    rows = whole
    label = {r.row_id: r.label for r in rows if r.request_id == "all"}
    assert label[1] == 9  # the latest delivery's
    assert examples.where(F.col("row_id") == 1).count() == 2
