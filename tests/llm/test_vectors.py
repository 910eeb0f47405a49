"""Vector codes, hard negatives and near vectors against plain Python."""

import heapq
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import codes, negatives, pivots, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: Columns with names that the operators use themselves, and an array of doubles.
FORM = "vec_id long, label int, embedding array<double>, node string, place int, block string, error string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, label, v, "n", 1, "b", "e") for i, label, v in rows], FORM)


def some(seed, n, dims=16, labels=3, copies=()):
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(labels)), r.normal(0, 0.3, dims).tolist()) for i in range(n)]
    for i, of, noise in copies:
        rows.append((i, rows[of][1], (np.array(rows[of][2]) + r.normal(0, noise, dims) * (noise > 0)).tolist()))
    return rows


ODD = [(900, 1, None), (901, 1, [float("nan")] + [0.1] * 15), (902, 1, [None] + [0.1] * 15), (903, 1, [float("inf")] + [0.1] * 15), (904, 1, []), (905, 1, [0.5] * 3)]


def codes_by_hand(rows, parts, entries, rounds):
    """vec_id -> code and error; and the final codebooks."""
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, _, v in sorted(rows, key=lambda r: (r[0], r[2]))]
    width = len(vectors[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    books = [[cut(v, p) for _, v in vectors[:entries]] for p in range(parts)]
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v in vectors:
                own.setdefault(nearest(cut(v, p), book), []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(book)]
    done = []
    for i, v in vectors:
        es = [nearest(cut(v, p), books[p]) for p in range(parts)]
        done.append((i, "".join(f"{e:02x}" for e in es), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(es))))
    return sorted(done), books


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes_are_lloyd_s(spark, rounds, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 37)
    rows = some(1, 150, copies=[(200 + i, 3, 0) for i in range(40)] + [(7, 9, 0)])  # a group of copies, and a repeated id
    got = codes.compress(table_of(spark, rows + ODD), parts=4, entries=12, rounds=rounds)
    want, books = codes_by_hand(rows, 4, 12, rounds)
    assert sorted((r.vec_id, r.code, r.error) for r in got.rows.collect()) == want
    assert [b.tolist() for b in got.books] == books


def test_heaps_pop_only_what_drift_has_reached():
    r = np.random.default_rng(0)
    parts = r.integers(-200, 200, (300, 2, 4))
    books = [parts[:8, p].copy() for p in (0, 1)]
    block = codes._Block.assigned(parts, books)
    assert all(heap[0] == min(heap) for own in block.heaps for heap in own if heap)
    still = block.repair(books, np.zeros((2, 8)))
    assert not still[0].any() and not still[1].any() and block.rescanned.sum() < 5  # ties at most
    new, lost = codes._moved(books, *block.totals(books))
    before = block.totals(new)
    back = codes._Block.unpacked(block.packed(), books)
    change = back.repair(new, lost)
    assert 0 < back.rescanned.sum() < 600
    assert (before[0] + change[0] == back.totals(new)[0]).all() and (before[1] + change[1] == back.totals(new)[1]).all()
    for p in (0, 1):
        assert (back.codes[:, p] == codes._nearest(parts[:, p], new[p])[0]).all()
        for e, heap in enumerate(back.heaps[p]):
            assert sorted(i for _, i in heap) == np.nonzero(back.codes[:, p] == e)[0].tolist()
            assert heap == [] or heap[0] == min(heap) and heapq.nsmallest(1, heap)[0] == heap[0]


def test_codes_of_odd_tables(spark):
    assert codes.compress(table_of(spark, [])).rows.count() == 0
    assert codes.compress(table_of(spark, ODD)).rows.count() == 0
    one = codes.compress(table_of(spark, [(1, None, [0.25] * 16)]))
    assert [(r.vec_id, r.label, r.code, r.error) for r in one.rows.collect()] == [(1, None, "00" * 16, 0)]
    huge = codes.compress(table_of(spark, [(1, 0, [1e300] * 16), (2, 0, [-1e300] * 16), (None, 0, [1e300] * 16)]))
    assert sorted((r.vec_id or 0, r.code) for r in huge.rows.collect()) == [(0, "00" * 16), (1, "00" * 16), (2, "01" * 16)]
    rows = codes.compress(table_of(spark, [(1, None, [0.0] * 16), (2, None, [0.5] * 16), (3, 1, [0.9] * 16)]), entries=1, rounds=0).rows
    assert {r.vec_id: r.label_error for r in codes.with_label_error(rows).collect()} == {1: 16 * 128**2, 2: 16 * 128**2, 3: 16 * 230**2}


def mined_by_hand(rows, anchors, positives=5, negatives=3, low=50, high=95):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in kept:
        if i % anchors:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 13)
    monkeypatch.setattr(negatives, "CHUNK", 20)
    rows = some(2, 160, copies=[(300 + i, 4, 0) for i in range(30)] + [(400 + i, 5, 0.02) for i in range(20)])
    rows += [(500, None, [0.1] * 16), (None, 1, [0.1] * 16), (510, 2, [-0.3] * 16), (515, 2, [0.0] * 16)]
    got = negatives.mine(table_of(spark, rows + ODD), F.col("vec_id") % 5 == 0).collect()
    want = mined_by_hand(rows, 5)
    assert sorted(tuple(r) for r in got) == want and len(want) > 300
    assert negatives.mine(table_of(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(table_of(spark, rows), F.lit(False)).count() == 0
    twice = [(0, 1, [0.1] * 16), (0, 1, [0.1] * 16), (1, 1, [0.1] * 16), (2, 2, [0.06] * 16)]
    assert [tuple(r)[:4] for r in negatives.mine(table_of(spark, twice), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2)] * 2


def test_best_is_kept_in_parts():
    r = np.random.default_rng(3)
    scores = r.integers(-4, 5, (6, 90)).astype(float)
    scores[r.random(scores.shape) < 0.3] = -np.inf
    ids = r.permutation(90)
    best = negatives.Best(6, 4)
    for begin in range(0, 90, 17):
        best.offer(np.arange(6), scores[:, begin : begin + 17], ids[begin : begin + 17])
    for a in range(6):
        want = sorted((-s, i) for s, i in zip(scores[a], ids, strict=True) if s > -np.inf)[:4]
        assert [(-s, i) for s, i in zip(best.score[a], best.id[a], strict=True)] == want


def near_by_hand(rows):
    ok = lambda label, v: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, lead = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, (_, la, va) in enumerate(rows):
        for b in range(a + 1, len(rows)):
            _, lb, vb = rows[b]
            if la != lb or not ok(la, va) or not ok(lb, vb) or len(va) != len(vb):
                continue
            x, y = np.array(va), np.array(vb)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                n[a] += 1
                n[b] += 1
                lead[root(a)] = root(b)
    least = {}
    for i, (own, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), own), own)
    return sorted((own, n[i], least[root(i)], own == least[root(i)]) for i, (own, _, _) in enumerate(rows))


@pytest.mark.parametrize("size", [1024, 9])
def test_near_vectors(spark, size, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", size)
    # A chain, a group of exact copies, a large group of near copies, scaled ones.
    rows = some(4, 120, dims=32, copies=[(200 + i, 4, 0) for i in range(40)] + [(300 + i, 5, 0.01) for i in range(60)] + [(400 + i, i, 0.08) for i in range(50)])
    for i in range(12):
        rows.append((600 + i, 2, (np.cos(i * 0.3) * np.eye(32)[0] + np.sin(i * 0.3) * np.eye(32)[1]).tolist()))
    rows += [(700, rows[4][1], [3 * x for x in rows[4][2]]), (701, None, rows[4][2]), (702, 1, [0.0] * 32), (3, rows[3][1], rows[3][2])]
    got = pivots.duplicates(table_of(spark, rows + ODD)).collect()
    want = near_by_hand(rows + ODD)
    assert sorted(tuple(r) for r in got) == want
    assert max(w[1] for w in want) >= 59 and sum(not w[3] for w in want) > 100


def test_near_vectors_of_odd_tables(spark):
    assert pivots.duplicates(table_of(spark, [])).count() == 0
    assert sorted(r.vec_id for r in pivots.duplicates(table_of(spark, ODD)).collect()) == [900, 901, 902, 903, 904, 905]
    rows = [(None, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (None, 2, [1.0, 2.0]), (6, 1, [1e200, 2e200]), (7, 1, [1e-200, 2e-200])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivots.duplicates(table_of(spark, rows)).collect())
    assert got == [(0, 0, None, True), (0, 3, 5, False), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False)]


def test_candidates_are_those_of_enough_shared_pivots():
    r = np.random.default_rng(5)
    sets = [np.sort(np.stack([r.choice(40, 6, replace=False) for _ in range(n)]), axis=1) for n in (50, 60)]
    total = np.zeros((50, 60), int)
    for place in range(40):
        listed = [(x[:, :4] == place).any(axis=1) for x in sets]
        total += pivots.candidates(*sets, 4, 3, place, 40) & listed[0][:, None] & listed[1][None, :]
    want = np.array([[len(set(a) & set(b)) >= 3 for b in sets[1].tolist()] for a in sets[0].tolist()])
    assert (total == want).all() and want.any()  # each once, though it shares several


@needs_data
def test_registered_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect()) == mined_by_hand(moved, 50)
    assert sorted(tuple(r) for r in queries.op13_near_vectors(spark, SF).collect()) == near_by_hand(rows)
