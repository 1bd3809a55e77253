"""Hard negatives and whitening against brute-force versions, on real and odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tremolith.llm import hard_negatives as H, whitening as W
from tremolith.llm.queries import QUERIES

DDL = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def odd_rows():
    """Copies, ties, null and non-finite entries, short and empty vectors, null and repeated ids."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(6, 8))
    rows = [(i, (near[i % 6] + 0.05 * rng.normal(size=8)).tolist(), int(i % 3)) for i in range(0, 400, 2)]
    rows += [(50, near[0].tolist(), 1), (1001, near[0].tolist(), 1), (1003, near[0].tolist(), 2), (1005, None, 1), (1007, near[1].tolist(), None), (1009, [1.0, None] + [0.0] * 6, 1),
             (1011, [NAN] + [0.0] * 7, 1), (1013, [INF] + [0.0] * 7, 2), (None, near[2].tolist(), 1), (None, near[2].tolist(), 2), (1015, [], 1), (1017, near[3].tolist()[:5], 0), (1019, [0.0] * 8, 0), (450, [0.0] * 8, 0), (-50, near[4].tolist(), 2)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame(odd_rows(), DDL)
    for name in ("row", "id", "x", "v", "anchor", "score", "component", "rank"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame.repartition(5).cache()


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_negatives(rows, every=50, positives=5, negatives=3):
    kept = [(k, i, lab, [math.floor(256 * c) for c in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and usable(v)]
    first = lambda scored: sorted(scored, key=lambda e: (-e[0], e[1] is None, e[1] or 0))
    out = []
    for k, i, lab, x in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, other) for m, j, other, y in kept if m != k]
        for p, pid, _ in first([e for e in scored if e[2] == lab])[:positives]:
            for rank, (s, nid, _) in enumerate(first([e for e in scored if e[2] != lab and 50 * p <= 100 * e[0] <= 95 * p])[:negatives], 1):
                out.append((i, pid, rank, nid, p, s))
    return sorted(out, key=repr)


def mined(rows):
    return sorted(map(tuple, H.hard_negatives(rows).collect()), key=repr)


def test_hard_negatives_of_odd_rows(table):
    want = brute_negatives(odd_rows())
    assert len(want) > 50 and any(r[3] is None for r in want)
    assert mined(H.integer_rows(table)) == want


def test_hard_negatives_in_many_rounds_and_blocks(table, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 2)
    monkeypatch.setattr(H, "CELLS", 64 * 3)
    assert len(list(H.rounds(H.plant(H.integer_rows(table)), 3))) > 1
    monkeypatch.setattr(H.rounds, "__defaults__", (3,))
    assert mined(H.integer_rows(table)) == brute_negatives(odd_rows())


def test_no_anchor_no_rows(table):
    rows = H.integer_rows(table)
    for part in (rows.where("false"), rows.where("id % 50 <> 0"), H.integer_rows(table.where("false")), H.integer_rows(table.where("vec_id = 450"))):
        assert H.hard_negatives(part).count() == 0


def test_bounds_prune_and_lose_nothing():
    """Tight clusters: most candidates lie outside every window by their bounds; the rest gives the full result."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 400
    x = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))).astype(np.int64)
    anchors = np.arange(40)
    parent, edge = H.spanning_tree(x[anchors].astype(float))
    away = np.linalg.norm(x[anchors][:, None] - x[anchors][None], axis=2)
    inside, total = {0}, 0.0
    while len(inside) < 40:  # a least tree has this length
        d, to = min((away[i, j], j) for i in inside for j in range(40) if j not in inside)
        inside.add(to)
        total += d
    assert math.isclose(edge.sum(), total) and parent[0] == 0
    depth = np.zeros(40, int)
    for _ in range(40):
        depth = np.where(parent == anchors, 0, depth[parent] + 1)
    order = np.argsort(depth, kind="stable")
    back = np.argsort(order)
    cuts = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
    label = np.zeros(900, np.int64)
    trees = H.Round(order, label[order], x[order], back[parent[order]], edge[order], list(zip(cuts[:-1].tolist(), cuts[1:].tolist())), size=int(np.abs(x[:40]).max()))
    scores = x @ x.T
    top = np.sort(scores[order], axis=1)[:, -30]
    trees.low, trees.high = top[:, None].copy(), np.full((40, 1), 2 ** 62)
    search = H.Search(trees, 5, True)
    search(np.arange(900), np.arange(900), np.zeros(900, bool), label, x)
    a, _, _, ids, _, s = search.kept
    for k, r in enumerate(order):
        want = sorted(((-scores[r, c], c) for c in range(900) if c != r))[:5]
        assert [(-v, c) for v, c in zip(s[a == k].tolist(), ids[a == k].tolist())] == want
    assert search.scored < 0.5 * search.met


def test_large_scores_are_whole_numbers(spark):
    big = [(0, [2.0 ** 20 + 0.5, 3.0], 0), (1, [2.0 ** 20, 5.0], 0), (2, [2.0 ** 20 * 0.9, 7.0], 1), (3, [2.0 ** 20 * 0.8, 1.0], 1)]
    rows = [(i, [c * 4 for c in v], lab) for i, v, lab in big]
    assert mined(H.integer_rows(spark.createDataFrame(rows, DDL))) == brute_negatives(rows)
    with pytest.raises(Exception, match="beyond long"):
        mined(H.integer_rows(spark.createDataFrame([(0, [1e9, 1e9], 0), (1, [1e9, 1e9], 0), (2, [1.0, 1.0], 1)], DDL)))
    with pytest.raises(Exception, match="OVERFLOW"):
        mined(H.integer_rows(spark.createDataFrame([(0, [1e300], 0)], DDL)))


# --- whitening

def brute_whitening(rows, k=16):
    kept = [(i, v) for i, v, _ in rows if usable(v) and len(v) == 8]
    x = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in kept}
    n, dims = len(x), 8
    s = [sum(v[d] for v in x) for d in range(dims)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, c in kept:
        own = [math.floor(64 * a) + 1_000_000 for a in c]
        far = [n * a - b for a, b in zip(own, s)]
        y = np.array([float(Fraction(a, n)) for a in far]) @ u / np.sqrt(e)
        out.append((i, sum(a * a for a in far), y))
    return n, e, sorted(out, key=lambda r: (repr(r[0]), r[1]))


def test_whitening_of_odd_rows(table):
    n, e, want = brute_whitening(odd_rows())
    rows = W.integer_rows(table)
    model, distinct = W.fit(rows)
    assert model.n == n and np.allclose(model.values, e, rtol=1e-9) and np.allclose(model.explained, e / e.sum(), rtol=1e-9)
    assert 0 <= W.identity_error(distinct, model, 16) < 1e-9
    got = {}
    for r in W.apply(rows, model, 16).collect():
        got.setdefault((repr(r.id), r.deviation), []).append((r.component, r.whitened))
    assert sum(map(len, got.values())) == 8 * len(want)
    for i, deviation, y in want:
        mine = dict(got[repr(i), deviation])
        assert set(mine) == set(range(1, 9))
        assert np.allclose(np.abs([mine[c] for c in range(1, 9)]), np.abs(y), atol=1e-7)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for low, high, n in ((-3, 4, 1), (999_900, 1_000_100, 777), (-2 ** 40, 2 ** 41, 130), (5, 6, 70), (-2 ** 62, 2 ** 62, 9)):
        x = rng.integers(low, high, (n, 5))
        sums, products = W.scatter(x)
        rows = [[int(v) for v in r] for r in x]
        assert sums == [sum(r[d] for r in rows) for d in range(5)]
        assert products == {(i, j): sum(r[i] * r[j] for r in rows) for i in range(5) for j in range(i, 5)}


def test_degenerate_vectors(spark):
    def run(rows):
        model, distinct = W.fit(r := W.integer_rows(spark.createDataFrame(rows, DDL)))
        return W.apply(r, model, 16).collect(), model, distinct
    assert run([])[0] == [] and run([(1, [], 0)])[0] == [] and run([(1, [0.5, 0.5], 0)] * 3)[0] == []
    got, model, distinct = run([(1, [1.0, 7.0, 2.0], 0), (2, [2.0, 7.0, 4.0], 0), (3, [4.0, 7.0, 8.0], 0), (4, [4.0, 7.0, 8.0], None)])  # one direction only
    assert {r.component for r in got} == {1} and len(got) == 4 and model.n == 3 and W.identity_error(distinct, model, 16) < 1e-9
    with pytest.raises(Exception, match="OVERFLOW"):
        run([(1, [1e300], 0)])
    with pytest.raises(Exception, match="beyond long"):
        run([(1, [1e8], 0), (2, [-1e8], 0)])


def test_whitening_query(spark):
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert len(rows) == 16 * len(table) and rows[0].identity_error < 1e-4
    y = np.zeros((len(table), 16))
    place = {r.vec_id: k for k, r in enumerate(table)}
    for r in rows:
        y[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(y.T @ y / len(table) - np.eye(16)).max() < 1e-9  # all vectors are distinct here
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in t.embedding] for t in table]
    s = [sum(c) for c in zip(*x)]
    exact = {t.vec_id: sum((len(x) * a - b) ** 2 for a, b in zip(r, s)) for t, r in zip(table, x)}
    assert all(r.deviation == exact[r.vec_id] for r in rows)
