"""Product codes against comparing every part with every entry."""

import hashlib
from math import floor

import numpy as np
import pytest

from cinderlog.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """vec_id to (code, error, label error) and the codebooks, for unique vec_ids."""
    kept = sorted(
        (i, [floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and np.isfinite(x) for x in v)
    )
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i, *_ in kept[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[[] for _ in b] for b in books]
        for parts_of in cut.values():
            for p, x in enumerate(parts_of):
                found[p][near(p, x)[1]].append(x)
        books = [
            [[sum(c) // len(own) for c in zip(*own)] if own else e for e, own in zip(b, f)]
            for b, f in zip(books, found)
        ]
    best = {i: [near(p, x) for p, x in enumerate(c)] for i, c in cut.items()}
    error = {i: sum(d for d, _ in b) for i, b in best.items()}
    total = {}
    for i, _, label in kept:
        total[label] = total.get(label, 0) + error[i]
    out = {
        i: ("".join(f"{k:02x}" for _, k in best[i]), error[i], total[label]) for i, _, label in kept
    }
    return out, books


def coded(spark, rows, **options):
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    out = codes.label_errors(found).collect()
    return {r.vec_id: (r.code, r.error, r.label_error) for r in out}, books


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_against_all_entries(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in rng.permutation(700).tolist():
        v = (rng.normal(size=12) * rng.choice([0.01, 0.3, 40])).astype(np.float32)
        rows.append((i, np.round(v, 1 if i % 3 else 6).tolist(), int(rng.integers(4)) or None))
    rows += [(1000 + i, rows[0][1], 9) for i in range(300)]  # copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 12, 1), (2003, [float("nan")] * 12, 1)]
    rows += [(2004, [1.0] * 11 + [float("-inf")], None)]
    options = {"parts": 4, "entries": 20, "rounds": 2}
    want, books = plain(rows, **options)
    got, own = coded(spark, rows, block=block, **options)
    assert own.tolist() == books
    assert got == want
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert codes.digest(own) == hashlib.sha256(text.encode()).hexdigest()


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, -1.0], 1)]
    rows += [(i, [1.0, 0.0], None) for i in range(4, 90)]
    options = {"parts": 1, "entries": 3, "rounds": 1}
    want, books = plain(rows, **options)
    got, own = coded(spark, rows, **options)
    assert got == want and own.tolist() == books
    assert own[0][1].tolist() == [0, 0] and own[0][0].tolist() != [0, 0]


def test_fewer_rows_than_entries_repeated_ids_and_null_ids(spark):
    rows = [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [0.5, 0.5], None), (7, [3.0, 1.0], 2)]
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2, rounds=0)
    assert books.shape == (2, 3, 1) and books[0].ravel().tolist() == [256, 256, 768]
    out = sorted(codes.label_errors(found).collect(), key=repr)
    assert [r.code for r in out if r.vec_id == 5] == ["0000", "0000"]
    assert [r.vec_id for r in out].count(None) == 1 and len(out) == 4


def test_other_lengths_empty_tables_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], 1), (0, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 5.0], 1)]
    got, books = coded(spark, rows, parts=2)
    assert set(got) == {0, 2} and books.shape == (2, 2, 2)
    got, books = coded(spark, [(0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0], 1)], parts=2)
    assert got == {} and books.size == 0
    empty, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "label", "code", "error"] and empty.count() == 0
    df = spark.createDataFrame(rows[1:], SCHEMA).selectExpr("*", "'x' AS code", "1 AS c_ids", "2 AS vector")
    found, _ = codes.compress(df, parts=2)
    assert found.columns == ["vec_id", "label", "code", "error"] and found.count() == 2


def test_large_components_are_exact_and_larger_ones_refused(spark):
    rows = [(i, [float(1 << 22) + i / 256, -float(1 << 22) - i], 1) for i in range(9)]
    schema = "vec_id long, embedding array<double>, label int"
    found, books = codes.compress(spark.createDataFrame(rows, schema), parts=2, entries=4)
    want, plain_books = plain(rows, 2, 4, codes.ROUNDS)
    assert books.tolist() == plain_books
    assert {r.vec_id: r.code for r in found.collect()} == {i: c for i, (c, *_) in want.items()}
    with pytest.raises(ValueError, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 2, 1)], schema), parts=2)


def test_balls_cache_sums_and_cover_their_points():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.integers(-300, 300, (3000, 3)), np.zeros((200, 3), int)])
    tree = codes.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    assert len(tree.counts) > 3
    for b in range(len(tree.counts)):
        own = points[tree.order[tree.start[b] : tree.start[b] + tree.counts[b]]]
        assert (own.sum(axis=0) == tree.sums[b]).all()
        away = np.sqrt(np.square(own - tree.sums[b] / tree.counts[b]).sum(axis=1))
        assert away.max() <= tree.radius[b] + 1e-6
    entries = np.array([[-200, -200, -200], [200, 200, 200], [0, 0, 0], [200, 200, 200]])
    code, sums, counts = codes.assign(tree, points, entries)
    assert (code == codes.nearest(points, entries)).all() and 3 not in code
    assert counts.sum() == len(points) and (sums.sum(axis=0) == points.sum(axis=0)).all()
    owned = (np.square(points[:, None] - entries[None]).sum(axis=2).argmin(axis=1) == code).all()
    assert owned
