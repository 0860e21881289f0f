"""Vector codes against a plain loop over all rows and entries."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tallymark.llm import vectorcodes as vc
from tallymark.llm.queries import QUERIES


def plain(points, entries):
    """Entry, distance, counts and sums by comparing everything."""
    d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    counts = np.bincount(near, minlength=len(entries))
    sums = np.stack([points[near == e].sum(axis=0) for e in range(len(entries))])
    return near, d.min(axis=1), counts, sums


def whole(vectors, parts=8, entries=16, rounds=6):
    """(codes, errors, books) of integer vectors that stand in the order of their ids."""
    v = np.array(vectors, dtype=np.int64)
    cuts = np.split(v, parts, axis=1)
    books = [c[:entries].copy() for c in cuts]
    for _ in range(rounds):
        for c, b in zip(cuts, books, strict=True):
            _, _, counts, sums = plain(c, b)
            b[counts > 0] = sums[counts > 0] // counts[counts > 0][:, None]
    found = [plain(c, b)[:2] for c, b in zip(cuts, books, strict=True)]
    codes = ["".join(f"{n[i]:02x}" for n, _ in found) for i in range(len(v))]
    return codes, sum(d for _, d in found), np.stack(books)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 20), st.integers(1, 5), st.integers(1, 60), st.integers(0, 2**32 - 1))
def test_dual_tree_equals_comparing_everything(n, k, d, spread, seed):
    draw = np.random.default_rng(seed)
    points = draw.integers(-spread, spread, (n, d)) + 100 * draw.integers(0, 3, (n, 1))
    entries = points[draw.integers(0, n, k)] + draw.integers(0, 2, (k, d))
    tree = vc.Tree(points, 4)
    found = vc.Assigner(tree, entries)
    near, distance, counts, sums = plain(points, entries)
    by_row = found.by_row(n)
    assert (by_row[0] == near).all() and (by_row[1] == distance).all()
    assert (found.counts == counts).all() and (found.sums == sums).all()


def test_whole_nodes_are_assigned_by_their_sums(monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.integers(-10**6, 10**6, (16, 8))
    points = centres[draw.integers(0, 16, 4096)] + draw.integers(-50, 50, (4096, 8))
    compared = []
    plain_compare = vc.Assigner._compare
    monkeypatch.setattr(vc.Assigner, "_compare", lambda s, p, e: (compared.append(len(set(p))), plain_compare(s, p, e)))
    found = vc.Assigner(vc.Tree(points, 32), centres)
    assert (found.counts == plain(points, centres)[2]).all()
    assert sum(compared) <= 16  # leaves, of 128


@pytest.fixture(scope="module")
def table(spark):
    def make(rows, kind="array<float>"):
        return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(4)

    return make


def check(df, vectors, ids):
    codes, books = vc.compress_vectors(df)
    expected = whole(vectors)
    rows = sorted((r.vec_id, r.code, r.error) for r in codes.collect())
    assert rows == sorted(zip(ids, expected[0], map(int, expected[1]), strict=True))
    assert (books == expected[2]).all()


def test_whole_query_against_the_loop(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    vectors = [[int(np.floor(4096 * float(x))) for x in r.embedding] for r in rows]
    codes, errors, books = whole(vectors)
    found = {r.vec_id: r for r in QUERIES["op13_vector_codes"](spark, sf).collect()}
    assert {r.vec_id: (c, e) for r, c, e in zip(rows, codes, errors, strict=True)} == {
        i: (r.code, r.error) for i, r in found.items()
    }
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    assert all(found[r.vec_id].label_error == by_label[r.label] for r in rows)
    assert {r.codebooks_sha256 for r in found.values()} == {vc.book_digest(books)}


def test_hot_vectors_ties_and_unused_entries(table):
    draw = np.random.default_rng(3)
    vectors = [[1, 2] * 8] * 30 + draw.integers(-4, 4, (70, 16)).tolist()
    check(table([(i, [x / 4096 for x in v], None) for i, v in enumerate(vectors)]), vectors, range(100))


def test_few_vectors(table):
    vectors = [[5] * 8, [-3] * 8]
    check(table([(9, [x / 4096 for x in vectors[1]], 1), (4, [x / 4096 for x in vectors[0]], 1)]), vectors, [4, 9])


def test_floors_go_down(table):
    vectors = [[-1] * 8, [0] * 8]
    check(table([(0, [-1e-9] * 8, 1), (1, [1e-9] * 8, 1)], "array<double>"), vectors, [0, 1])


def test_left_out_and_filled_up(table, spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [1.0] * 7 + [None], 1), (2, [nan] * 8, 1), (3, [inf] * 8, 1), (4, [-inf] + [0.0] * 7, 1)]
    rows += [(5, [], 1), (6, [0.5] * 3, None), (7, [0.25] * 9, None), (None, [0.25] * 9, 2), (7, [0.25] * 9, None)]
    filled = [[0] * 16, [2048] * 3 + [0] * 13, *[[1024] * 9 + [0] * 7] * 3]
    codes, books = vc.compress_vectors(table(rows).withColumnRenamed("label", "mark"), label="mark")
    expected = whole(filled)
    assert sorted((r.vec_id or 99, r.code, r.error) for r in codes.collect()) == sorted(
        zip([5, 6, 7, 7, 99], expected[0], map(int, expected[1]), strict=True)
    )
    assert (books == expected[2]).all()


def test_label_errors_and_clashing_columns(table, spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 7), 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], i % 3 or None) for i in range(40)]
    df = table(rows)
    df = df.select("*", *(F.lit("?").alias(c) for c in "id v ids labels code error rows part entry n".split()))
    codes, _ = vc.compress_vectors(df)
    out = vc.with_label_errors(codes)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    found = out.collect()
    for label in (None, 1, 2):
        same = [r for r in found if r.label == label]
        assert {r.label_error for r in same} == {sum(r.error for r in same)}
    assert len(found) == 40


def test_empty_table(table):
    assert vc.compress_vectors(table([(0, None, 1)]))[0].collect() == []
    assert vc.compress_vectors(table([]))[0].collect() == []


def test_too_large_components_are_refused(table):
    with pytest.raises(PySparkException, match="below 4096"):
        vc.compress_vectors(table([(0, [5000.0] * 8, 1)]))
