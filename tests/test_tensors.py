from itertools import product

import numpy as np
import pytest

from sortalis.operators import tensor as t


def dense(x, shape):
    out = np.zeros(shape, np.int64)
    for r in x.frame.collect():
        out[tuple(r)[:-1]] = r.v
    assert x.frame.where("v = 0").isEmpty() and x.frame.count() == np.count_nonzero(out)
    return out


def sparse(spark, a, ring=t.INT):
    rows = [(*map(int, i), int(a[i])) for i in product(*map(range, a.shape)) if a[i]]
    return t.Tensor(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*t.indexes(a.ndim), "v"])), a.ndim, ring)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    return [rng.integers(-2, 3, (4, 4)) for _ in range(4)]


def test_operations(spark, arrays):
    a, b = arrays[:2]
    x, y = sparse(spark, a), sparse(spark, b)
    assert (dense(x.product(y), (4,) * 4) == np.einsum("ij,kl->ijkl", a, b)).all()
    assert (dense(x.sum(y), (4, 4)) == a + b).all() and (dense(x.hadamard(y), (4, 4)) == a * b).all()
    assert (dense(x.product(y).contract([0, 1, 1, 2], [0, 2]), (4, 4)) == a @ b).all()
    assert (dense(x.joined(y, [(1, 0)], [0, 3]), (4, 4)) == a @ b).all()
    assert (dense(x.project([1]), (4,)) == a.sum(0)).all() and (dense(x.exists(1), (4,)) == a.sum(1)).all()
    assert (dense(x.diagonal(0, 1), (4,)) == np.diag(a)).all() and (dense(x.project([1, 0]), (4, 4)) == a.T).all()
    assert dense(x.project([]), ()) == a.sum()
    three = t.scalar(spark, 3)
    assert (dense(three.product(x), (4, 4)) == 3 * a).all() and dense(t.product_all(spark, []), ()) == 1
    assert (dense(t.sum_all([x, y, t.zero(spark, 2)]), (4, 4)) == a + b).all()
    with pytest.raises(ValueError):
        t.sum_all([])


def test_booleans(spark, arrays):
    a, b = (np.abs(x) > 1 for x in arrays[:2])
    x, y = sparse(spark, a.astype(int), t.BOOL), sparse(spark, b.astype(int), t.BOOL)
    assert (dense(x.sum(y), (4, 4)) == (a | b)).all() and (dense(x.hadamard(y), (4, 4)) == (a & b)).all()
    assert (dense(x.exists(0), (4,)) == a.any(0)).all()
    assert (dense(x.joined(y, [(1, 0)], [0, 3]), (4, 4)) == ((a.astype(int) @ b.astype(int)) > 0)).all()


@pytest.mark.parametrize("op", ["product", "hadamard", "sum", "contract"])
def test_changes(spark, arrays, op):
    a, b, da, db = arrays
    x = t.Incremental(sparse(spark, a), sparse(spark, da))
    y = t.Incremental(sparse(spark, b), sparse(spark, db))
    if op == "contract":
        got, old, new = x.contract([0, 1], [1]), a.sum(0), (a + da).sum(0)
    else:
        f = {"product": lambda p, q: np.einsum("ij,kl->ijkl", p, q), "hadamard": np.multiply, "sum": np.add}[op]
        got, old, new = getattr(x, op)(y), f(a, b), f(a + da, b + db)
    assert (dense(got.value, old.shape) == old).all() and (dense(got.delta, old.shape) == new - old).all()
    assert (dense(got.settle(), new.shape) == new).all()


def test_changes_saturate(spark):
    a, d = np.array([1, 0, 1]), np.array([-1, 1, 1])
    x = t.Incremental(sparse(spark, a, t.BOOL), sparse(spark, d))
    assert dense(x.settle(), (3,)).tolist() == [0, 1, 1]
    assert dense(x.contract([0], []).settle(), ()) == 1
    n = t.Incremental(sparse(spark, np.array([2, 5, 0]), t.NAT), sparse(spark, np.array([-3, -1, 2])))
    assert dense(n.settle(), (3,)).tolist() == [0, 4, 2]


def test_patterns(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "i0 long") for xs in ([1, 2, 3], [2, 3, 4]))
    rows = lambda f: sorted(r.i0 for r in f.collect())
    assert rows(t.pattern_union(a, b)) == [1, 2, 3, 4] and rows(t.pattern_intersection(a, b)) == [2, 3]
    assert rows(t.pattern_difference(a, b)) == [1] and rows(t.pattern_symmetric_difference(a, b)) == [1, 4]
