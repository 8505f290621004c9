"""Solvers and norms against published golden values and identities."""

import math

import numpy as np
import pytest

from covaria.functions import quantiles, solve

# An independent implementation's results for the small literal matrices below.
WHITENED = 0.920269686720309
OBJECTIVE = 0.146928751968263
BIDIR_NONE = (-0.0147814896915625, 0.280970537137005)
BIDIR_ROW_COL = (0.131636385742834, 0.193331107652007)
AXES = {
    "A": [[0.338761197791698, -0.91931090449336, 0.200270596319913], [-0.726093464921596, -0.120071307414902, 0.677031137639789]],
    "B": [[-0.599180524232106, 0.724909291667538, 0.33983704658999], [0.37055907717766, 0.627370998486583, -0.684902621238369]],
    "C": [[0.592305197518799, 0.353581697017329, -0.723985177007487], [0.440165189368661, -0.894625322344129, -0.0768123602600126]],
}
K = np.array([[1.2, 0.3, 0.1], [0.4, 1.1, 0.2], [0.2, 0.5, 0.9]])
RX = np.array([[1.0, 0.2, 0.1], [0.2, 0.9, 0.3], [0.1, 0.3, 1.1]])
RY = np.array([[0.8, 0.1, 0.2], [0.1, 1.2, 0.4], [0.2, 0.4, 1.0]])
A = np.array([[-1.0, 0.2], [0.4, 1.1], [1.3, -0.5]])
B = np.array([[0.8, -0.4], [-1.1, 1.2], [1.6, 0.5]])
XA = np.array([[0.5, -1.2, 0.3], [1.1, 0.4, -0.7], [-0.9, 0.8, 1.0], [0.2, -0.5, 0.6]])
XB = np.array([[-0.3, 1.0, 0.5], [0.7, -0.6, 0.9], [1.2, 0.1, -0.4], [-0.8, 0.5, 0.2]])
XC = np.array([[0.6, 0.2, -1.1], [-0.4, 0.9, 0.7], [0.3, -0.8, 0.4], [1.0, 0.5, -0.2]])
KAB = np.array([[1.0, 0.2, 0.1, 0.0], [0.1, 0.9, 0.3, 0.2], [0.0, 0.4, 1.1, 0.1], [0.3, 0.1, 0.2, 0.8]])
KAC = np.array([[0.9, 0.1, 0.2, 0.1], [0.2, 1.0, 0.1, 0.0], [0.1, 0.3, 0.8, 0.2], [0.0, 0.2, 0.1, 1.1]])
KBC = np.array([[1.1, 0.0, 0.1, 0.2], [0.1, 0.8, 0.2, 0.1], [0.3, 0.1, 1.0, 0.0], [0.2, 0.2, 0.1, 0.9]])


def test_three_types_match_golden_axes():
    x = {"A": XA, "B": XB, "C": XC}
    y = {("A", "B"): XA.T @ KAB @ XB, ("A", "C"): XA.T @ KAC @ XC, ("B", "C"): XB.T @ KBC @ XC}
    start = {t: np.linalg.svd(m)[2][0] for t, m in x.items()}
    got = solve.Problem(y, ["A", "B", "C"]).solve(2, 20_000, 1e-11, start=start)
    for t, axes in AXES.items():
        for k, want in enumerate(axes):
            assert min(np.abs(got[t][:, k] - want).max(), np.abs(got[t][:, k] + want).max()) < 1e-6


def test_metric_is_a_change_of_coordinates():
    rng = np.random.default_rng(3)
    sd = {t: rng.uniform(0.6, 2.1, 4) for t in "ABC"}
    y = {(a, b): rng.normal(size=(4, 4)) for a, b in (("A", "B"), ("A", "C"), ("B", "C"))}
    raw = {(a, b): sd[a][:, None] * m * sd[b] for (a, b), m in y.items()}
    one = solve.Problem(y, list("ABC")).solve(3, 20_000, 1e-12)
    two = solve.Problem(raw, list("ABC"), {t: s**2 for t, s in sd.items()}).solve(3, 20_000, 1e-12)
    for t in "ABC":
        assert np.allclose(np.abs(one[t]), np.abs(two[t] * sd[t][:, None]), atol=1e-6)


def test_two_types_are_singular_vectors():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(5, 5))
    got = solve.Problem({("A", "B"): y}, ["A", "B"]).solve(3)
    assert np.allclose(got["A"].T @ got["A"], np.eye(3)) and np.allclose(np.diag(got["A"].T @ y @ got["B"]), np.linalg.svd(y)[1][:3])


def test_one_type_is_an_eigenvector():
    m = np.array([[2.0, 1.0], [0.0, 1.0]])
    got = solve.Problem({("A", "A"): m}, ["A"]).solve(1)
    assert math.isclose((got["A"].T @ m @ got["A"]).item(), np.linalg.eigvalsh((m + m.T) / 2)[-1])


def test_genespace_objective_golden():
    w = {"A": np.array([0.8, 0.6]), "B": np.array([-0.3, math.sqrt(0.91)])}
    own = {"s1": {"A": np.diag([1, 1.5]), "B": np.diag([0.8, 1.2])}, "s2": {"A": np.diag([1.3, 0.7]), "B": np.diag([1.1, 0.9])}}
    cross = {"s1": {("A", "B"): np.array([[0.7, 0.1], [-0.2, 0.5]])}, "s2": {("B", "A"): np.array([[0.4, -0.3], [0.2, 0.8]]).T}}
    assert math.isclose(solve.genespace_objective(w, own, cross, ["s1", "s2"], ["A", "B"]), OBJECTIVE, rel_tol=1e-12)


def test_genespace_axes_on_identity():
    own = {"s": {"A": np.eye(4), "B": np.eye(4)}}
    cross = {"s": {("A", "B"): np.diag([0.9, 0.45, 0.1, 0.02])}}
    w = solve.optimize_genespace(own, cross, ["s"], ["A", "B"], 2)
    assert np.allclose(np.abs(w["A"][:, :2]), np.eye(4)[:, :2], atol=1e-4) and (w["A"][:, 0] * w["B"][:, 0]).sum() > 0


def test_tails():
    assert math.isclose(quantiles.student_t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(quantiles.student_t_two_sided(0.5, 3), 0.6514, rel_tol=1e-3)
    assert quantiles.student_t_two_sided(0.0, 5) == 1.0
    assert math.isclose(quantiles.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)


@pytest.fixture(scope="module")
def edges(spark):
    rows = lambda m, a, b: [(1.0, "s", a, b, i + (0 if a == "A" else 10), j + (0 if b == "A" else 10), float(m[i, j])) for i in range(3) for j in range(3)]
    ddl = "sigma double, slide string, ct_1 string, ct_2 string, i long, j long, k double"
    return spark.createDataFrame(rows(K, "A", "B"), ddl), spark.createDataFrame(rows(RX, "A", "A") + rows(RY, "B", "B"), ddl)


def test_norms_golden(spark, edges):
    from covaria.operators import association

    kernel, own = edges
    sizes = spark.createDataFrame([("s", "A", "B", 3, 3)], "slide string, ct_1 string, ct_2 string, n_1 long, n_2 long")
    centred = K - K.mean(1, keepdims=True) - K.mean(0, keepdims=True) + K.mean()
    assert math.isclose(association.block_norms(kernel, sizes, own).first()["norm"], WHITENED, rel_tol=1e-12)
    assert math.isclose(association.block_norms(kernel, sizes).first()["norm"], np.linalg.norm(centred), rel_tol=1e-12)


def test_bidirectional_golden(spark, edges):
    from covaria.operators import association

    rows = [("s", "A", i, c + 1, float(A[i, c])) for i in range(3) for c in range(2)] + [("s", "B", 10 + i, c + 1, float(B[i, c])) for i in range(3) for c in range(2)]
    scores = spark.createDataFrame(rows, "slide string, cell_type string, cell_id long, cc int, score double")
    for how, want in (("none", BIDIR_NONE), ("row_or_col", BIDIR_ROW_COL)):
        got = {r["cc"]: r["bidir_correlation"] for r in association.bidirectional_correlation(edges[0], scores, how, False).collect()}
        assert np.allclose([got[1], got[2]], want, atol=1e-12)
