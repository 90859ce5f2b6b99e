import numpy as np
import pytest
from pyspark.sql import functions as F

from horosphere.operators import scores as S
from tests.reference_metrics import scores as ref_scores

N, K = 500, 10


def label_sets():
    rng = np.random.default_rng(42)
    y = np.repeat(np.arange(K), N // K)
    noisy = y.copy()
    idx = rng.choice(N, N // 10, replace=False)
    noisy[idx] = rng.integers(0, K, len(idx))
    return {
        "perfect": (y, y.copy()),
        "random": (y, rng.integers(0, K, N)),
        "noisy": (y, noisy),
        "one_class": (np.zeros(20, int), rng.integers(0, 3, 20)),
        "both_one_class": (np.zeros(7, int), np.zeros(7, int)),
        "singletons": (rng.integers(0, 4, 30), np.arange(30)),
    }


def frame(spark, t, p, group=None):
    rows = [(int(a), int(b)) if group is None else (group, int(a), int(b)) for a, b in zip(t, p)]
    cols = "y_true long, y_pred long" if group is None else "g string, y_true long, y_pred long"
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("case", list(label_sets()))
def test_all_scores_match_numpy(spark, case):
    t, p = label_sets()[case]
    got = S.score_table(frame(spark, t, p)).first().asDict()
    exp = ref_scores(t, p)
    for m in S.ALL_SCORES:
        assert got[m] == pytest.approx(exp[m], abs=1e-9), m


def test_grouped_equals_separate(spark):
    sets = label_sets()
    df = None
    for name in ("perfect", "random", "noisy"):
        f = frame(spark, *sets[name], group=name)
        df = f if df is None else df.unionByName(f)
    got = {r["g"]: r for r in S.score_table(df, group=["g"]).collect()}
    for name in ("perfect", "random", "noisy"):
        exp = ref_scores(*sets[name])
        for m in S.ALL_SCORES:
            assert got[name][m] == pytest.approx(exp[m], abs=1e-9)


@pytest.mark.parametrize("avg", ["geometric", "min", "max"])
def test_nmi_averages(spark, avg):
    t, p = label_sets()["noisy"]
    got = S.score_table(frame(spark, t, p), average_method=avg).first()["nmi"]
    assert got == pytest.approx(ref_scores(t, p, avg)["nmi"], abs=1e-12)


def test_relabel_invariance_and_v_equals_nmi(spark):
    t, p = label_sets()["noisy"]
    a = S.score_table(frame(spark, t, p)).first()
    b = S.score_table(frame(spark, t, (p * 7 + 3) % 97)).first()
    for m in S.ALL_SCORES:
        assert a[m] == pytest.approx(b[m], abs=1e-12)
    assert a["v_measure"] == pytest.approx(a["nmi"], abs=1e-12)


def test_emi_window_exact_for_large_clusters(spark):
    # two big clusters: the windowed EMI must equal the full-range sum
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, 6000)
    p = np.where(rng.random(6000) < 0.8, t, 1 - t)
    got = S.score_table(frame(spark, t, p)).first()
    assert got["ami"] == pytest.approx(ref_scores(t, p)["ami"], abs=1e-9)


def test_empty_input(spark):
    df = spark.createDataFrame([], "y_true long, y_pred long")
    r = S.score_table(df).collect()
    # no rows at all: the global aggregate still answers with the edge values
    assert len(r) <= 1


@pytest.mark.parametrize("total, a, b", [(10, 3, 4), (1000, 400, 17), (10**6, 3000, 900_000), (10**9, 5 * 10**8, 10**4),
                                         (10**12, 10**11, 5 * 10**6), (10**12, 3 * 10**11, 7 * 10**11)])
def test_hypergeometric_mass_is_one(spark, total, a, b):
    from pyspark.sql import functions as F
    from horosphere.functions.special import with_ln_hypergeometric
    mean, sd = a * b / total, (b * (a / total) * (1 - a / total) * (1 - b / total)) ** 0.5
    lo, hi = max(0, a + b - total, int(mean - 12 * sd) - 30), min(a, b, int(mean + 12 * sd) + 30)
    x = with_ln_hypergeometric(spark.range(lo, hi + 1, 1, 8), "p", F.col("id"), F.lit(a), F.lit(b), F.lit(total))
    assert x.agg(F.sum(F.exp("p"))).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_hypergeometric_against_exact_fractions(spark):
    from fractions import Fraction
    from math import comb, log
    from pyspark.sql import functions as F
    from horosphere.functions.special import with_ln_hypergeometric
    cases = [(n, a, b, t) for t in (1, 2, 7, 60) for a in range(0, t + 1, 3) for b in range(0, t + 1, 2)
             for n in range(max(0, a + b - t), min(a, b) + 1)]
    df = spark.createDataFrame(cases, "n long, a long, b long, t long")
    for r in with_ln_hypergeometric(df, "p", *map(F.col, "nabt")).collect():
        exact = Fraction(comb(r.a, r.n) * comb(r.t - r.a, r.b - r.n), comb(r.t, r.b))
        assert r.p == pytest.approx(log(exact), abs=1e-12)


def test_expected_mutual_information_is_dealt_to_a_given_number_of_tasks(spark):
    """Its pieces are a few bytes before they are generated, which adaptive execution would put into one task."""
    t, p = [i % 5 for i in range(400)], [i % 7 for i in range(400)]
    df = frame(spark, t, p).withColumn("g", F.lit(1))
    a, b = S.marginal_tables(S.contingency(df, group=["g"]), ["g"])
    emi = S.expected_mutual_info(a, b, a.groupBy("g").agg(F.sum("a").alias("N")), ["g"])
    assert "REPARTITION_BY_NUM" in emi._jdf.queryExecution().executedPlan().toString()
    assert emi.count() == 1


def test_expected_mutual_information_generates_no_row_per_term(spark):
    """code generated for a term is too large for the JVM to compile; terms are numpy arrays inside a task."""
    n = 200_000
    a = spark.createDataFrame([(1, 0, n // 2), (1, 1, n // 2), (2, 0, 3), (2, 1, 2), (None, 0, 1)], "g long, y_true long, a long")
    b = spark.createDataFrame([(1, 0, n // 4), (1, 1, n - n // 4), (2, 0, 4), (2, 1, 1), (None, 0, 1)], "g long, y_pred long, b long")
    emi = S.expected_mutual_info(a, b, a.groupBy("g").agg(F.sum("a").alias("N")), ["g"])
    plan = emi._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate ") == 1      # of the pieces, not of their terms
    got = {r["g"]: r["emi"] for r in emi.collect()}
    assert got.keys() == {1, 2}
    from math import comb, log
    want = sum(k / 5 * log(5 * k / (x * y)) * comb(x, k) * comb(5 - x, y - k) / comb(5, y)
               for x in (3, 2) for y in (4, 1) for k in range(max(1, x + y - 5), min(x, y) + 1))
    assert got[2] == pytest.approx(want, rel=1e-12)
    assert got[1] == pytest.approx(1 / (2 * n), rel=1e-4)            # (rows - 1) (columns - 1) / 2n


def test_ln_hypergeometric_on_arrays():
    from fractions import Fraction
    from math import comb, log
    from horosphere.functions.special import ln_hypergeometric
    cases = [(n, a, b, t) for t in (1, 2, 7, 60) for a in range(0, t + 1, 3) for b in range(0, t + 1, 2)
             for n in range(max(0, a + b - t), min(a, b) + 1)]
    got = ln_hypergeometric(*np.array(cases, dtype=float).T)
    want = [log(Fraction(comb(a, n) * comb(t - a, b - n), comb(t, b))) for n, a, b, t in cases]
    assert got == pytest.approx(want, abs=1e-12)
    a, b, t = 10 ** 9, 2 * 10 ** 9, 10 ** 10                         # the mass about the mean adds up to 1
    n = np.arange(200_000_000 - 900_000, 200_000_000 + 900_000, dtype=float)
    one = [np.array([float(x)]) for x in (a, b, t)]
    assert np.exp(ln_hypergeometric(n, *one, np.zeros(len(n), int))).sum() == pytest.approx(1, abs=1e-9)
