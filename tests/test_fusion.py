import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation as ev
from faultline.operators import fusion


def ranked(spark, names, col="service"):
    return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], f"incident_id long, {col} string, rank int")


@pytest.fixture(scope="module")
def votes(spark):
    gammas = spark.createDataFrame([(1, "a_x", 0.2), (1, "a_y", 0.2), (1, "b_x", 1.0), (1, "c_x", 0.1)], "incident_id long, metric string, gamma double")
    return fusion.evidence(
        ranked(spark, ["a", "b", "c"]), ranked(spark, ["b", "d"]), gammas, ranked(spark, ["b_x", "a_x"], "metric")
    )


def run(spark, votes, scenario, **params):
    kinds = spark.createDataFrame([(1, scenario)], "incident_id long, scenario string")
    out = fusion.fuse(fusion.with_params(votes, [params]), kinds)
    return {r.service: r for r in out.collect()}


def test_scores_by_hand(spark, votes):
    got = run(spark, votes, fusion.CONSISTENT)
    # a: anchor 1, g 0.4 of the best (not strong), dual 1/2; two sources agree
    assert got["a"].score == pytest.approx((1 + 0.3 * 0.4 + 0.3 / 2) * 1.4)
    # b: anchor 1/2, causal strong, trace 1, dual 1; four sources agree
    assert got["b"].score == pytest.approx((0.5 + 0.3 + 0.4 + 0.3) * (1 + 0.4 * 3))
    assert got["d"].score == pytest.approx(0.4 / 2)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == ["b", "a", "c", "d"]


def test_anchor_protection(spark, votes):
    got = run(spark, votes, fusion.MULTI_ONLY)
    assert got["a"]["rank"] == 1 and got["a"].rank_before == 2 and got["b"]["rank"] == 2
    off = run(spark, votes, fusion.MULTI_ONLY, protect=False)
    assert off["b"]["rank"] == 1


def test_zero_weights_return_the_anchor(spark, votes):
    got = run(spark, votes, fusion.CONSISTENT, w_causal=0.0, w_trace=0.0, w_dual=0.0, alpha=0.0)
    top = sorted((r["rank"], s) for s, r in got.items())[:3]
    assert [s for _, s in top] == ["a", "b", "c"]


def test_causal_anchor(spark, votes):
    got = run(spark, votes, fusion.CONSISTENT, causal_anchor=True)
    assert got["c"].score == pytest.approx(1 / 3 + 0.4 / 3)


def test_scenarios(spark):
    df = spark.createDataFrame(
        [(m, u, ml, ul) for m, u, ml, ul in [
            (True, False, ["a"], ["b"]), (False, True, ["a"], ["b"]), (True, True, ["a", "b"], ["b", "a"]),
            (True, True, ["a", "b"], ["b", "c"]), (False, False, [], []),
        ]],
        "m boolean, u boolean, ml array<string>, ul array<string>",
    )
    got = [r[0] for r in df.select(fusion.scenario(*[F.col(c) for c in ("m", "u", "ml", "ul")])).collect()]
    assert got == [fusion.MULTI_ONLY, fusion.UNI_ONLY, fusion.CONSISTENT, fusion.DIFFERENT, fusion.CONSISTENT]


def test_root_text_round_trip(spark):
    df = spark.createDataFrame([(["a_x", "b.y", "c"],)], "n array<string>")
    text = df.select(fusion.root_text(F.col("n")).alias("t"))
    assert text.collect()[0][0] == "Top 5 root cause metrics is:(1)a_x,(2)b.y,(3)c."
    assert text.select(fusion.parse_root_text(F.col("t"))).collect()[0][0] == ["a_x", "b.y", "c"]


def test_signal_quality(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([1.0],), ([2.0, 2.0],)], "s array<double>")
    assert [r[0] for r in df.select(fusion.signal_quality(F.col("s"))).collect()] == [0.5, 0.5, 0.0]


def test_truth_candidates(spark):
    df = spark.createDataFrame([("cart-0", "pod"), ("cart2", "service"), ("node-6", "node")], "e string, l string")
    got = [r[0] for r in df.select(ev.truth_candidates(F.col("e"), F.col("l"))).collect()]
    assert got == [["cart-0", "cart"], ["cart2", "cart"], ["node-6"]]


def test_accuracy_grows_with_k(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, 5), (4, 99)], "incident_id long, truth_rank long")
    r = ev.accuracy(ranks).collect()[0]
    assert (r.n, r.ac1, r.ac3, r.ac5) == (4, 0.25, 0.5, 0.75)
    h = ev.hit_rates(ranks).collect()[0]
    assert h.mrr3 == pytest.approx((1 + 1 / 3) / 4)


def test_precision_and_rank_accuracy(spark):
    preds = ranked(spark, ["a", "b", "c", "d"], "name")
    truths = spark.createDataFrame([(1, "b"), (1, "x")], "incident_id long, name string")
    p = ev.precision_at(preds, truths).collect()[0]
    assert [p.pr1, p.pr2, p.pr5] == [0.0, 0.5, 0.5]
    assert ev.rank_accuracy(preds, truths).collect()[0].acc == pytest.approx((4 - 0) / 4 / 2)


def test_auc_against_pairs(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(20), rnd.randrange(2)) for _ in range(200)]
    pos, neg = [s for s, l in data if l], [s for s, l in data if not l]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = ev.auc(spark.createDataFrame(data, "score long, label int")).collect()[0]
    assert got.auc == pytest.approx(wins / len(pos) / len(neg))


def test_vote_winners(spark):
    data = [(1, v) for v in "aab"] + [(2, v) for v in "ab"] + [(3, v) for v in "abc"]
    got = {r.case_id: (r.is_tie, r.winner) for r in ev.vote_winners(spark.createDataFrame(data, "case_id int, vote string")).collect()}
    assert got == {1: (False, "a"), 2: (True, None), 3: (True, None)}


def test_bootstrap_brackets_the_mean(spark):
    cases = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(100)], "case_id long, delta int")
    r = ev.paired_bootstrap(cases, n_boot=500).collect()[0]
    assert r.mean_delta == 0.25 and (r.improved, r.regressed) == (25, 0)
    assert r.low < 0.25 < r.high and r.high - r.low < 0.25 and r.p_no_gain == 0.0


def test_temperature_fit(spark):
    rnd = random.Random(5)
    data = []
    for _ in range(60):
        logits = [rnd.gauss(0, 1) for _ in range(4)]
        data.append((logits, max(range(4), key=lambda i: logits[i]) if rnd.random() < 0.7 else rnd.randrange(4)))
    got = ev.fit_temperature(spark.createDataFrame(data, "logits array<double>, truth int")).collect()[0]

    def nll(t):
        total = 0.0
        for x, y in data:
            e = [math.exp((v - max(x)) / t) for v in x]
            total -= math.log(max(e[y] / sum(e), 1e-12))
        return total / len(data)

    assert got.nll == pytest.approx(nll(got.temperature))
    assert got.nll <= min(nll(t) for t in ev.TEMPERATURES) + 1e-9
