import math

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import rows
from faultline.functions import projections as pj
from faultline.operators import detect, eventtext, learn


def test_trace_event_reaches_both_ends(spark):
    df = spark.createDataFrame([("cart", "db"), ("cart", "cart")], "src string, dst string")
    got = rows(eventtext.to_both_ends(df, ["cart", "db", "web"]), "src", "dst", "node")
    assert got == [("cart", "cart", "cart"), ("cart", "db", "cart"), ("cart", "db", "db")]


def test_first_owner_follows_list_order(spark):
    df = spark.createDataFrame([("cart2.csv",), ("zzz.csv",)], "f string")
    assert [r[0] for r in df.select(eventtext.first_owner(F.col("f"), ["cart", "cart2"])).collect()] == ["cart", None]


def test_mean_vectors_and_scaling(spark):
    df = spark.createDataFrame([("a", [1.0, 4.0]), ("a", [3.0, 0.0]), ("b", [5.0, 5.0])], "node string, vector array<double>")
    got = {r.node: (r.vector, r.n) for r in eventtext.mean_vectors(df, ["node"]).collect()}
    assert got == {"a": ([2.0, 2.0], 2), "b": ([5.0, 5.0], 1)}
    one = spark.createDataFrame([([1.0], 1), ([1.0], 1000)], "v array<double>, n long")
    scaled = [r[0][0] for r in one.select(eventtext.intensity(F.col("v"), F.col("n"))).collect()]
    assert scaled == [pytest.approx(math.log(2)), 3.0]


def test_hash_vectors_depend_on_text_only(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (3, "z")], "node int, event string")
    got = {r.node: r.vector for r in eventtext.hash_vectors(df, ["node"], 8).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] != pytest.approx(got[3])


def test_vocabulary_gate(spark):
    events = spark.createDataFrame([("log", "a&1"), ("log", "b&2"), ("metric", "a&up")], "modality string, event string")
    vocab = spark.createDataFrame([("log", "a"), ("log", "1"), ("metric", "a")], "modality string, word string")
    got = {r.modality: (r.n_words, r.coverage, r.passes) for r in eventtext.vocabulary_coverage(events, vocab).collect()}
    assert got == {"log": (4, 0.5, True), "metric": (2, 0.5, False)}


def test_training_rows_skip_unknown_roots(spark):
    labels = spark.createDataFrame(
        [(1, "a", "cpu", "train"), (2, "zz", "cpu", "train"), (3, "a", "normal", "test"), (4, "a", "net", "test")],
        "index int, instance string, anomaly_type string, data_type string",
    )
    nodes = spark.createDataFrame([(i, n) for i in (1, 2, 3, 4) for n in "ab"], "index int, node string")
    vectors = spark.createDataFrame(
        [(i, n, m, [1.0]) for i in (1, 2, 3, 4) for n in "ab" for m in ("metric", "trace", "log")],
        "index int, node string, modality string, vector array<double>",
    )
    got = rows(eventtext.training_rows(labels, nodes, vectors), "index", "node", "is_root", "type_no", "split")
    assert got == [
        (1, "a", 1, 1, "train"), (1, "b", 0, 1, "train"), (3, "a", 1, 0, "test"), (3, "b", 0, 0, "test"),
        (4, "a", 1, 2, "test"), (4, "b", 0, 2, "test"),
    ]


def test_entity_map(spark):
    df = spark.createDataFrame([("cart-1", "pod"), ("xx-1", "pod"), ("cart", "service"), ("n1", "node")], "e string, l string")
    got = [r[0] for r in df.select(pj.entity_to_service(F.col("e"), F.col("l"), ["cart-0", "cart-1"])).collect()]
    assert got == ["cart-1", None, "cart-0", None]


def test_folds_are_balanced_per_label(spark):
    df = spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(100)], "incident_id long, label double")
    counts = learn.stratified_folds(df, "label", "incident_id").groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_reduced_vectors_are_padded_and_scaled(spark):
    df = spark.range(50).select("id", array_to_vector(F.array(F.rand(1), F.rand(2), F.rand(3))).alias("features"))
    df = spark.createDataFrame(df.collect(), df.schema)
    out = learn.reduced(df, df, 2, pad=8)
    first = [r.embedding for r in out.collect()]
    assert all(len(v) == 8 and v[2:] == [0.0] * 6 for v in first)
    assert sum(v[0] for v in first) / 50 == pytest.approx(0, abs=1e-9)


def test_pattern_forest_learns_its_classes(spark):
    made = learn.synthetic_patterns(spark, per_class=40)
    train = learn.window_vectors(made, ["id", "class_no"]).persist()
    model = learn.forest(train, "class_no", trees=15, depth=8)
    hit = model.transform(train).select(F.avg((F.col("prediction") == F.col("class_no")).cast("double"))).collect()[0][0]
    assert hit > 0.8


def test_reconstruction_errors_find_the_odd_metric(spark):
    data = [(1, k, [float(k % 5), float(k % 5), 0.1 * (k % 2) if k != 28 else 9.0]) for k in range(30)]
    rows_ = spark.createDataFrame(data, "incident_id long, k long, z array<double>")
    err = learn.reconstruction_errors(rows_, F.col("k") < 15, ["a", "b", "c"], 2).filter("k = 28")
    assert {r.metric for r in err.collect()} == {"a", "b", "c"}
    steps = detect.step_scores(learn.reconstruction_errors(rows_, F.col("k") < 15, ["a", "b", "c"], 1))
    assert 28 in {r.k for r in steps.filter("anomalous").collect()}


def test_class_probability_sum(spark):
    df = spark.createDataFrame([(1, [0.7, 0.3]), (1, [0.6, 0.4]), (2, [0.1, 0.9])], "incident_id long, p array<double>")
    scored = df.select("incident_id", array_to_vector("p").alias("probability"))
    assert scored.select(vector_to_array("probability")).count() == 3
    got = rows(learn.class_probability_sum(scored, ["a", "b"], ["incident_id"]), "incident_id", "service", "rank")
    assert got == [(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 1)]
