import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.functions import quality, texts
from faultline.operators import logs

PAIRS = [
    (1, "the cat sat on the mat today", "the cat sat on the mat"),
    (2, "a b c d e", "v w x y z"),
    (3, "", "a b"),
    (4, "Same words in the same order here", "same words in the same order here"),
    (5, "a  b\na c a b d", "a b a b d c a"),
    (6, "one two", "one two three"),
]


def bleu(h, r):
    h, r = h.lower().split(), r.lower().split()
    if not h:
        return 0.0
    s = 0.0
    for n in range(1, 5):
        a = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hit = sum(min(c, b[g]) for g, c in a.items())
        if not hit:
            return 0.0
        s += math.log(hit / sum(a.values()))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(s / 4)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id int, hypothesis string, reference string")


def test_bleu(pairs):
    got = {r.pair_id: r.bleu4 for r in quality.bleu4(pairs).collect()}
    assert got == pytest.approx({i: bleu(h, r) for i, h, r in PAIRS})


def test_rouge(pairs):
    got = {r.pair_id: (r.lcs, r.rouge_l) for r in quality.rouge_l(pairs).collect()}
    for i, h, r in PAIRS:
        a, b = h.lower().split(), r.lower().split()
        n = lcs(a, b)
        f = (1 + 1.44) * (n / len(b)) * (n / len(a)) / (n / len(b) + 1.44 * n / len(a)) if a and n else 0.0
        assert got[i] == (n, pytest.approx(f))


def test_embedded_json_and_cleaning(spark):
    df = spark.createDataFrame(
        [('{"k": 1}',), ('say\n```json\n{"k": 2}\n```',), ('so {"k": 3} ok',), ("none",)], "t string"
    )
    got = [r[0] for r in df.select(F.from_json(texts.embedded_json(F.col("t")), "k int")["k"]).collect()]
    assert got == [1, 2, 3, None]
    df = spark.createDataFrame([("Okay, so\n\n the disk is full\nTherefore x",)], "t string")
    assert df.select(texts.kept_lines(F.col("t"))).collect()[0][0] == ["the disk is full"]


def test_records_cases_and_fields(spark):
    lines = [
        ("f", 0, '[EVAL] {"type":"localization","predictions":["lost"]}'),  # before the first opener
        ("f", 1, '[EVAL] {"type":"task_parsed","date":"0701","time":"11-16"}'),
        ("f", 2, "x [Phase 2] completed in 4.5s"),
        ("f", 3, '[EVAL] {"type":"localization","predictions":["a","b"]}'),
        ("f", 4, '[EVAL] {"type":"localization","predictions":["c"]}'),
        ("f", 5, '[EVAL] {"type":"broken'),
        ("f", 6, '[EVAL] {"type":"task_parsed","date":"0701","time":"12-00"}'),
        ("g", 7, "no case here"),
    ]
    parsed = logs.with_records(spark.createDataFrame(lines, "file string, pos long, line string"))
    cases = logs.segment_cases(parsed, F.col("record.type") == "task_parsed")
    assert sorted((r.pos, r.case_pos) for r in cases.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]
    top = F.get("record.predictions", F.lit(0))
    got = {r.case_pos: r for r in logs.first_and_last(cases, ["file", "case_pos"], "pos", {"first": top}, {"last": top}).collect()}
    assert (got[1]["first"], got[1]["last"], got[6]["first"]) == ("a", "c", None)


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(1, i, "x" * 40) for i in range(10)], "incident_id int, i int, m string")
    assert logs.within_budget(df, ["incident_id"], ["i"], "m", 100).count() == 3
    assert logs.within_budget(df, ["incident_id"], ["i"], "m", 100, over_by_one=False).count() == 2


DOCUMENTS = [
    {"vote": "X", "n": 12, "ranking": ["a", 'b"c', "]"], "o": {"p": True, "q": None}},
    {"a": "", "b": [], "c": {}, "d": [[1, 2], [3]], "e": -1.5e3},
    {"text": "tab\t and \\\\ and {[,:]}", "u": "é😀", "k\"ey": "v"},
    {},
    {"one": 1},
    {"nested": {"x": {"y": {"z": ["deep", {"w": False}]}}}, "after": "end"},
    {"spaces  in key": " , ", "m": [True, False, None]},
    {"long": "word " * 200, "then": 5},
    {"numbers": [0, 10, 100], "s": "}"},
    {"quote": '\\\\"', "last": "x"},
]


def holds(part, whole):
    """part is whole, or whole cut inside its last container."""
    if isinstance(part, dict) and isinstance(whole, dict):
        keys = list(whole)[: len(part)]
        return list(part) == keys and all(part[k] == whole[k] for k in keys[:-1]) and all(holds(part[k], whole[k]) for k in keys[-1:])
    if isinstance(part, list) and isinstance(whole, list):
        return part[:-1] == whole[: max(0, len(part) - 1)] and all(holds(a, b) for a, b in zip(part[-1:], whole[len(part) - 1 :]))
    return part == whole


def test_every_prefix_of_a_document_gives_its_whole_pairs(spark):
    from faultline.functions.texts import repaired_json

    rows = []
    for d, doc in enumerate(DOCUMENTS):
        for text in (json.dumps(doc), json.dumps(doc, ensure_ascii=False, indent=1)):
            rows += [(d, i, len(text), text[:i]) for i in range(len(text) + 1)]
    df = spark.createDataFrame(rows, "d int, i int, n int, text string").repartition(4)
    for r in df.withColumn("fixed", repaired_json(F.col("text"))).collect():
        if r.fixed is None:
            assert "{" not in r.text
            continue
        got = json.loads(r.fixed)
        assert holds(got, DOCUMENTS[r.d]), r
        if r.i == r.n:
            assert got == DOCUMENTS[r.d]
        # a pair whose value a comma follows at the top is whole
        whole = [k for j, k in enumerate(DOCUMENTS[r.d]) if len(got) > j + 1]
        assert all(got[k] == DOCUMENTS[r.d][k] for k in whole)
    odd = spark.createDataFrame([(None,), ("",), ("no json",), ('{"a": "b"} tail "',)], "text string")
    assert [r[0] for r in odd.select(repaired_json(F.col("text"))).collect()] == [None, None, None, '{"a": "b"}']
