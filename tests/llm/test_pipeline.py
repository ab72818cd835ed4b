import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    from test_operators import prose

    folder = str(tmp_path_factory.mktemp("corpus"))
    item = prose(900, 40)
    texts = [prose(i, 120) for i in range(60)]
    for i in range(0, 20):
        texts[i] += " uglyone uglytwo"
    texts[30] = texts[31] + " tail"
    words = texts[44].split()
    texts[45] = "\n".join(" ".join(words[k : k + 30]) for k in range(0, 120, 30))
    texts[40] += " " + item
    texts[41] += "\n" + prose(901, 60)
    texts[42] += "\n" + prose(901, 60)
    texts += [None, "", "the uglyone uglytwo"]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out[name] = {r.doc_id: r for r in docs.collect()}
    return texts, out


def test_each_stage_takes_effect(kept):
    texts, out = kept
    assert set(out["toxicity"]) == set(range(20, 62))
    assert out["line_dedup"][42].text == texts[42].split("\n")[0] and out["line_dedup"][41].text == texts[41]
    assert out["line_dedup"][42].n_chars == len(texts[42].split("\n")[0])
    assert set(out["toxicity"]) - set(out["line_dedup"]) == {31}  # its only line is a near copy of that of 30
    assert set(out["line_dedup"]) - set(out["near_duplicates"]) == {45}  # the words of 44 in other lines
    assert set(out["near_duplicates"]) - set(out["decontamination"]) == {40}
    assert set(out["encoding"]) == set(out["decontamination"])
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        assert out[name][20].asDict().keys() == set(corpus_pipeline.COLUMNS)
