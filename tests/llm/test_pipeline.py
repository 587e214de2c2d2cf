"""The pipeline's stages, each on its own input, against what the stage must keep."""

import corpus_pipeline as pipe
from panelsmith.llm import language, toxicity
from panelsmith.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipe.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == columns
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = seen["toxicity"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0.7 * len(before)
    before, after = seen["simhash_near_dedup"]
    texts = {r.text for r in before}
    assert {r.text for r in after} <= texts and len({r.text for r in after}) == len(after)
    before, after = seen["mix_sources"]
    words = sum(len((r.text or "").split()) for r in before)
    assert abs(sum(len((r.text or "").split()) for r in after) / words - 1.5) < 0.1
    packed = pipe.STAGES[-1][1](spark, docs, SF)
    assert packed.where("length <= 0 or offset < 0").count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "one two three", None, None, 9), (1, "one two three", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipe.STAGES:
        for df in (docs, docs.limit(0)):
            stage(spark, df, SF).collect()
    assert language.UNDETERMINED == "und" and toxicity.FEATURES
