"""The corpus pipeline on the smallest tables, stage by stage against plain versions."""

from pathlib import Path

import pandas as pd
import pytest

import corpus_pipeline
from stepspan.llm import decontamination
from stepspan.llm.common import staged, table
from test_operators import brute_lines, brute_near, brute_quality

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    columns, frames = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name.replace(" ", "-"))
        frames.append(docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert set(frames[-1].doc_id) <= set(frames[-2].doc_id)
    start, good, lines, near, clean, mix = frames
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id").quality
    for i, t in zip(start.doc_id, start.text):
        if brute_quality(t)[-1]:
            assert i not in set(good.doc_id)
        elif labels.get(i) == 1:
            assert i in set(good.doc_id)
        elif labels.get(i) == 0:
            assert i not in set(good.doc_id)
    gone = {(o[0][1], o[1]) for o in brute_lines(list(zip(good.doc_id, good.text)))}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in zip(good.doc_id, good.text)}
    assert dict(zip(lines.doc_id, lines.text)) == {i: t for i, t in want.items() if t.split()}
    assert (lines.n_chars == lines.text.str.len()).all()
    components = brute_near(list(zip(lines.doc_id, lines.text)))
    assert set(near.doc_id) == {i for i, c in components.items() if i == c}
    items = [decontamination.normal(t) for t in pd.read_parquet(f"{SMALL}/benchmark.parquet").text]
    leaky = {i for i, t in zip(near.doc_id, near.text) if any(x in decontamination.normal(t) for x in items)}
    assert leaky and not leaky & set(clean.doc_id) and len(clean) >= len(near) - 2 * len(leaky)
    assert list(mix.columns) == [*columns, "copy"] and set(mix.doc_id) <= set(clean.doc_id) and mix.groupby("doc_id").size().max() <= 3
    words = lambda texts: sum(len(t.split()) for t in texts)
    assert abs(words(mix.text) - words(clean.text)) <= 0.25 * words(clean.text)


def test_stages_on_odd_tables(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string"
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1, "k", "s"), (1, text, "en", "a", 1, "k", "s"), (None, text, None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "k", "s"), (4, long, "en", "b", 5, None, None), (5, text + " more", "de", None, 7, "k", "s")]
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that is in there at all"), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table_rows in (rows, []):
        start = spark.createDataFrame(table_rows, kind)
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
            assert docs.columns[:7] == start.columns
            if table_rows and name == "near copies":
                assert sorted(r[0] or -1 for r in docs.collect()) in ([-1, 1, 4], [1, 4])
        assert docs.count() == 0 or table_rows
