import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import common

TEXT = st.text(st.sampled_from(list("abAB \t\n\x0b\x0c\r")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6), st.sampled_from([3, 7, 1 << 18]))
def test_spans_are_the_words(texts, step):
    before, common.Spans.STEP = common.Spans.STEP, step
    try:
        spans = common.Spans(pa.array(texts, pa.string()))
        lists = [(t or "").encode().split() for t in texts]
        words = [w for x in lists for w in x]
        data = spans.data.tobytes()
        assert [data[a:b] for a, b in zip(spans.begin, spans.end)] == words
        assert np.diff(spans.starts).tolist() == [len(x) for x in lists]
        plain, lower = spans.hashes().tolist(), spans.hashes(lower=True).tolist()
        assert len(set(zip(words, plain))) == len(set(words)) == len(set(plain))
        folded = [w.lower() for w in words]
        assert len(set(zip(folded, lower))) == len(set(folded)) == len(set(lower))
    finally:
        common.Spans.STEP = before


def test_a_word_has_one_hash_wherever_it_stands():
    long = "x" * 300_000
    one = common.Spans(pa.array([f"{long} b", f"b a {long}"])).hashes()
    assert one[0] == one[4] and one[1] == one[2] and len(set(one.tolist())) == 3


def test_old_folders_are_swept(spark):
    scratch = common.Scratch(spark, "swept")
    scratch.save(spark.range(3), "t")
    assert common.Scratch.sweep(spark, 1) == 0 and spark.read.parquet(f"{scratch.folder}/t").count() == 3
    assert common.Scratch.sweep(spark, -1) >= 1


def test_settings_are_lowered_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10")
        common.tune(spark)
        assert spark.conf.get(name) == "10"
        spark.conf.set(name, "50000")
        common.tune(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
