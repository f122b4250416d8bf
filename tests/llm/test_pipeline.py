import pytest

import corpus_pipeline
from lodestrand.llm import langid, queries


def test_ten_queries_and_five_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]


def test_stages_take_effect_on_odd_rows(spark, odd):
    docs, seen = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        docs = seen[name] = spark.createDataFrame(made.collect(), made.schema)
    ids = {name: sorted(r["doc_id"] for r in df.filter("doc_id is not null").collect()) for name, df in seen.items()}
    scored = langid.identify(odd, langid.fit(odd)).filter("doc_id is not null and lang_pred <> 'und' and score >= 0.5")
    assert ids["language_id"] == sorted(r["doc_id"] for r in scored.collect())
    assert {1, 2, 3, 7, 9} <= set(ids["language_id"]) and not {4, 5, 6, 8} & set(ids["language_id"])
    assert ids["near_dedup"] == [i for i in sorted(set(ids["language_id"])) if i not in (2, 3)]
    left = {r["doc_id"]: r for r in seen["substring_dedup"].collect()}
    assert set(left) == {None, *ids["near_dedup"]} and all(r["n_chars"] == len(r["text"]) for r in left.values())
    assert left[1]["text"] != odd.filter("doc_id = 1").first()["text"]
    for name in ("language_id", "near_dedup", "substring_dedup", "mix_sources"):
        assert seen[name].columns == corpus_pipeline.COLUMNS
    assert seen["pack_sequences"].count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_no_rows(spark, none, k):
    assert corpus_pipeline.STAGES[k][1](spark, none, "").count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    from conftest import prose

    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(1, a), (1, b), (2, b), (None, b), (None, c), (None, c), (3, ""), (3, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (3, ""), (4, "")], key=str)
