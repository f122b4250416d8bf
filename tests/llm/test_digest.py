import hashlib

from lodestrand.llm import digest


def test_canonical_forms():
    assert digest.canonical("ＡＢ  c\n") == digest.canonical("ab c") == b"ab c"
    assert digest.canonical("Straße") == digest.canonical("STRASSE")
    assert digest.canonical("é") == digest.canonical("é")
    assert digest.canonical("ab c") != digest.canonical("abc")


def test_equals_brute_force(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    got = digest.compare_with_next(odd).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["n_chars"]) for r in got if r["doc_id"] is not None) == sorted((True, i, len(t)) for i, t in rows if i is not None)
    by_id = {r["doc_id"]: r for r in got}
    single = {i: t for i, t in rows if i != 2}
    order = [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = single | {2: dict(rows)[2]}
    for at, key in enumerate(order):
        if key == 2:
            continue
        after = texts[order[(at + 1) % len(order)]]
        own = texts[key]
        n = len(own) // 4
        changed = own[: len(own) - n] + after[:n]
        r = by_id[key]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == float(digest.canonical(own) == digest.canonical(changed))
        assert r["near_next"] == float(digest.canonical(own) == digest.canonical(after))
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[3]["fingerprint"] and by_id[1]["near_next"] == 1.0


def test_groups(odd):
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in digest.exact_groups(odd).collect()}
    assert got[1] == got[2] == got[3] == (1, 4)
    assert got[4] == got[5] == got[6] == (4, 3)
    assert got[9] == (9, 1)
    assert digest.fingerprints(odd).count() == odd.count()


def test_no_rows(none):
    assert digest.compare_with_next(none).count() == 0 and digest.exact_groups(none).count() == 0


def test_one_row_is_its_own_next(spark):
    row = digest.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abca").hexdigest() and row["near_next"] == 1.0


def test_bytes_tell_texts_with_one_digest_apart(spark):
    texts = ["a", "A ", "b", "b", None, "", "c", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in digest.exact_groups(docs, hashed=lambda canon: "same").collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (2, 2), 3: (2, 2), 4: (4, 2), 5: (4, 2), 6: (6, 1), 7: (0, 3)}


def test_groups_beside_the_comparison(odd):
    got = digest.with_groups(odd).collect()
    assert len(got) == odd.count()
    groups = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in got}
    assert groups[1] == groups[2] == groups[3] == (1, 4) and groups[9] == (9, 1) and groups[None] == (None, 1)


def test_query_equals_sql(spark):
    """Lengths, edited texts and groups of ASCII texts, by SQL."""
    import os

    import duckdb
    import pytest

    from lodestrand.llm import queries

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{folder}/documents.parquet'),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS b, length(t) // 4 AS k FROM d)
        SELECT doc_id, length(t), sha256(left(t, (length(t) - k)::BIGINT) || left(b, k::BIGINT)) FROM n""").fetchall()
    got = queries.QUERIES["op6_exact_fingerprint"](spark, folder).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
