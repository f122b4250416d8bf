import base64
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from lodestrand.llm import quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_equal_brute_force(spark, odd):
    more = [(100, "a b c\na b c\n \n\na b c x y #|é", None), (101, "z " * 80, None), (102, "un deux trois " * 3 + prose(1, 100), None)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id long, text string"))
    rows = docs.collect()
    got = Counter(tuple(r)[:7] for r in quality_rules.compression_bands(docs).collect())
    assert got == Counter((r["doc_id"], *counts(r["text"])) for r in rows)


def test_bands(spark):
    rng = np.random.default_rng(0)
    noise = " ".join(base64.b64encode(rng.bytes(15)).decode() for _ in range(800))
    paragraph = prose(1, 60)
    texts = [prose(2, 400, [prose(i, 1) + str(i * 7919 % 997) for i in range(300)]), noise, "\n".join(f"{paragraph} {i}" for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.compression_bands(docs, most_repeat=101.0).collect()}
    assert got[0]["kept"] and not got[1]["kept"] and not got[2]["kept"]
    assert got[1]["ratio"] > 0.6 and got[2]["ratio"] < 0.1


def drawn(rng, n, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    """Words of random letters, n bytes."""
    return " ".join("".join(rng.choice(list(letters), rng.integers(3, 10))) for _ in range(n // 3)).encode()[:n]


@pytest.mark.parametrize("least, most", [(b[0], c[0] - 1) for b, c in zip(quality_rules.BANDS[1:], [*quality_rules.BANDS[2:], (60001,)])])
def test_random_words_fail_in_every_band(least, most):
    rng, judge = np.random.default_rng(least), quality_rules.Compression()
    for n in (least, most):
        for _ in range(5):
            assert not judge.verdict(drawn(rng, n), 0.3)[0]


def test_the_last_chunk_counts_by_its_bytes():
    rng, judge = np.random.default_rng(1), quality_rules.Compression()
    clean = prose(2, 4000, [prose(i, 1) + str(i * 7919 % 997) for i in range(300)]).encode()
    assert judge.verdict(clean[:7000], 0.3)[0] and judge.verdict(clean[:7000], 0.3)[2:] == (2, 0)
    # 3,000 random bytes of 7,096 are too many, 200 of 4,296 are not.
    assert not judge.verdict(clean[:4096] + drawn(rng, 3000), 0.3)[0]
    passed, _, chunks, bad = judge.verdict(clean[:4096] + drawn(rng, 200), 0.3)
    assert (passed, chunks, bad) == (True, 2, 1)


def test_no_rows(none, spark):
    assert quality_rules.compression_bands(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score(none, labels).count() == 0


def test_rules_learn_what_separates(spark):
    rows = [(i, prose(i, 80) if i % 3 else " | ".join(prose(i, 80).split()), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_model.score(docs, labels).collect()}
    assert all(got[i]["predicted"] == q and 0 <= got[i]["score"] <= 1 for i, _, q in rows)


def test_the_column_is_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5) | (x[:, 5] > 1)).astype(float)
    model = quality_model.RuleModel.fit(x, y)
    assert 0 < len(model.rules) < 200 and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([(*map(float, r),) for r in x[:50]], ", ".join(f"{s} double" for s in quality_model.STATISTICS))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert got == pytest.approx(model.score(x[:50]).tolist())


def test_odd_rows_and_odd_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    got = quality_model.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    unlabelled = quality_model.score(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality_model.measure(pa.array(["", None])).sum() == 0


def verdict(text, bad_share=0.3):
    """The verdict of the bands, from the ratios of zstandard alone."""
    import zstandard

    data = text.encode()

    def outside(part):
        low, high = [(a, b) for n, a, b in quality_rules.BANDS if len(part) >= n][-1]
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part) if part else 1.0
        return not low <= ratio <= high

    parts = [data[i : i + quality_rules.CHUNK] for i in range(0, len(data), quality_rules.CHUNK)] if len(data) > quality_rules.CHUNK else []
    return not outside(data) and sum(len(x) for x in parts if outside(x)) <= bad_share * len(data)


def test_the_verdict_on_the_tables_and_on_planted_texts(spark):
    """Every verdict equals the brute force; the bands alone reject planted texts and labelled bad ones, and no good one."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    clean = [r["text"] for r in docs.collect() if r["text"] and len(r["text"]) > 6000][:20]
    planted = []
    for i, text in enumerate(clean):
        words = text.split()
        planted += [(-1 - 4 * i, " | ".join(w[:3] for w in words), False), (-2 - 4 * i, drawn(rng, 3000).decode(), False), (-3 - 4 * i, text[:2000] + "\n" + drawn(rng, 4000).decode(), False)]
    both = docs.union(spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    got = {r["doc_id"]: r for r in quality_rules.compression_bands(both).collect()}
    assert all(r["kept"] == (not r["base_failed"] and verdict(texts[i])) for i, r in got.items())
    assert not any(got[i]["kept"] for i, _, _ in planted)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    by_bands = [i for i, r in got.items() if i >= 0 and not r["base_failed"] and not r["kept"]]
    assert len(by_bands) >= 10 and all(quality.get(i) != 1 for i in by_bands)


def plain_statistics(text):
    """The statistics of a text, one by one."""
    text = text or ""
    w, n = WORD.findall(text), max(len(text), 1)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    white = sum(c in " \t\n\v\f\r" for c in text)
    share = lambda chars: sum(c in chars for c in text) / n
    capital = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text) / n
    k, m = max(len(w), 1), max(len(lines), 1)
    return [
        len(w), len(text), (len(text) - white) / k, sum(len(x) >= 12 for x in w) / k, sum(len(x) <= 3 for x in w) / k, len(set(w)) / k, len(covered) / k,
        len(lines), len(w) / m, (len(lines) - len(set(lines))) / m, share("#*$%&<>"), capital, share("0123456789"), share(".,;:"), share("!?"), share("|"),
        share("()[]{}@=+_~^/\\\"'`-"), white / n,
    ]


def test_statistics_equal_brute_force(odd):
    texts = [r["text"] for r in odd.select("text").collect()] + ["ÀÉ×Þ a.B, c! (x) [y] 12 #|\nz\n\nz", "　x\x85y", "a b c a b c"]
    got = quality_model.measure(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_lasso_meets_the_conditions_of_its_minimum():
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1])))).astype(float)
    intercept, w = quality_model.lasso(r, y, 0.01, steps=3000)
    slope = r.T @ (1 / (1 + np.exp(-(intercept + r @ w))) - y) / len(y)
    assert np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(slope[w == 0]) <= 0.01 + 1e-4).all()
    assert (w == 0).any() and w[0] > 0 > w[1]


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(1, "one text " * 30)] * 3000 + [(i, prose(i, 60)) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    measured = quality_model.statistics(docs)
    seen = []
    real = quality_model.RuleModel.fit
    try:
        quality_model.RuleModel.fit = classmethod(lambda cls, x, y, **how: seen.append(len(y)) or real(x, y, **how))
        quality_model.fit(measured, labels, fold=-1)
    finally:
        quality_model.RuleModel.fit = real
    assert seen == [59]
