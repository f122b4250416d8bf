import pyarrow as pa
import pytest

from lodestrand.llm import langid

WORDS = {"en": "the and of house water going never thing", "de": "der und das haus wasser gehen niemals ding", "fr": "le et de maison eau aller jamais chose"}


def test_accuracy_on_the_fold_that_was_held_out(spark):
    from conftest import prose

    rows = [(i, prose(i, 30, WORDS[lang].split()), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs), keep=("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.9 <= r["score"] <= 1 for r in got)


def test_labels_of_the_fold_are_not_read(spark):
    import zlib

    rows = [(i, "wort" if zlib.crc32(str(i).encode()) % 3 == 1 else "word word", "de" if zlib.crc32(str(i).encode()) % 3 == 1 else "en") for i in range(60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en"]


def test_every_language_is_learned(spark):
    rows = [(i * 10 + j, f"{chr(97 + i // 26)}{chr(97 + i % 26)}wort " * 30, f"l{i:03}") for i in range(230) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, fold=-1).languages == [f"l{i:03}" for i in range(230)]


def test_languages_of_a_few_long_documents(spark):
    from conftest import prose

    rows = [(i, prose(i, 12000), f"l{i // 4}") for i in range(80)] + [(900, "", "l0"), (901, "12 34", "digits")]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    known = set(" ".join(t for _, t, _ in rows).split())
    for chars, most in ((30_000, 2), (10**9, 1)):
        drawn = {}
        for r in langid.sample(docs, chars).collect():
            drawn.setdefault(r["lang"], []).append(r["text"])
            assert set(r["text"].split()) - {"12", "34"} <= known
        assert set(drawn) >= {f"l{i}" for i in range(20)}
        assert all(0 < sum(map(len, t)) <= most * chars for t in drawn.values() if any(t) and t != ["12 34"])
    # Stretches of a text that is taken whole hold each of its words once.
    one = docs.filter("key = 5")
    n = len(rows[5][1])
    parts = langid.sample(one, n).collect()
    assert len(parts) > 1 and sorted(" ".join(r["text"] for r in parts).split()) == sorted(rows[5][1].split())
    assert len(langid.fit(docs.withColumnRenamed("key", "doc_id"), sample_chars=3000, fold=-1).languages) >= 20


def test_unseen_words_fall_back_to_shorter_grams():
    model = langid.Model.fit([("en", "thing", 50), ("de", "gehen", 50), ("en", "water", 9), ("de", "wasser", 9)])
    langs, scores = model.predict(pa.array(["things", "begehen", "wassers", "12 ?!", "", None]))
    assert langs[:3] == ["en", "de", "de"] and langs[3:] == ["und"] * 3
    assert scores[3:].tolist() == [0, 0, 0] and (scores[:3] > 0.5).all()


def test_odd_rows(odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (4, 5, 6, 8))
    assert by_id[10]["lang_pred"] in model.languages
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ein wort", "de", 7, 0.5)], "doc_id long, text string, lang string, keep_0 int, score double")
    row = langid.identify(docs, langid.fit(docs, fold=-1), keep=("text", "lang", "keep_0")).first()
    assert (row["text"], row["lang"], row["keep_0"], row["lang_pred"]) == ("ein wort", "de", 7, "de")
    with pytest.raises(ValueError):
        langid.identify(docs, langid.Model.fit([]), keep=("score",))


def plain_scores(counts, text, least=2):
    """The log frequencies summed over a text's words by language, from counters and without tables of numbers."""
    import re
    from collections import Counter

    import numpy as np

    languages = sorted({lang for lang, _, _ in counts})
    tables = {k: {lang: Counter() for lang in languages} for k in range(6)}
    for lang, word, n in counts:
        tables[0][lang][word] += n
        for k in range(1, 6):
            for i in range(len(word) + 3 - k):
                tables[k][lang][f"_{word}_"[i : i + k]] += n
    known = {k: {x for lang in languages for x in t[lang] if sum(t[o][x] for o in languages) >= least} for k, t in tables.items()}

    def log(k, x, lang):
        return np.log((tables[k][lang][x] + 0.5) / (sum(tables[k][lang][y] + 0.5 for y in known[k]) + 1e-9))

    sums = dict.fromkeys(languages, 0.0)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        found, k = ([word], 0) if word in known[0] else ([], 6)
        while not found and k > 1:
            k -= 1
            found = [x for x in (f"_{word}_"[i : i + k] for i in range(len(word) + 3 - k)) if x in known[k]]
        for lang in languages:
            if found:
                sums[lang] += sum(log(k, x, lang) for x in found) / len(found)
    return sums


def test_scores_equal_brute_force():
    import numpy as np

    counts = [("de", "haus", 3), ("de", "wasser", 2), ("de", "nie", 1), ("en", "house", 4), ("en", "water", 1), ("en", "has", 2), ("fr", "maison", 2), ("fr", "haut", 1), ("fr", "é", 2)]
    model = langid.Model.fit(counts)
    texts = ["Haus water", "hausboot! nie", "maisonnette x9 é", "zzz qqq", "Wasser, wasser", "the 1 2 3", "has haut hat"]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        sums = plain_scores(counts, text)
        shares = {k: np.exp(v - max(sums.values())) for k, v in sums.items()}
        assert abs(shares[lang] / sum(shares.values()) - score) < 1e-4 and sums[lang] >= max(sums.values()) - 1e-4
