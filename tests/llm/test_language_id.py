import os

import pytest
from pyspark.sql import functions as F

from srcatlas.llm import language_id as lid

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = lid.report(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n, rejected = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 150 and right > 0.98 and rejected < 0.02


def test_edges(spark):
    en = "the of and that with this from there " * 3
    de = "der die und nicht schön für über ein " * 3
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s", "x") for i in range(200)]
    rows += [(900, None, "en", "s", "x"), (901, "", None, "s", "x"), (902, "123 !!!", "de", "s", "x"), (903, en * 4000, None, None, "x"), (904, "中", None, "s", "x"), (None, de, "de", "s", "x"), (905, de, None, "s", "x"), (905, de, None, "s", "x"), (906, "a", None, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)
    got = lid.report(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[903]["lang_pred"] == "en" and by[905]["lang_pred"] == "de" and by[904]["lang_pred"] != "und"
    assert by[None]["held_out"] is True and all(0 <= r["score"] <= 1 for r in got)
    kept = lid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0 and kept.where("doc_id < 900").count() == 200
    assert lid.report(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in lid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def spoken(language, rng, words):
    """Sentences over a small vocabulary of the language's own syllables."""
    syllables = {"aa": ["ba", "de", "fi", "go", "lu"], "bb": ["str", "unk", "ach", "elz", "ing"], "cc": ["qué", "ñan", "oix", "sue", "yll"], "dd": ["ttä", "yks", "hö", "mme", "vai"]}[language]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def predicted(model, texts):
    import pyarrow as pa

    from srcatlas.llm import bytekit

    return [x for part in bytekit.chunks(pa.array(texts)) for x in zip(*lid.predict(model, part))]


def test_unknown_languages_are_rejected():
    """Each language left out of the fit in turn is rejected, those in it are not; so are code and shuffled letters."""
    import random

    rng = random.Random(1)
    languages = ["aa", "bb", "cc", "dd"]
    for left_out in languages:
        known = [x for x in languages if x != left_out]
        model = lid.fit([(x, spoken(x, rng, rng.randint(5, 200)).encode()) for _ in range(300) for x in known])
        strange = [spoken(left_out, rng, 40) for _ in range(100)] + ["for (int i = 0; i < n; i++) { x[i] = f(i); } // return 0;"] * 10
        strange += ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz" * 8, 200)) for _ in range(10)]
        assert sum(r for _, _, r in predicted(model, strange)) >= 0.9 * len(strange), left_out
        usual = [(x, spoken(x, rng, rng.randint(5, 200))) for _ in range(200) for x in known]
        got = predicted(model, [t for _, t in usual])
        assert sum(r for _, _, r in got) <= 0.02 * len(usual)
        assert sum(model.languages[b] == x for (b, _, _), (x, _) in zip(got, usual)) > 0.98 * len(usual)


def test_predictions_against_a_loop():
    """Subwords, averages, softmax, familiarity and rejection of each text alone, in plain Python."""
    import math
    import random

    rng = random.Random(2)
    model = lid.fit([(x, spoken(x, rng, rng.randint(3, 60)).encode()) for _ in range(250) for x in ("aa", "cc")], epochs=2)
    texts = [spoken(rng.choice(["aa", "bb", "cc"]), rng, rng.randint(1, 30)) for _ in range(40)] + ["A", "", "12 !", "É", "x" * 3000, "中文 ok"]
    for (best, score, rejected), text in zip(predicted(model, texts), texts):
        data = [int(lid._SUBWORD[b]) for b in text.encode()]
        buckets = []
        for k in lid.ORDERS:
            for i in range(len(data) - k + 1):
                gram = sum(data[i + j] << (8 * j) for j in range(k))
                buckets.append((((gram * 2654435761) ^ ((gram >> 15) * (0x85EBCA6B + 2 * (k - 1)))) & 0xFFFFFFFF) >> 16)
        n = max(1, len(buckets))
        logits = [sum(model.products[b, j] for b in buckets) / n + model.bias[j] for j in range(2)]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        p = [x / sum(p) for x in p]
        if not any(c.isalpha() for c in text):
            assert (best, score, rejected) == (-1, 0.0, True)
            continue
        middle, between, within, most = model.usual
        away = (middle - sum(model.familiar[b] for b in buckets) / n) / math.sqrt(between ** 2 + within ** 2 * lid.OVERLAP / n)
        assert best == p.index(max(p)) and abs(score - max(p)) < 1e-9
        assert rejected == ((bool(buckets) and away > most) or max(p) < model.threshold)
