import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import bytekit, toxicity

FOLDER = "/root/testdata/sf0.1"


def named(texts):
    part = next(bytekit.chunks(pa.array(texts)))
    return [dict(zip(toxicity.NAMES, row.tolist())) for row in toxicity.features(part, EMPTY)]


INSULT_ONLY = toxicity._INSULTS
EMPTY = toxicity.Lexicon(np.sort(INSULT_ONLY), np.full(len(INSULT_ONLY), 2.0))


def plain_words(text):
    """The words of an ASCII text in their one form, letter by letter."""
    out, word = [], ""
    for c in text + "\0":
        if ord(c) < 128 and toxicity.FORM[ord(c)]:
            word += c
        else:
            if any(x.isalpha() for x in word):
                out.append(word)
            word = ""
    formed = []
    for w in out:
        w = "".join(chr(toxicity.FORM[ord(c)]) for c in w)
        formed.append("".join(c for i, c in enumerate(w) if not i or w[i - 1] != c))
    return formed


def test_forms_against_a_loop():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabB013 $@Zz") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts = ["".join(w + ".." for w in t.split()) for t in texts]  # nothing spelled out
    part = next(bytekit.chunks(pa.array(texts)))
    t = toxicity.tokens(part)
    got = [[t.data[t.begin[j]:t.end[j]].tobytes().decode() for j in range(t.words.first[i], t.words.first[i + 1])] for i in range(len(texts))]
    assert got == [plain_words(x) for x in texts]


def test_features():
    plain, leet, spelled, stretched, masked, shout, none, null = named(
        ["You are an idiot today", "you 1D10T", "such an i.d.i.o.t here", "an iiidiooot", "what an id*ot", "GO AWAY NOW!!! really?", "", None])
    for row in (plain, leet, spelled, stretched):
        assert row["insults a word"] > 0 and row["largest odds"] == 2.0
    assert plain["entries near second person"] > 0 and plain["nearest second person"] == 3 and leet["nearest second person"] == 1
    assert leet["read as letters"] == 0.5 and spelled["spelled out"] > 0 and stretched["stretched words"] == 0.5 and masked["masked"] > 0
    assert shout["capital words"] == 0.75 and shout["exclamations"] > 0 and shout["punctuation runs"] > 0 and shout["questions"] > 0
    assert none == null and none["words, log"] == 0 and none["nearest second person"] == 100


def test_texts_do_not_touch():
    """Features of a text are the same alone and between others."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["you", "idiot", "x", "SCUM", "l0ser", "été", "!!", "a b c"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    together = toxicity.features(next(bytekit.chunks(pa.array(texts))), EMPTY)
    for i, text in enumerate(texts):
        assert np.allclose(together[i], toxicity.features(next(bytekit.chunks(pa.array([text]))), EMPTY)[0]), text


def test_trees_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5)).astype(np.float32)
    y = (((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)) ^ (rng.random(4000) < 0.05)).astype(float)
    trees = toxicity.boost(x[:3000], y[:3000])
    sums = trees.sums(x[3000:])
    assert ((sums > 0) == (y[3000:] > 0.5)).mean() > 0.92
    xs, ys = toxicity.isotonic(sums, y[3000:], np.ones(1000))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] < ys[-1] < 1
    assert abs(np.interp(sums, xs, ys).mean() - y[3000:].mean()) < 0.03


def test_isotonic_by_hand():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]), np.ones(6))
    assert xs.tolist() == [1, 1, 2, 3, 4, 5] and np.allclose(ys, [0.25, 0.25, 0.5, 0.5, 0.625, 0.625])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")
def test_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.report(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 100 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
    assert abs(np.mean([r["score"] for r in rows]) - np.mean([r["toxic"] for r in rows])) < 0.02  # calibrated


def test_edges(spark):
    rng = random.Random(5)
    say = lambda bad: " ".join(rng.choice(["tree", "house", "river", "walk"] + ["zorblax", "you"] * bad) for _ in range(30))
    rows = [(i, say(i % 2), "s") for i in range(1200)]
    rows += [(2000, None, "s"), (2001, "", None), (2002, "zorblax you " * 100000, "s"), (None, "zorblax", "s"), (2003, "\u0000 !!", "s"), (5, say(1), "again"), (5, say(1), "again")]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "doc_id long, text string, `a.b` string, score double, toxic int").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(1200)] + [(7, 0, 0, "x"), (9, 0, None, "x"), (None, 0, 1, "x"), (9999, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2002]["predicted"] == 1 and by[2000]["score"] == by[2001]["score"] < 0.7 and by[None]["held_out"] is True
    right = [r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 1200]
    assert np.mean(right) > 0.97
    assert toxicity.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.report(docs, labels.where(F.col("toxic") == 1)).collect()} == {1.0}
