"""Recurrent language identification: gradients, the plain recursion, held-out accuracy and odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD

from vistrata.llm import language

KINDS = "doc_id bigint, lang string, text string"


def packed(words):
    words = sorted(words, key=len, reverse=True)
    sizes = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes


def plain(network, word):
    """Log probabilities of each byte of a word, in loops over bytes and numbers."""
    def states(layer, text):
        k, out = layer.state.shape[0], []
        h = [0.0] * k
        for c in text:
            past = [sum(h[i] * float(layer.state[i, j]) for i in range(k)) for j in range(3 * k)]
            z = [1 / (1 + math.exp(-float(layer.byte[c, j]) - past[j])) for j in range(k)]
            r = [1 / (1 + math.exp(-float(layer.byte[c, k + j]) - past[k + j])) for j in range(k)]
            n = [math.tanh(float(layer.byte[c, 2 * k + j]) + r[j] * past[2 * k + j]) for j in range(k)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(k)]
            out.append(h)
        return out

    ahead, behind = states(network.layers[0], word), states(network.layers[1], word[::-1])[::-1]
    out = []
    for x, y in zip(ahead, behind):
        logits = [sum(v * float(w) for v, w in zip(x + y, network.out[:, j])) + float(network.bias[j]) for j in range(network.out.shape[1])]
        total = math.log(sum(map(math.exp, logits)))
        out.append([v - total for v in logits])
    return out


def test_network_is_the_plain_recursion():
    network = language.Network(["a", "b", "c"], hidden=4)
    network.bias += np.array([0.1, -0.2, 0.3], np.float32)
    words = ["langage".encode(), "É".encode(), b"x", b"of,", b"abcabcabcabc"]
    data, starts, sizes = packed(words)
    got = network.totals(data, starts, sizes)
    for row, word in zip(got, sorted(words, key=len, reverse=True)):
        assert np.allclose(row, np.sum(plain(network, word), 0), atol=1e-4)


def test_gradients_agree_with_differences():
    network = language.Network(["a", "b", "c"], hidden=3)
    for layer in network.layers:
        layer.byte, layer.state = layer.byte.astype(float), layer.state.astype(float)
    network.out, network.bias = network.out.astype(float), network.bias.astype(float)
    data, starts, sizes = packed([b"abac", b"bca", b"cc", b"a", b"a"])
    labels = np.array([0, 1, 2, 0, 1])
    _, made = network.gradients(data, starts, sizes, labels)
    rng = np.random.default_rng(1)
    for w, g in zip(network.weights(), made):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if w.shape[0] == 256:
                at = (rng.choice(data), at[1])
            old = w[at]
            loss = []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                loss.append(network.gradients(data, starts, sizes, labels)[0])
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-7


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, network):
    made = language.predicted(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = made.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 300 and right >= 0.98 * n
    assert made.where("score < 0 or score > 1 or score is null").count() == 0


def test_learns_nothing_from_held_out_rows(spark, docs):
    """Held-out rows may say anything: the network is the same."""
    lied = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    small = [language.train(d.where("doc_id < 120"), 20) for d in (docs, lied)]
    assert small[0].languages == small[1].languages and all((a == b).all() for a, b in zip(small[0].weights(), small[1].weights()))


def test_odd_rows(spark, network):
    rows = [(d, None, t) for d, t in ODD] + [(50, "zz", "1234 !? ٣"), (51, "en", "·—…"), (52, None, "中文"), (53, None, "١ x"), (54, "fr", "ô")]
    docs = spark.createDataFrame(rows, KINDS).select("*", *(F.lit(c).alias(c) for c in ("held_out", "score", "lang_pred", "words", "place", "share", "count")))
    made = language.predicted(docs, network).collect()
    assert len(made) == len(rows)
    letters = {(d, any(c.isalpha() for c in t or "")) for d, _, t in rows}
    assert {(r.doc_id, r.lang_pred != "und") for r in made} == letters
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in made)
    assert all(r.score == 0 if r.lang_pred == "und" else 0 < r.score <= 1 for r in made)
    assert language.identified(docs).count() == len(rows)


def test_runs_of_any_cache_are_the_same(docs, network, monkeypatch):
    """Results do not depend on what a worker has met before."""
    few = docs.where("doc_id < 60")
    want = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.predicted(few, network).collect()}
    monkeypatch.setattr(language, "KEPT", 50)
    assert {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.predicted(few.repartition(3), network).collect()} == want


def test_without_rows_to_learn_from(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    for rows in ([], [(held, "en", "held out text")], [(1, None, "no label"), (2, "en", "12")]):
        docs = spark.createDataFrame(rows, KINDS)
        assert language.train(docs) is None
        assert [(r.lang_pred, r.score) for r in language.identified(docs).collect()] == [("und", 0.0)] * len(rows)


def test_copies_of_one_row_are_bounded_in_the_sample(spark):
    docs = spark.createDataFrame([(0, "en", "the same words of all")] * 500 + [(1, "fr", "les mots de la langue")], KINDS)
    network = language.train(docs, 10)
    assert network.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in language.predicted(docs, network).collect()}
    assert got == {0: "en", 1: "fr"}
