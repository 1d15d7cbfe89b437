"""Quality rules, line dedup, near-duplicates, language model and personal data against brute force."""

import os
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistrata.llm import arrays, bootstrap_pii, hmm, line_windows, repetition, setsketch

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "alone"), (5, "a b c"), (6, "A B c"), (7, PASSAGE + " eighteen"), (8, PASSAGE.upper() + " eighteen"),
    (9, PASSAGE + " nineteen"), (10, PASSAGE + " eighteen"), (10, PASSAGE + " eighteen"), (None, PASSAGE + " eighteen"), (None, None),
    (11, LONG), (12, LONG + " end"), (13, "same line here\n" * 9), (14, "# * $ % & | < >\n" * 8), (15, "Ünï ço de　wide \x1c x\x0by"),
    (16, "x" * 5000), (17, "p q\nr s\n\nt u\nv w"), (18, "z\n p q \n\nr s\nt u\nend"), (18, "other text of one id"),
    (19, "mail a@b.c_d@e.f and 1.2.3.4.5.6.7.8 or 300.1.1.1"), (20, "4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (952) 555-4063."),
    (21, "0" * 3000), (22, "a" * 3000 + "@" + "b." * 500), (23, "+1 2" * 99), (24, "é a@b a@b..c x@y.z-.q"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    # Columns whose names the operators use inside.
    return rows.select("*", *(F.lit(c).alias(c) for c in ("t", "vid", "kept", "n_words", "label", "gone", "bucket", "held_out", "row", "start")))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("data", ["odd", "real"])
def test_quality_measures(data, request):
    docs = request.getfixturevalue(data)
    got = repetition.measure(docs).collect()
    names = [*repetition.COLUMNS[:5], "base_failed"]
    assert ordered((r.doc_id, *(r[c] for c in names)) for r in got) == ordered((d, *brute.quality(t)) for d, t in pairs(docs))
    grams = [f"dup_gram_chars_{n}" for n in repetition.GRAM_LIMITS]
    assert ordered((r.doc_id, *(r[c] for c in grams)) for r in got) == ordered(
        (d, *(brute.later_gram_chars(t, n) for n in repetition.GRAM_LIMITS)) for d, t in pairs(docs))


def test_quality_keeps_rows_whole(odd):
    kept = repetition.keep(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in repetition.measure(odd).where("kept").collect()}
    assert 11 in {r.doc_id for r in kept.collect()} and 13 not in {r.doc_id for r in kept.collect()}


def test_line_windows(odd, real):
    for docs in (odd, real):
        want = brute.line_windows(pairs(docs))
        got = line_windows.deduplicated(docs)
        assert got.columns == docs.columns
        assert ordered(r.text for r in got.collect()) == ordered(want.get((d, t), t) for d, t in pairs(docs))


def test_shared_passage_inside_a_first_copy_goes(spark):
    """A holds a passage; B holds it between lines of its own; C is a copy of B."""
    passage, b = "p one\np two\np three", "b one\nb two\np one\np two\np three\nb three\nb four"
    docs = spark.createDataFrame([(1, passage), (2, b), (3, b)], "doc_id bigint, text string")
    made = {r.doc_id: (r.n_removed, r.text) for r in line_windows.deduplicated(docs, count=True).collect()}
    assert made == {1: (0, passage), 2: (3, "b one\nb two\nb three\nb four"), 3: (7, "")}


def test_line_windows_drop_emptied_texts(spark):
    text = "a b\nc d\ne f\ng h"
    docs = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, text + "\nown line")], "doc_id bigint, text string")
    assert ordered(pairs(line_windows.without_emptied(docs))) == [(1, text), (3, ""), (4, "own line")]


def test_sketch_estimates(spark):
    values = arrays.mix(np.arange(4000, dtype=np.uint64))
    for shared in (2000, 1000, 400):
        one, two = values[:2000], values[2000 - shared:4000 - shared]
        made = setsketch.registers(np.concatenate((one, two)), np.array([0, 2000]))
        got = setsketch.likely(made[:1], made[1:], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - shared / (4000 - shared)) < 0.15
    merged = setsketch.registers(np.concatenate((values[:100], values[100:200])), np.array([0]))
    parts = setsketch.registers(values[:200], np.array([0, 100]))
    assert (merged[0] == parts.max(0)).all()


@pytest.mark.parametrize("data", ["odd", "real"])
def test_near_duplicates(data, request):
    docs = request.getfixturevalue(data)
    rows = pairs(docs)
    want = ordered((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute.components(rows, 4, 80)))
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.grouped(docs, 4, 80).collect()) == want


def test_near_duplicate_stage(odd):
    kept = setsketch.without_copies(odd)
    assert kept.columns == odd.columns
    ids = ordered(r.doc_id for r in kept.collect())
    # Wordless rows stay; copies, repeated rows and the null doc_id of a copy go as one group.
    assert ids.count(None) == 2 and 7 not in ids and {1, 2, 3, 4, 5, 11, 18} <= set(ids) and ids.count(18) == 2 and 12 not in ids


def test_sets_that_share_half_a_key(spark, real, monkeypatch):
    """Sets whose vid is the same stay apart."""
    want = {r.doc_id: r.component_id for r in setsketch.grouped(real, 4, 80).collect()}
    sketch = setsketch.sketch
    monkeypatch.setattr(setsketch, "sketch", lambda *a: sketch(*a).withColumn("vid", F.when(F.col("vid").isNotNull(), F.col("vid") % 3)))
    assert {r.doc_id: r.component_id for r in setsketch.grouped(real, 4, 80).collect()} == want


def test_many_rows_without_doc_id(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), (F.col("id") % 2500 * 100 + i).cast("string"))), " ")
    docs = spark.range(10_000).select(F.lit(None).cast("bigint").alias("doc_id"), words.alias("text"))
    made = setsketch.grouped(docs)
    assert made.count() == 10_000 and made.where("component_id is null and n_shingles = 8").count() == 10_000
    assert setsketch.without_copies(docs).count() == 2500


def test_unlinked_copies_meet_across_components(spark):
    """A chain of texts, each 80 percent like the next only, is one component; a crowd around one text keeps its strays."""
    words = [f"c{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 10:i * 10 + 100])) for i in range(12)]
    base = [f"b{i}" for i in range(60)]
    crowd = []
    for k in range(150):
        text = list(base)
        for j in range(k % 6):
            text[(k * 7 + j * 11) % 60] = f"n{k}y{j}"
        crowd.append((100 + k, " ".join(text)))
    rows = chain + crowd
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {d: c for (d, _), (_, c) in zip(rows, brute.components(rows, 4, 80))}
    assert {r.doc_id: r.component_id for r in setsketch.grouped(docs, 4, 80).collect()} == want


def test_language_model(odd, real):
    for docs in (odd, real):
        rows = pairs(docs)
        want, n = brute.base_scores(rows)
        got = ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in hmm.scored(docs, 1).collect())
        assert got == ordered((d, h, t, k, n, round(s, 6)) for (d, _), (h, t, k, s) in zip(rows, want))


def test_language_model_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, model = hmm.scored(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_forward_backward_is_exact():
    model = hmm.Model(np.arange(1.0, 6.0))
    rng = np.random.default_rng(5)
    model.move = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    model.emit = rng.dirichlet(np.ones(5), hmm.STATES).T
    sequence = np.array([0, 3, 4, 1, 2, 2, 0], np.uint16)
    alpha = model.start * model.emit[sequence[0]]
    for x in sequence[1:]:
        alpha = alpha @ model.move * model.emit[x]
    assert abs(model.log10(np.concatenate((sequence, sequence[:2])), np.array([0, 7, 9]))[0] - np.log10(alpha.sum())) < 1e-12
    counts = model.expected(np.array([sequence, np.resize(sequence[:2], 7)]), np.array([7, 2]))
    k = hmm.STATES
    assert np.isclose(counts[:k].sum(), 2) and np.isclose(counts[k:k + k * k].sum(), 7) and np.isclose(counts[k + k * k:].sum(), 9)


def test_windows_of_a_text_are_one_sequence():
    """Expected counts do not depend on where texts are cut, and are those of the recursion over whole texts."""
    model = hmm.Model(np.arange(1.0, 7.0))
    rng = np.random.default_rng(6)
    model.start, model.move = rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    model.emit = rng.dirichlet(np.ones(6), hmm.STATES).T
    cuts = np.cumsum([0, 1, 40, 8, 9, 0, 17, 16, 3])
    data = rng.integers(0, 6, cuts[-1]).astype(np.uint16)
    k, want = hmm.STATES, 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        x = data[a:b]
        if not len(x):
            continue
        alpha = [model.start * model.emit[x[0]]]
        for c in x[1:]:
            alpha.append(alpha[-1] @ model.move * model.emit[c])
        beta = [np.ones(k)]
        for c in x[:0:-1]:
            beta.insert(0, model.move @ (model.emit[c] * beta[0]))
        total, move, emit = alpha[-1].sum(), np.zeros((k, k)), np.zeros((6, k))
        for t, c in enumerate(x):
            emit[c] += alpha[t] * beta[t] / total
            if t:
                move += np.outer(alpha[t - 1], model.emit[c] * beta[t]) * model.move / total
        want = want + np.concatenate((alpha[0] * beta[0] / total, move.ravel(), emit.ravel()))
    for window in (1, 4, 8, 256):
        assert np.allclose(model.whole(data, cuts, window), want)


def test_whole_score_of_a_text(spark, real, monkeypatch):
    """The model's score with looked-up, shared and rare tokens against a plain recursion over each text's tokens."""
    monkeypatch.setattr(hmm, "OWN", 12)
    monkeypatch.setattr(hmm, "BUCKETS", 8)
    monkeypatch.setattr(hmm, "LOOKED_UP", 60)
    docs = real.where("doc_id < 60").unionByName(spark.createDataFrame([(900, None), (901, "Unseen wörds unseen")], "doc_id bigint, text string"))
    models, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **b: models.append((train(*a, **b), a[1])) or models[-1][0])
    got = {r.doc_id: r.score for r in hmm.scored(docs, 2).collect()}
    (model, tables), rows = models[0], pairs(docs)
    words = {d: brute.WORD.findall((t or "").translate(brute.LOWER)) + [None] for d, t in rows}
    code = lambda w: hmm.END if w is None else int(hmm._word_hashes(arrays.Block(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), 0, 1))[0][0])
    codes = {w: code(w) for ws in words.values() for w in ws}
    counts = {}
    for d, ws in words.items():
        if not zlib.crc32(str(d).encode()) % 5 == 1:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    own = {int(h): int(k) for h, k in zip(tables.h, tables.kind) if k < 12}
    kind = lambda w: 20 if w is None else own.get(codes[w], 12 + codes[w] % 8)
    shared = {w: c for w, c in counts.items() if 12 <= kind(w) < 20}
    for d, ws in words.items():
        log, alpha = 0.0, None
        for w in ws:
            k = kind(w)
            share = 1.0
            if 12 <= k < 20:
                same = [c for v, c in shared.items() if kind(v) == k]
                share = (counts.get(w, 0) + 0.5) / (sum(same) + 0.5 * (len(same) + 1))
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[k] * share
            log += np.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[d] - log) < 1e-6 * max(1, abs(log))


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    made = hmm.scored(spark.createDataFrame([(held, "a b")] * 3 + [(held, None)], "doc_id bigint, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in sorted(made, key=lambda r: -r.n_tokens)] == [(3, 0, 0, 0.0)] * 3 + [(1, 0, 0, 0.0)]
    assert all(np.isfinite(r.score) for r in made)


@pytest.mark.parametrize("data", ["odd", "real"])
def test_personal_data(data, request):
    docs = request.getfixturevalue(data)
    got = ordered((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) for r in bootstrap_pii.spans(docs).collect())
    assert got == ordered((d, *brute.personal(t)) for d, t in pairs(docs))


def test_half_of_the_known_comes_back(spark):
    """Identifiers after labels of one kind, every second value unknown: all come back, and no word of the other rows."""
    rows = [(i, f"note {i % 3} write to: user{i}x@mail{i}.example.com or call +1 (555) 010-{1000 + i} of version 12{i}.0 please") for i in range(60)]
    rows += [(100 + i, f"the year 19{i}45678 or user{i}x@mail{i}.example.com, file a{i}b2c3d4 in row {i}99912") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hidden = F.pmod("v", F.lit(2)) == 0
    edges = bootstrap_pii.instances(bootstrap_pii._based(docs))
    lost = {(r.doc_id, r.start) for r in edges.where(hidden & F.col("base") & (F.col("doc_id") < 100) & (F.col("seed") == "email")).collect()}
    got = bootstrap_pii.discovered(docs, hidden).collect()
    assert len(lost) > 15 and lost <= {(r.doc_id, r.start) for r in got if r.kind == "email"}
    texts = dict(rows)
    assert all("@" in texts[r.doc_id][r.start:r.end] or texts[r.doc_id][r.start] in "+(" for r in got)


def test_secrets_come_by_patterns_only(spark):
    """Runs of letters and digits are named where a label always precedes such runs, and nowhere else."""
    rows = [(i, f'x {i} token = "{i % 7}a{i}f0c9e8b7d6a5{i}4f3e2d1c0b" end') for i in range(12)] + [(50, "x token = hunter2pass! end")]
    rows += [(60 + i, f"a commit 9f{i}a8b7c6d5e4f3a2b1c0d9 and a commit {i}12345678") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = {r.doc_id: r for r in bootstrap_pii.spans(docs).collect()}
    assert all(made[i].spans.startswith("secret:") and made[i].n_spans == 1 for i in range(12))
    assert made[50].spans == "secret:10:22" and all(made[60 + i].n_spans == 0 for i in range(9))
    assert {r.doc_id: r.text for r in bootstrap_pii.masked(docs).collect()}[50] == "x token = [SECRET] end"


def test_masking_is_one_cut(spark, monkeypatch):
    """Overlapping spans of several kinds are one, named by the first, across chunks as well."""
    text = "a 4111 1111 1111 1111@b.cd +1 (952) 555-4063 or 1.2.3.4.5 é" + "z" * 30 + " +4111111111111111 end x@y.z"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no data 7")], "doc_id bigint, text string")
    want = {2: None, 3: "", 4: "no data 7", 1: "a [CARD] [PHONE] or [IP].5 é" + "z" * 30 + " +[CARD] end [EMAIL]"}
    for size in (4096, 7, 1):
        monkeypatch.setattr(bootstrap_pii, "CHUNK", size)
        assert {r.doc_id: r.text for r in bootstrap_pii.masked(docs).collect()} == want


def test_contexts_find_unseen_identifiers(spark):
    """A cue that mostly stands before addresses finds identifiers of another form; common words do not."""
    rows = [(i, f"text {i} contact desk: user{i}@mail.example.com and the office") for i in range(20)]
    rows += [(100 + i, f"more {i} contact desk: ref-77{i}12x and the 9912345 end") for i in range(3)]
    rows += [(200 + i, f"the 12345678{i} is fine. the the the") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = {r.doc_id: r for r in bootstrap_pii.spans(docs).collect()}
    assert [made[i].n_added for i in (0, 100, 101, 102, 200)] == [0, 1, 1, 1, 0]
    text = dict(rows)[100]
    assert made[100].spans == f"email:{text.index('ref-')}:{text.index(' and')}" and made[100].n_email == 0
    hidden = {r.doc_id: r.text for r in bootstrap_pii.masked(docs).collect()}
    assert hidden[100] == "more 0 contact desk: [EMAIL] and the 9912345 end" and hidden[1].count("[EMAIL]") == 1 and hidden[200] == dict(rows)[200]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for made in (repetition.measure(none), repetition.keep(none), line_windows.deduplicated(none), setsketch.grouped(none),
                 setsketch.without_copies(none), hmm.scored(none), bootstrap_pii.spans(none), bootstrap_pii.masked(none)):
        assert made.count() == 0


def test_no_local_copy_of_inputs():
    """The folder of these operators stays free of data."""
    here = os.path.dirname(os.path.abspath(arrays.__file__))
    assert all(n.endswith(".py") or n == "__pycache__" for n in os.listdir(here))
