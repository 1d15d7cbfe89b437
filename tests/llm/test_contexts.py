"""Personal data: addresses with zero parts, copied rows, label lists and many cues."""

import brute

from vistrata.llm import bootstrap_pii


def test_address_parts_of_zeros(spark):
    texts = ["0.0.0.0", "10.0.0.1", "127.0.0.1", "192.168.1.0", "00.000.010.0255", "010.001.000.00", "0256.1.1.1", "1.2.3.0256", "a 0.0.0.00 b 1.0.256.0",
             "100.200.250.255", "1.1.1.1000", "0" * 3000 + ".0.0." + "0" * 3000, "0" * 3000 + ".0.0." + "0" * 3000 + "999", "00." * 2000 + "0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) for r in bootstrap_pii.spans(docs).collect()}
    assert got == {i: brute.personal(t) for i, t in enumerate(texts)}
    hidden = {r.doc_id: r.text for r in bootstrap_pii.masked(docs).collect()}
    assert hidden[1] == "[IP]" and hidden[6] == texts[6] and hidden[8] == "a [IP] b 1.0.256.0"


DESK = [f"text {i} contact desk: user{i}@mail.example.com and the office" for i in range(20)]
UNSEEN = [f"more {i} contact desk: ref-77{i}12x and more" for i in range(3)]


def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r.doc_id]: r.n_added for r in bootstrap_pii.spans(docs).collect()}


def test_copies_leave_contexts_alone(spark):
    want = added(spark, DESK + UNSEEN)
    assert [want[t] for t in UNSEEN] == [1, 1, 1]
    assert added(spark, DESK * 30 + UNSEEN) == want
    assert added(spark, DESK + UNSEEN * 100) == want


def test_label_lists(spark):
    """One word, or another identifier, may precede an identifier."""
    rows = [f"Name Bob{i}x Email: a{i}@b.example Ref: 10.2.3.{i}" for i in range(20)]
    new = ["Name Eve7x Email: eve_at_77b Ref: 10.2.3.99", "Email: eve_at_78b", "Name Eve Email: eve_at_79b"]
    made = added(spark, rows + new)
    assert [made[t] for t in new] == [1, 1, 1] and not any(made[t] for t in rows)
    # Cues that hold an identifier reach one that follows another at once.
    pairs = [f"id 77 c{i}@d.example" for i in range(20)]
    made = added(spark, [*pairs, "id 77 zed_at_80b"])
    assert made["id 77 zed_at_80b"] == 1


def test_every_pattern_counts(spark):
    """A rare precise cue counts beside more than a thousand with more seeds, and found instances make a cue count."""
    texts = [" ".join(f"c{k} w{k} u{k}n{j}@e.example end" for k in range(1010)) for j in range(6)]
    rare = [f"rare cue: 10.1.1.{i} end" for i in range(5)] + ["rare cue: ref_88x1y2 end"]
    next_turn = [f"contact desk: user{i}@mail.example.com end" for i in range(40)]
    next_turn += [f"contact desk: ref-77{i}12x end" for i in range(5)] + [f"second form: ref-77{i}12x end" for i in range(5)] + ["second form: zed_99x8y7 end"]
    made = added(spark, texts + rare + next_turn)
    assert made[rare[-1]] == 1 and made[next_turn[0]] == 0
    assert made[next_turn[-1]] == 1 and made["second form: ref-77012x end"] == 1
