"""Personal data by base patterns and by bootstrapped contextual extraction. DataFrame functions only.

Base spans: a text is cut by the kind's pattern; the lengths of gaps and matches give positions in code points, and
matches that fail the kind's check are dropped. Patterns never retry inside a run of their characters (possessive
loops, look-behind or the end of the last match), so long runs cost linear time and no deep stack.

Bootstrapping works on instances alone: words that hold a digit or an @ and do not stand inside a base span that began
before them. The one and two words before an instance, each alone and with the instance's shape (runs of letters, of
digits and of both, and marks), are its lexical patterns. Known instances are those that base spans begin in, and, as
a kind of their own that only patterns can confirm, single runs of SECRET letters and digits. Each turn, a pattern's
score for a kind is the sum of the scores of its distinct known instances of that kind over all distinct instances
that it precedes anywhere in the corpus, so copies of texts change nothing. A pattern counts from SEEDS known instances
of one kind on, if those are a share of SURE or more of its known instances of all kinds, and if its score is SURE or
more - or LIKELY, for a pattern with a shape, whose instances look alike (secrets excepted, which do by definition). It names its kind for all instances of LEAST
letters and digits that it precedes; those get the best score of their patterns and count as known in the next turn.
Words that match a kind's own pattern but failed its check are never named that kind. All tables hold hashes; their
rows follow the instances, not the words of the corpus.

In `masked`, spans of all kinds are laid over each other: where they overlap they are one, named by the first.

Defined cases: a null or empty text holds nothing; rows repeated with one doc_id and text give equal rows; null
doc_ids are kept; further columns are ignored (`spans`) or passed on (`masked`); an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrata.session import stage

SEPARATORS = r"\x20\x09-\x0D"
LOCAL = "A-Za-z0-9._%+-"
# The kinds in their order, the characters a text must hold, and the patterns.
KINDS = {
    "email": ("@", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# A number up to 255 with any zeros before it; a part of zeros only ends after them.
SMALL = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"
INSTANCE = rf"(?<![^{SEPARATORS}])[^{SEPARATORS}0-9@]*+[0-9@][^{SEPARATORS}]*+"
SEEDS, SURE, LIKELY, TURNS = 5, 0.8, 0.4, 3
# An instance's letters and digits, without which a word is no identifier.
LEAST = 6
# The kind that patterns alone confirm, and what its known instances look like.
SECRET = "secret"
SECRET_RUN = r"^[^A-Za-z0-9]*(?=[0-9]*[A-Za-z][0-9]*[A-Za-z])(?=[A-Za-z]*[0-9][A-Za-z]*[0-9])[A-Za-z0-9]{20,}[^A-Za-z0-9]*$"
ALL = [*KINDS, SECRET]
# Characters of a text that are masked together.
CHUNK = 4096
# Matches that are placed together.
RUN = 128
SPAN = "array<struct<start:int,end:int,value:string>>"


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{SMALL}(?:\.{SMALL}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        digit = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19))), F.lit(0), lambda total, i: total + F.when(
            i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
        return F.length(digits).between(16, 19) & (luhn % 10 == 0)
    return F.lit(True)


def _holds(text: Column, kind: str) -> Column:
    mark = KINDS[kind][0]
    return F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9][ -]?[0-9]")


def _cut(text: Column, pattern: str) -> Column:
    """Gaps and matches of a text in turn: gap i comes before match i; the last gap has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))


def _run(cut: Column) -> Column:
    """Spans of a run of matches from its own start, and the run's length."""
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))).alias("out"))

    return F.aggregate(cut, start, step)


def _placed(cut: Column) -> Column:
    """Spans of the matches of a cut text: runs of RUN matches first, so that a dense text costs no quadratic copying."""
    def whole(c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), lambda i: _run(F.slice(c, i * RUN + 1, F.lit(RUN))))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<base:int,out:{SPAN}>>)").alias("out"))
        based = F.aggregate(runs, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(
            acc["out"], F.array(F.struct(acc["at"].alias("base"), r["out"].alias("out")))).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(based, lambda r: F.transform(r["out"], lambda x: F.struct(
            (x["start"] + r["base"]).alias("start"), (x["end"] + r["base"]).alias("end"), x["value"].alias("value")))))

    # An array of one binds the cut text to a variable, so it is cut once.
    return F.get(F.transform(F.array(cut), whole), F.lit(0))


def found(text: Column, kind: str) -> Column:
    """Base spans of one kind: array of start, end and value; empty for a null text."""
    empty = F.expr(f"cast(array() as {SPAN})")
    spans = F.filter(_placed(_cut(text, KINDS[kind][1])), lambda s: _passes(kind, s["value"]))
    return F.when(_holds(text, kind), spans).otherwise(empty)


def _line(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SEPARATORS}]+", -1), lambda w: w != "")


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _shifted(words: Column, by: int) -> Column:
    """Of each word the one `by` places before it, or null."""
    return F.concat(F.expr(f"cast(array({', '.join(['null'] * by)}) as array<string>)"), F.slice(words, 1, F.greatest(F.size(words) - by, F.lit(0))))


def _cues(first: Column, second: Column) -> Column:
    """Hashes of the patterns that two words before a place make: the nearest word, and both (null if there is one word)."""
    return F.array(F.xxhash64(second), F.when(first.isNotNull(), F.xxhash64(first, second)))


def _shape(value: Column) -> Column:
    mixed = F.regexp_replace(value, "[A-Za-z]++[0-9][A-Za-z0-9]*+|[0-9]++[A-Za-z][A-Za-z0-9]*+", "\u0001")
    return F.regexp_replace(F.regexp_replace(mixed, r"\p{L}++", "a"), "[0-9]++", "0")


def _long(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")) >= LEAST


def instances(rows: DataFrame) -> DataFrame:
    """doc_id, t, start, end, v (hash of the value), seed (kind, or null), base (in a base span), refused (kinds whose
    check it failed), able (long enough), pattern and the least score it counts with, a row for each pattern of each instance.

    `rows` holds doc_id, t, text and the base spans by kind."""
    some = rows.withColumn("w", _words(F.col("text"))).withColumn("l", _words(_lower(F.col("text"))))
    # The words with a digit or an @ are the instances, in their order.
    words = F.arrays_zip(F.col("w").alias("word"), _shifted(F.col("l"), 1).alias("second"), _shifted(F.col("l"), 2).alias("first"))
    placed = some.select("doc_id", "t", *KINDS, F.inline(F.arrays_zip(
        _placed(_cut(F.col("text"), INSTANCE)).alias("span"), F.filter(words, lambda x: x["word"].rlike("[0-9@]")).alias("before"))))
    start, end, value = (F.col(f"span.{c}") for c in ("start", "end", "value"))
    meets = lambda kind: F.exists(kind, lambda s: (start < s["end"]) & (end > s["start"]))
    within = lambda kind: F.exists(kind, lambda s: (start > s["start"]) & (start < s["end"]))
    for kind in KINDS:
        placed = placed.where(~within(kind))
    base = F.coalesce(*(F.when(meets(k), k) for k in KINDS))
    refused = F.filter(F.array(*(F.when(_holds(value, k) & value.rlike(pattern), F.lit(k)) for k, (_, pattern) in KINDS.items())), lambda k: k.isNotNull())
    cues = F.col("cues")
    return (placed.where("before.second is not null")
            .select("doc_id", "t", start.alias("start"), end.alias("end"), F.xxhash64(value).alias("v"), _shape(value).alias("shape"),
                    F.coalesce(base, F.when(value.rlike(SECRET_RUN), SECRET)).alias("seed"), base.isNotNull().alias("base"),
                    refused.alias("refused"), _long(value).alias("able"), F.filter(_cues(F.col("before.first"), F.col("before.second")), lambda c: c.isNotNull()).alias("cues"))
            .withColumn("p", F.explode(F.concat(F.transform(cues, lambda c: F.struct(c.alias("pattern"), F.lit(SURE).alias("least"))), F.transform(
                cues, lambda c: F.struct(F.xxhash64(c, "shape").alias("pattern"), F.lit(LIKELY).alias("least"))))))
            .select("doc_id", "t", "start", "end", "v", "seed", "base", "refused", "able", "p.pattern", "p.least"))


def bootstrapped(edges: DataFrame) -> DataFrame:
    """pattern, kind and score of every sure pattern of the instances in `edges`."""
    graph = stage(edges.groupBy("pattern", "v").agg(F.min("seed").alias("seed"), F.first("refused").alias("refused"), F.first("able").alias("able"), F.first("least").alias("least")), "graph")
    # Patterns that can never count are left out before anything is joined.
    able = graph.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.col("seed").isNotNull() | F.col("able")).alias("most")).where(F.col("most") >= SEEDS)
    graph = stage(graph.join(able.select("pattern", "n"), "pattern"), "patterns")
    known = graph.where("seed is not null").select("v", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    for turn in range(TURNS):
        sums = graph.join(known, "v").groupBy("pattern", "kind").agg(
            (F.sum("score") / F.first("n")).alias("score"), F.count("*").alias("n_known"), F.first("least").alias("least"))
        # A row for each kind of a pattern.
        of_all = F.sum("n_known").over(Window.partitionBy("pattern"))
        # Secrets look alike by their definition, so only patterns without a shape tell.
        least = F.when(F.col("kind") != SECRET, F.col("least")).when(F.col("least") == SURE, F.lit(SURE))
        counts = (F.col("n_known") >= SEEDS) & (F.col("score") >= least) & (F.col("n_known") >= SURE * F.col("of_all"))
        patterns = stage(sums.withColumn("of_all", of_all).where(counts).select("pattern", "kind", "score"), "sure")
        if turn + 1 < TURNS:
            named = (graph.where("seed is null and able").join(patterns, "pattern").where(~F.array_contains("refused", F.col("kind")))
                     .groupBy("v").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best")).select("v", "best.kind", "best.score"))
            known = stage(named.unionByName(graph.where("seed is not null").select("v", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()), "known")
    return patterns


def discovered(docs: DataFrame, hidden: Column | None = None) -> DataFrame:
    """doc_id, t, kind, start and end of identifiers that sure patterns precede outside base spans. For tests, known
    instances with `hidden` true (a condition on the hash v) are taken as unknown."""
    edges = instances(_based(docs.where(F.col("text").rlike("[0-9@]"))))
    if hidden is not None:
        edges = edges.withColumn("seed", F.when(~hidden, F.col("seed"))).withColumn("base", F.col("base") & ~hidden).withColumn(
            "refused", F.when(hidden, F.array().cast("array<string>")).otherwise(F.col("refused")))
    edges = stage(edges, "instances")
    found = edges.where("able and not base").join(bootstrapped(edges), "pattern").where(~F.array_contains("refused", F.col("kind")))
    return (found.groupBy("doc_id", "t", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
            .select("doc_id", "t", "kind", "start", "end"))


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, t, text and base spans by kind."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text", *(found(F.col("text"), k).alias(k) for k in KINDS))


def _added(docs: DataFrame) -> DataFrame:
    """doc_id, t and new spans by text."""
    return discovered(docs).groupBy(F.col("doc_id").alias("__doc"), F.col("t").alias("__t")).agg(
        F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("__more"))


MORE = "cast(array() as array<struct<kind:string,start:int,end:int>>)"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans (all) of every row."""
    more = _added(docs)
    rows = _based(docs).drop("text")
    kept = rows.join(more, rows["doc_id"].eqNullSafe(more["__doc"]) & (rows["t"] == more["__t"]), "left")
    extra = lambda kind: F.transform(F.filter(F.coalesce("__more", F.expr(MORE)),
                                              lambda s: s["kind"] == kind), lambda s: F.struct(s["start"], s["end"], F.lit("").alias("value")))
    both = lambda kind: F.array_sort(F.concat(F.col(kind), extra(kind))) if kind in KINDS else extra(kind)
    n_added = F.when(F.col("__more").isNull(), 0).otherwise(F.size("__more")).cast("bigint")
    sizes = [F.size(k).cast("bigint") for k in KINDS]
    return kept.select(
        "doc_id", *(n.alias(f"n_{k}") for k, n in zip(KINDS, sizes)),
        F.sha2(F.array_join(F.concat(*(_line(k, F.col(k)) for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(_line(k, both(k)) for k in ALL)), ",").alias("spans"),
        n_added.alias("n_added"), (sizes[0] + sizes[1] + sizes[2] + sizes[3] + n_added).alias("n_spans"))


def _masked_chunk(chunk: Column, i: Column, spans: Column) -> Column:
    """A chunk of the text, spans in it replaced; a span's name stands in the chunk where it begins."""
    low = i * CHUNK
    high = low + F.length(chunk)
    own = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < high))
    part = lambda a, b: F.substring(chunk, a - low + 1, b - a)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], F.least(s["end"], high)).alias("at"), F.when(
            fresh, F.concat(acc["out"], part(acc["at"], s["start"]), name)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(own, F.struct(low.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], part(acc["at"], high)))


def masked(docs: DataFrame) -> DataFrame:
    """The rows with personal data in text replaced by the kind's name in brackets."""
    more = _added(docs)
    joined = docs.join(more, docs["doc_id"].eqNullSafe(more["__doc"]) & (F.xxhash64(docs["text"]) == more["__t"]), "left")
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(ALL) for x in (k, i)))
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank[kind(s)].alias("rank"), kind(s).alias("kind")))
    every = F.concat(*(named(found(F.col("text"), k), lambda s, k=k: F.lit(k)) for k in KINDS), named(F.coalesce("__more", F.expr(MORE)), lambda s: s["kind"]))
    spanned = joined.withColumn("__spans", F.array_sort(every))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    text = F.array_join(F.transform(chunks, lambda c, i: _masked_chunk(c, i, F.col("__spans"))), "")
    return spanned.withColumn("text", F.when(F.size("__spans") > 0, text).otherwise(F.col("text"))).select(*docs.columns)
