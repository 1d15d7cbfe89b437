"""Registered queries of the training-data operators; SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistrata.llm import agenda, bootstrap_pii, hmm, language, learned_partitions, line_windows, merkle, packing, repetition, resampling, setsketch, token_counts, twins, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    """Register fn(read), where read(name) gives a driver table."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op2_quality_rules", twins.QUALITY)
def _(read):
    """Repetition measures and verdicts of every document."""
    return repetition.measure(read("documents"))


@query("op3_hidden_markov")
def _(read):
    """Model and base scores of every document."""
    return hmm.scored(read("documents"))


@query("op4_best_fit_packing")
def _(read):
    """Pieces of every document in sequences of 2048 tokens."""
    return packing.packed(read("documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_setsketch_dedup", twins.NEAR)
def _(read):
    """Component of every document at four words and 80 percent."""
    return setsketch.grouped(read("documents"), size=4, percent=80)


@query("op8_piece_agenda")
def _(read):
    """Ids and decoded text of every document, as digests."""
    return agenda.encoded(read("documents"), vocabulary("piece_bpe_32k.model"))


@query("op5_url_logistic")
def _(read):
    """Verdict on every page's URL; the model learns from the labelled table of the operator."""
    pages = read("pages")
    return url_filter.judged(pages, url_filter.train(url_filter.labelled(pages.sparkSession)))


@query("op6_line_windows", twins.LINE_WINDOWS)
def _(read):
    """Every document without the lines of repeated windows."""
    return line_windows.deduplicated(read("documents").select("doc_id", "text"), count=True)


@query("op9_bootstrapped_pii")
def _(read):
    """Base and contextual spans of every document."""
    return bootstrap_pii.spans(read("documents"))


@query("op10_learned_partitions")
def _(read):
    """The 20 nearest rows of each query, a row whose vec_id 20 divides."""
    return learned_partitions.self_search(read("embeddings"), every=20, k=20)


@query("op1_edited_token_counts")
def _(read):
    """Token counts of every document before and after its revision, from its segment tree."""
    path = vocabulary("byte_bpe_50k.json")
    made = token_counts.revise(token_counts.grow(token_counts.house_edits(read("documents")), path), path)
    return made.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_encoded")


@query("op11_merkle_manifest", twins.MERKLE)
def _(read):
    """Manifest of all documents, checked against the altered copy."""
    return merkle.audited(read("documents"))


@query("op12_bit_sliced_resampling", twins.RESAMPLING)
def _(read):
    """A quarter of the documents, drawn towards the benchmark's features."""
    return resampling.resampled(read("documents"), read("benchmark"))


@query("op13_recurrent_language")
def _(read):
    """Language of every document by the bidirectional recurrent network."""
    return language.identified(read("documents"))
