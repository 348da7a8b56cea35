"""Queries ``opN_<name>`` over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.llm import bpe, convtrie, decontam, divergence, fingerprint, langid, lmscore, oracle, packing, quality, simhash, spans, sufarray, warc
from netsleuth.session import scratch_path

QUERIES: dict = {}
ORACLE: dict = dict(oracle.ORACLE)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash_components(spark, sf_dir):
    """Components of ``documents`` under 3-word SimHash at 3 or fewer bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents")).drop("_rid")


@query
def op4_best_fit_packing(spark, sf_dir):
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    import public_tokenizers
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_bpe_round_trip(spark, sf_dir):
    """Every whole text of ``documents`` encoded and decoded, as digests."""
    import public_tokenizers
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op2_language_id(spark, sf_dir):
    """Language of every whole text of ``documents``, learned without the
    held-out fifth of the rows."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op3_quality_rules(spark, sf_dir):
    """Base counts and verdict of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, quality.references(docs))
    return found.select("*", *[F.round(c, 9).alias(f"{c}_") for c in ("char_distance", "word_distance")]) \
        .drop("char_distance", "word_distance").withColumnsRenamed({"char_distance_": "char_distance", "word_distance_": "word_distance"})


@query
def op1_warc_round_trip(spark, sf_dir):
    """Every row of ``pages`` written as a WARC record and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    chunks = warc.read_chunks(spark, path, with_chunks=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_fingerprints(spark, sf_dir):
    """Digests of every whole text of ``documents``, of its edited text, and
    their likeness to each other and to the next document."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark, sf_dir):
    """Every whole text of ``documents`` without the bytes of 400-byte strings
    that also start elsewhere, as digests."""
    return sufarray.dedup_digests(table(spark, sf_dir, "documents")).drop("cuts")


@query
def op7_lm_cross_entropy(spark, sf_dir):
    """Cross-entropy difference of every whole text of ``documents``; the
    target corpus are the documents labelled as of good quality."""
    labels = table(spark, sf_dir, "labels")
    return lmscore.score(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))


@query
def op8_sentence_spans(spark, sf_dir):
    """Every whole text of ``documents`` without the sentences of repeated
    runs that are not their first occurrence, as digests."""
    found = spans.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"),
                        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op11_source_divergence(spark, sf_dir):
    """Divergence of the sources of each language of ``documents``, pair by
    pair, and each source's most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_benchmark_decontamination(spark, sf_dir):
    """Words of every whole text of ``documents`` that lie in 10-word windows
    of ``benchmark`` items, and the items."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversation_trie(spark, sf_dir):
    """Prefix trie of ``conversations``, rebuilt with shared first turns."""
    turns = convtrie.rebuilt(convtrie.numbered_turns(table(spark, sf_dir, "conversations")))
    return convtrie.prefix_trie(turns).drop("digest")
