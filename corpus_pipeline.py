"""Training-corpus pipeline: STAGES over the table ``documents``.

Each stage reads what its predecessor wrote and calls one operator of
``netsleuth.llm``; all but the last return the columns of ``documents``.
``ORACLE_SQL`` is None: language identification, Golay-keyed components and
token packing have no SQL form, so the tests compare stages with brute force.
"""

from __future__ import annotations

import public_tokenizers

from netsleuth.llm import langid, packing, quality, simhash, sufarray
from netsleuth.llm.util import settle

#: Shared passages of over 50 words are some 290 bytes and more: strings of
#: this length and grams that find them (op10's 400 bytes would keep half).
PASSAGE_BYTES, PASSAGE_GRAM = 240, 96


def language_id(spark, docs, sf_dir):
    """Documents whose language the classifier accepts.  The model is fitted
    on a bounded sample of the labelled, not held-out rows of ``docs``.  Null
    and empty texts go; repeated rows are judged alike."""
    return langid.accepted(docs, langid.fit(docs))


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and do not diverge from the
    references of their language, which are counted over all of ``docs``; a null
    language is one of its own.  Null and empty texts fail the word minimum;
    repeated rows count as often as they stand."""
    return quality.kept_documents(docs, quality.references(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each component of 3-word SimHash at 3 or fewer bits, the
    one of the smallest doc_id.  Null and empty texts form one component;
    repeated rows and components without any id keep one row."""
    return simhash.keep_first_of_groups(docs)


def substring_dedup(spark, docs, sf_dir):
    """Texts without the bytes of ``PASSAGE_BYTES``-byte strings that also start
    elsewhere, all copies alike; ``n_chars`` follows the text.  Null texts stay
    null; repeated rows lose what they share; a text may become empty."""
    return sufarray.without_repeats(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, count_col="n_chars")


def pack(spark, docs, sf_dir):
    """Token pieces of all documents in sequences of at most 1024 tokens.  Null
    and empty texts are one end token; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup),
          ("suffix_array_dedup", substring_dedup), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each stage is stored as Parquet below the
    shared checkpoint folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
