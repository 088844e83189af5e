"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, packing.

Every stage takes all that the one before kept, and is written as Parquet to the shared folder and
read again before the next: a lost executor costs no more than the stage it was in.
"""

import public_tokenizers

from podium.llm import decontaminate, packing, quality, simhash
from podium.llm.common import stored, table


def good_quality(spark, docs, sf_dir):
    """Drop documents that the compression classifier scores below its threshold.

    The classifier learns from the labelled rows among ``docs`` that are not held out.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark, docs, sf_dir):
    """Keep one document of each group whose SimHash fingerprints are linked by two bits or fewer."""
    return simhash.one_of_each(docs, shingle=3, bits=2)


def without_benchmark(spark, docs, sf_dir):
    """Cut benchmark passages out; drop documents that are mostly benchmark text."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Pack the tokens of all documents into sequences of 2048; a row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_copies),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

ORACLE_SQL = None  # hashes, automata and compression are beyond SQL; tests/llm has brute force


def run(spark, sf_dir):
    """The pieces of all sequences made of the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
