"""The corpus pipeline: stages over documents, each written and read again.

Every stage keeps the columns of documents and works on all rows its predecessor kept;
the last one adds the pieces of each text. Column ``n_chars`` stays what it was: the
length of the text as it came.
"""

import public_tokenizers

from querylume.llm import fm_index, pieces, simhash, suffix_dedup, toxicity
from querylume.llm.common import written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHINGLE, MAX_BITS = 3, 3


def drop_toxic(spark, docs, sf_dir):
    """Documents predicted toxic go; the labels of the held-out fold are not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return simhash.one_of_each(docs, SHINGLE, MAX_BITS)


def cut_repeats(spark, docs, sf_dir):
    """Strings of 200 bytes that occur more than once go, wherever they occur."""
    return suffix_dedup.without_repeats(docs)


def cut_benchmark(spark, docs, sf_dir):
    """Passages of the benchmark are cut from the texts."""
    return fm_index.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def add_pieces(spark, docs, sf_dir):
    """The pieces of each text, and whether they decode to it."""
    return pieces.encoded(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near duplicates", drop_near_duplicates),
    ("suffix dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("sentencepiece", add_pieces),
]
# Neither a learnt score nor XXH64 can be written in SQL; tests hold every stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The documents that all stages leave, with their pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
