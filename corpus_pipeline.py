"""The corpus pipeline: each stage works on all documents that the one before it kept.

Toxicity drops the documents that the model rejects; exact dedup keeps one of equal
texts; near dedup keeps one document of each group of near copies; decontamination
drops documents that hold benchmark windows; byte-level BPE encodes and decodes what
is left. All but the last return the columns of ``documents``.

Each stage decides every row by its own text, whatever its doc_id. A null text is empty:
it is never toxic by more than the labels' share, equal to other empty texts, near to
none, and never contaminated. Of equal texts the row with the largest doc_id stays (a null
id is below all others), of near copies that with the smallest (a null id is above all
others); of rows that repeat id and text one stays. Without labels nothing is toxic, an
empty benchmark contaminates nothing, and an empty table gives an empty result. Extra
columns pass all stages but the last.
"""

from __future__ import annotations

from pulseframe.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from pulseframe.llm.common import Scratch, small_batches, table


def drop_toxic(spark, docs, sf_dir):
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    small_batches(spark)
    return minhash.drop_near_copies(docs)


def drop_contaminated(spark, docs, sf_dir):
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    small_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: A learned model decides in the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{at}_{name}")
        if at:
            scratch.drop(f"{at - 1}_{STAGES[at - 1][0]}")
    return docs
