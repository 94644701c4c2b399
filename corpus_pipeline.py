"""From raw documents to packed sequences, in five stages.

Each stage takes all that its predecessor kept. ``run`` writes every stage's
result as Parquet to the shared scratch folder and reads it again; what a stage
wrote besides, and what its successor has read, is deleted then.
"""

from __future__ import annotations

from meshwork.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from meshwork.llm.catalog import tokenizer_path
from meshwork.llm.common import table
from meshwork.runtime import discard, materialise, scratch_scope


def quality_stage(spark, docs, sf_dir):
    """Operator 4: documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark, docs, sf_dir):
    """Operator 1: lines that are boilerplate of their source go."""
    return line_dedup.clean_documents(docs)


def near_stage(spark, docs, sf_dir):
    """Operator 6: one document of each group of near duplicates stays."""
    return near_dedup.keep_one(docs)


def mix_stage(spark, docs, sf_dir):
    """Operator 5: documents are repeated or left out to meet the sources' targets."""
    return mixing.repeat_documents(docs)


def pack_stage(spark, docs, sf_dir):
    """Operator 8: all tokens in sequences of one length."""
    return packing.packed_digests(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Tokens and hashes are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, []) as keep:
            keep.append(materialise(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = keep[0]
    return docs
