"""From raw documents to packed token windows: the stages in order, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordf.llm import ngram_join, packing, quality_knn, quality_rules, substring_dedup
from arbordf.llm.common import materialize, read_table


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the boosted trees. The trees are fitted on labelled rows of the raw table.

    Null and empty texts have too few words and go. Equal rows fare alike, null doc_ids do not matter, an empty table stays
    empty; without labels the base limits decide alone.
    """
    trees = quality_rules.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_documents(docs, trees)


def drop_by_neighbours(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which their nearest labelled neighbours give a quality of at least 0.3.

    A text without words gets the share of good labels (0.5 without labels). Ties among neighbours go to the smaller doc_id;
    equal rows fare alike, null doc_ids do not matter, an empty table stays empty.
    """
    space = quality_knn.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_knn.keep_documents(docs, space)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8): the smallest doc_id.

    Rows of one doc_id are one document and stay or go together. Texts without words and rows without doc_id stay. An empty
    table stays empty.
    """
    groups = ngram_join.jaccard_groups(docs, k=5, percent=80)
    dropped = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document or place holds.

    Texts are told apart by doc_id and hash; equal rows are one text and stay alike. Null texts and rows without doc_id stay
    as they are. An empty table stays empty.
    """
    return substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their window and offset.

    A null or empty text is a piece of one token; every row is packed on its own, null doc_ids stay null; an empty table has
    no pieces. 1 MB of texts is encoded at once: executors' heaps have grown by now and leave workers less memory.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, block_chars=1 << 20)


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_neighbours),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: The stages fit models and tokenise: no SQL can express them. tests/llm/test_pipeline.py compares the rows of run() and of
#: every stage with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
