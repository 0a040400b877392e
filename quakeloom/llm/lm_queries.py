"""The registered query of language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixtree
from .common import table


def op12_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a tree of those that aren't held out: the crc32 of the id, as text, modulo 5 is not 1."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    corpus = suffixtree.read_corpus(table(spark, sf_dir, "documents"), held_out)
    return suffixtree.score(corpus, suffixtree.train(corpus))
