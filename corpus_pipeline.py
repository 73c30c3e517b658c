"""Corpus pipeline: documents to token files, one written stage after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. :func:`run` writes each result as
Parquet in the shared folder and gives the reread table to the next stage,
so a lost executor never reaches back over a stage.

1. toxicity: documents with an expected severity at or above the operator's
   threshold go; the model is fitted on the labelled rows of ``labels``;
2. near-duplicates: one document of each SimHash component stays;
3. decontamination: documents with a verified overlap with ``benchmark`` go;
4. mixing: sources are brought to their target weights, a row repeated as
   often as the mix takes it;
5. token ids: token files are written and every document is read back.

Null texts pass the first and third stage, form one near-duplicate group in
the second, have size 0 in the mix and only the end id in the files. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import decontaminate, mixing, simhash, token_ids, toxicity
from loanlens.llm.common import staged, table

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    verdict = toxicity.severity(model)(F.col("text"))["expected_severity"]
    return docs.filter(verdict < toxicity.REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_ids.tokens_of(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: Fitting, fingerprints and tokenizing can't be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
