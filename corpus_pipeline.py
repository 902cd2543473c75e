"""The corpus pipeline: raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents.  All but the last return the documents' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellflux.llm.decontaminate import contamination
from cellflux.llm.exact_dedup import keep_one
from cellflux.llm.jaccard_join import keep_least
from cellflux.llm.language import UND, identify, train
from cellflux.llm.packing import best_fit
from cellflux.llm.shared import fresh, written
from cellflux.llm.token_counts import token_counts

#: A text goes where its words' own greatest posteriors are hardly above what chance gives, 1 / languages:
#: no learned language holds them.  Texts that switch languages stay.
OVER_CHANCE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters (null and empty texts among them) or
    without evidence for any language go.  Repeated rows are judged each; an empty table stays empty."""
    lang, score, sure = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "sure")
    model = train(docs)
    found = identify(docs, model, lang_name=lang, score_name=score, sure_name=sure)
    least = OVER_CHANCE / max(2, len(model.languages))
    return found.where((F.col(lang) != UND) & (F.col(sure) >= least)).drop(lang, score, sure)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that with the largest id; null and empty texts are equal, and
    one row of those that repeat id and text stays."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 0.8 of five-word shingles, that with the least id.  Texts without
    words link with nothing and stay; so does one row of a group without ids."""
    return keep_least(docs, size=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words, or a whole shorter item, of the benchmark.  Null and
    empty texts have none; repeated rows go or stay together."""
    mark = fresh(docs, "contamination")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), result=mark, drop_hit=True).drop(mark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of several lengths; a document without tokens has
    one row without a bin, repeated rows are packed each."""
    import public_tokenizers

    # written first: a task that counts and packs would hold two workers, which executors keep for later stages
    counted = written(token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))), "tokens")
    return best_fit(counted, "doc_id", "n_tokens")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Language by a trained model and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
