"""The corpus pipeline: five stages over ``documents``, each calling one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last keep the columns of documents; decisions take
effect: rejected documents go and template lines with them, one document of each near-duplicate
group stays, contaminated documents go, personal data is masked, and what is left is packed.

No stage is whole in SQL (fingerprint groups, graph scores, ids of a tokenizer), so ORACLE_SQL is
None; the tests hold every stage against brute force.
"""

from pyspark.sql import DataFrame, SparkSession

from airwise.llm import decontam, line_quality, packing, pii_bootstrap, simhash_golay
from airwise.llm.common import scratch_path
from airwise.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_golay.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_bootstrap.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("pii", personal_data), ("best-fit packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
