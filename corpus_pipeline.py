"""Raw documents to token shards: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm._store import Scratch
from keystrata.llm.decontam import drop_contaminated
from keystrata.llm.mixing import curriculum, mix
from keystrata.llm.near_dedup import near_duplicates
from keystrata.llm.quality import judge
from keystrata.llm.queries import default_tokenizer, fresh_folder, table
from keystrata.llm.tokens import read_token_shards, write_token_shards

#: ``position`` is the place in training order, 0 to 1; null until the sources are mixed.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "position"]
#: Near duplicates of the pipeline: five words, similarity 0.8.
SIMILARITY_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that failed leave the texts of the others, and n_chars follows the text."""
    judged = judge(docs).where("quality.kept").withColumn("text", F.col("quality.clean_text")).withColumn("position", F.lit(None).cast("double"))
    changed = F.col("quality.lost_words") > 0
    return judged.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one whose id is the group's. Repeated rows of it count once."""
    found = near_duplicates(docs, percent=SIMILARITY_PERCENT)
    kept = found.where("kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return rows.select("doc_id", "row.*").union(docs.where("doc_id is null").select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of ten benchmark words go; a row is judged by itself, whatever its id."""
    return drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order (range-sorted by position)."""
    store = Scratch(spark, "mixture")
    rows = store.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    placed = curriculum(mix(rows, id_col="row")).select(F.col("id").alias("row"), "position")
    mixed = rows.drop("position").join(placed, "row")
    return mixed.repartitionByRange("position", "row").sortWithinPartitions("position", "row").select(COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, in its training order; the result lists what was read back from them."""
    path = fresh_folder(spark, "pipeline-shards")
    write_token_shards(docs, path, default_tokenizer(), end_id=2, order_col="position")
    return read_token_shards(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token output", token_output),
]
#: Signatures and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
