"""The training-data pipeline: rejects poor documents, keeps one of each group of near duplicates, takes out
documents that hold benchmark items, mixes domains to target weights, and deals the rest into shards.

Each stage takes the table the one before has written and returns a table; all but the last return the columns
of `documents`, whatever other columns those are. Decisions are on rows: of rows that share an id or have none, each
goes or stays for itself. Empty tables give empty tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import decontaminate, minhash, mixing, quality, sharding
from trafficlens.llm.parameters import DOMAINS, MIX, SHARDS
from trafficlens.llm.row_ids import unique_ids, with_row_ids
from trafficlens.session import written

# Rejected rows up to which their ids are broadcast (8 bytes each); beyond, documents are dealt by id.
BROADCAST_IDS = 2_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aside(docs: DataFrame):
    """`docs` with columns that no operator's own can clash with, and the way back to the given names."""
    names = [c if c in ("doc_id", "text") else f"_given_{i}" for i, c in enumerate(docs.columns)]
    back = lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return docs.toDF(*names), back


def _with_row_id(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, which tells rows apart: the id, or a number where ids repeat or are null."""
    if unique_ids(docs, "doc_id"):
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    return with_row_ids(docs)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` (with `_row`) but those whose `_row` is in `rows`."""
    rows = written(rows.select("_row").distinct(), "rejected-rows")
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, "_row", "left_anti").drop("_row")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least the classifier's threshold stay."""
    docs, back = _aside(docs)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return back(quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id stays (where ids repeat, one of its documents)."""
    docs, back = _aside(docs)
    keyed = _with_row_id(docs)
    classes = minhash.near_duplicates(keyed, id_col="_row")
    others = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_row"))
    return back(_without(keyed, others))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs, back = _aside(docs)
    keyed = _with_row_id(docs)
    found = decontaminate.contaminated(keyed, _table(spark, sf_dir, "benchmark"), id_col="_row")
    return back(_without(keyed, found.select(F.col("doc_id").alias("_row"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs, back = _aside(docs)
    mixed = mixing.mixed(docs, _table(spark, sf_dir, "labels"), DOMAINS, [MIX[d] for d in DOMAINS])
    taken = mixed.where("copies > 0")
    return back(taken.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: `doc_id, size, text_crc32, law, shard, slot, grown_shard`."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

# The classifier, its neighbours and the fitted rates cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
