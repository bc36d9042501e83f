"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, linededup, mixing, neardup, packing
from tessera.llm.common import cut


#: What the operators read; other columns of the documents travel in one struct, so that no name of theirs can meet one that an operator adds.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def held(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c not in READ]
    return docs.select(*(c for c in docs.columns if c in READ), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []))


def given(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from what a stage made of held(docs)."""
    return out.select(*(c if c in READ else F.col("_rest").getField(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts and texts without a letter go."""
    return given(langid.known_language(held(docs), langid.fit(docs)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    out = linededup.drop_boilerplate(held(docs), "source", "text").withColumn("n_chars", F.length("text").cast("long"))
    return given(out, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies, by 5-word shingles at a similarity of 0.8; rows without a doc_id all. Of rows that repeat a doc_id
    the shortest stays, of equally short ones the first by text."""
    copies = neardup.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    own = held(docs)
    named = own.filter("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_chars", "text"))
    return given(named.withColumn("_row", row).filter("_row = 1").drop("_row").unionByName(own.filter("doc_id IS NULL")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture of sources."""
    return given(mixing.mix(held(docs)).orderBy("position"), docs)


def in_written_order(docs: DataFrame) -> DataFrame:
    """Adds _place: by the number of a row's file and its place in the file, which tell the order that the rows were written in however they are read again.
    Rows that don't come from files have the order of the DataFrame."""
    name = F.col("_metadata.file_name")
    number = [F.coalesce(F.when(name.rlike(p), F.regexp_extract(name, p, 1).cast("long")), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\.")]
    place = F.shiftleft(number[0], 42) + F.shiftleft(number[1], 32) + F.col("_metadata.row_index")
    try:
        return docs.select("*", place.alias("_place"))
    except AnalysisException:
        return docs.withColumn("_place", F.monotonically_increasing_id())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens, numbered in the order of the documents."""
    return packing.pack(in_written_order(docs), place="_place")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The linear models of the first stage and the token ids of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
