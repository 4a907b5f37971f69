"""The training-data pipeline: toxicity, line dedup, near-dedup, mixing, encoding. Part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm import bpe, line_dedup, minhash, mixing, toxicity
from siftframe.llm.common import fresh, materialize, table
from siftframe.llm.queries import vocabulary


#: A line of a document is boilerplate if over so much of its source's documents, and at least so many, carry it.
LINE_RATIO, LINE_LEAST = 0.01, 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of sf_dir, does not find toxic.

    Null and empty texts score the classifier's bias, which is far under the threshold, and stay; repeated rows stay or
    go together; an empty table stays empty; columns stay as they are, whatever their names."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a hundredth of their source's documents carry (a source stands for a host),
    and without passages: lines of 50 words or more that several otherwise unlike documents carry, wherever they are
    from. n_chars, where a line went, is the length of the new text.

    No document goes: one that would be left empty stays whole. A null source is one of its own; null and empty texts
    have no lines; repeated rows and equal texts count once and are treated alike; an empty table stays empty. Other
    columns stay as they are, whatever their names."""
    first, second = fresh(docs, "_lines_gone"), fresh(docs, "_passages_gone")
    out = line_dedup.drop_boilerplate(docs, F.col("source"), ratio=LINE_RATIO, least=LINE_LEAST, dropped=first)
    out = line_dedup.drop_passages(materialize(out, "lines"), dropped=second)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(first) + F.col(second) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; of rows with that id, and in groups
    where every id is null, the first in the scan. Null and empty texts all stay; an empty table stays empty; columns
    stay as they are, whatever their names."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: a document may come out twice or three times, or not.

    Null and empty texts have no words and are copied at their source's rate; a null source is one of its own; rows with
    one id decide alike, and of those without an id by their text; an empty table stays empty; columns stay as they are,
    whatever their names."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row: its token ids and the digest of the bytes they decode to.

    Null and empty texts have no ids; a null id stays null; repeated rows come out as often as they go in; an empty table
    stays empty; other columns are not read."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic), ("line_dedup", drop_lines), ("minhash", one_of_each_group), ("mixing", mix_sources), ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The classifier and the similarity components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
