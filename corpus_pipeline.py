"""The corpus pipeline: stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansift.llm import lines, minhash, mixing, pieces, quality
from plansift.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null, empty and blank texts are among them.

    All columns stay as they are, whatever they are called; repeated rows stay or
    go together; long texts are read whole; an empty table stays empty.
    """
    # a filter on the verdict itself would be merged with the counts and make them anew for each of its terms
    judged = quality.quality(docs).select("row", F.explode(F.array("kept")).alias("stays"))
    return judged.filter("stays").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, however few documents it has; n_chars follows the text.

    A null source is a source of its own, a null text stays null, and repeated
    rows count as documents of their own. Other columns stay as they are,
    whatever they are called; an empty table stays empty.
    """
    found = lines.dedup_lines(docs, "doc_id", F.col("source"), F.col("text"))
    cut = F.col("n_dropped") > 0
    return found.select(*[
        F.when(cut, F.col("kept_text")).otherwise(F.col("row.text")).alias("text") if c == "text"
        else F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
        if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in shuffled order.

    Documents may go or come back several times, that is the mixture; texts are
    carried whole. A null source is a source of its own, rows that share an id
    draw the same count, a null id draws as 'null'. All columns stay as they are,
    whatever they are called; an empty table stays empty.
    """
    return mixing.mix(docs).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Of rows that share an id the first by all columns stays; rows without an id
    all stay. Texts without words are linked with nothing. Columns stay as they
    are, whatever they are called; an empty table stays empty.
    """
    found = minhash.near_duplicates(docs, shingle=5, percent=80).filter("kept and doc_id is not null").select(F.col("doc_id").alias("of")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # the join already brings the rows of an id together, so picking one of them costs no further shuffle
    of = F.col("row")["doc_id"]
    order = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    kept = rows.join(found, of == F.col("of"), "left_semi").select("row", F.row_number().over(Window.partitionBy(of).orderBy(of, *order)).alias("nth"))
    return kept.filter("nth = 1").select("row.*").unionByName(docs.filter("doc_id is null"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts with digests of ids and of the decoded text.

    A null text is the empty text. Rows are encoded one by one, so repeated rows
    give repeated results, ids may be null, and other columns are never looked at;
    an empty table gives no rows.
    """
    return pieces.encode_decode(docs, pieces.public_model(), digest=True).select(
        "doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentence_pieces", sentence_pieces),
]

#: Hash signatures and the tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for step, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if step + 1 < len(STAGES):
            docs = written(docs)
    return docs
