"""The corpus pipeline: quality rules, exact, near and suffix-array deduplication, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
documents.  Rows are identified by their id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import exact, packing, rules, similar, suffix
from trailmark.llm.common import NULL_ID, read, scratch, written

#: Bytes of a repeated string that suffix dedup looks for, and words of a run that goes: passages of 50 words and more, which
#: are 200 bytes long but for one in a hundred.  Shorter repeats are common phrases.
WINDOW, GRAM, WORDS = 200, 32, 50
#: Pieces that a Python worker remembers while it encodes: workers go on to other stages with what they hold.
REMEMBERED = 100_000


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decided`` (doc_id, rk) has."""
    wanted = decided.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("own_id"), F.col("rk").alias("own_rk")).distinct()
    marks = [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("own_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("own_rk"),
    ]
    named = docs.select(*marks, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return named.join(wanted, ["own_id", "own_rk"], "left_semi")


def _rows(kept: DataFrame) -> DataFrame:
    return kept.select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules (null, empty and wordless texts do) or a cutoff of their language.

    Rows are judged one by one, so repeated rows stay or go together; a null id is judged like any other.  No rows: none.
    """
    return _rows(_keep(docs, rules.judge(docs, read(spark, sf_dir, "labels")).where("kept")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, a null id being larger than any; of rows with one id and text, one.

    Null and empty texts are equal.  No rows: none.
    """
    kept = _keep(docs, exact.exact_groups(docs).where("kept"))
    return _rows(kept.dropDuplicates(["own_id", "own_rk"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id stays.

    A null id is larger than any; of rows of one id the text of least hash stays.  Null, empty and blank texts are one group; a text
    of fewer than five words is one shingle.  Rows with one id and text stay or go together.  No rows: none.
    """
    found = similar.similar_documents(docs)
    own = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("rk"))
    first = found.groupBy("component").agg(F.min(own).alias("first")).select("first.*")
    return _rows(_keep(docs, written(first, "first")))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the runs of WORDS words or more in which each string of WINDOW bytes stands elsewhere too; characters
    cut at an edge go; null texts become empty ones, and empty ones stay.  Repeated rows count as places of their own.  No rows: none."""
    rest = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    cut = suffix.dedup_substrings(docs, WINDOW, GRAM, carry=rest, least_words=WORDS)

    def text_of(batches):
        import pyarrow as pa

        for b in batches:
            texts = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("carry")], names=["text", "carry"])

    schema = cut.select(F.lit("").alias("text"), "carry").schema
    out = cut.select("kept", "carry").mapInArrow(text_of, schema)
    columns = [F.col("text") if c == "text" else F.col(f"carry.`{c}`").alias(c) for c in docs.columns]
    out = out.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone.  Repeated rows are packed as often as they stand, null ids with a null doc_id; pieces of equal
    length may go to any sequence that has the room.  No rows: none.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Block naming, SimHash, string removal and packing are beyond SQL: tests/llm hold the pipeline against brute force.
ORACLE_SQL = None
