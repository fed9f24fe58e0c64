"""The training-data pipeline: five stages over documents, each by one operator of ``postrank.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the
columns of documents; the last one returns token ids. :func:`run` writes each stage's rows as Parquet in
the shared folder and reads them back for the next. A stage first takes back what the operators before it
have sent to the executors.

Missing and empty texts, ties, repeated rows and empty tables are rows like others: every stage says what it does with
them. Columns beyond those of documents are left out; a table without one of these is an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrank.llm import byte_bpe, decontam, jaccard_join, pii, toxicity
from postrank.llm.common import documents, in_held_out_fold, quoted, read, release, small, small_batches, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in DOCUMENT])


def _begin(spark: SparkSession) -> None:
    release()
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Labels are read for training folds only.

    Every row is judged by its own text: repeated rows stay or go together, a missing or empty text scores the share of
    toxic labels and stays unless that reaches the threshold. Without labels of both kinds nothing is learned."""
    _begin(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~in_held_out_fold(F.col("doc_id")))
    return _documents(toxicity.score(docs, model).where(F.col("predicted") == 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles: the one of the smallest doc_id.

    Rows are told apart by id and shingle set, so rows that only share an id all stay, and of linked rows without an id
    one stays if none of its group has an id. Of rows with the same id and set the one of the smallest
    digest stays. Documents without words stay. Only texts of repeated or missing ids are looked at again;
    the others go by ids, and are shuffled only if the ids to leave out are too many for a broadcast.
    """
    _begin(spark)
    found = written(jaccard_join.linked(docs), "linked")
    chosen = written(found.where(F.col("sid").isNotNull()).groupBy("comp")
                     .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("x"))
                     .select(F.col("x.doc_id").alias("chosen"), F.col("x.sid").alias("set")), "chosen")
    is_chosen = F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("sid") == F.col("set"))
    stays = F.col("sid").isNull() | F.col("set").isNotNull()
    ids = written(found.join(chosen, is_chosen, "left").where(F.col("doc_id").isNotNull())
                  .groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays")), "ids")
    repeated = small(ids.where(F.col("stays") & (F.col("n") > 1)).select("doc_id"))
    looked_at = small(ids.where(~F.col("stays") | (F.col("n") > 1)).select("doc_id"))
    single = docs.where(F.col("doc_id").isNotNull()).join(looked_at, "doc_id", "left_anti")
    rest = docs.join(repeated, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    rest = written(jaccard_join.with_set_ids(_documents(rest)), "repeated")
    return (_documents(single).unionByName(_documents(rest.where(F.col("sid").isNull())))
            .unionByName(_once(rest.join(chosen, is_chosen, "left_semi"))))


def _once(rows: DataFrame) -> DataFrame:
    """One of the rows with the same id and set."""
    digest = F.xxhash64("text", "lang", "source", "n_chars")
    one = F.min_by(F.struct(*[quoted(c) for c in DOCUMENT]), digest)
    return _documents(rows.groupBy(F.col("doc_id").alias("id"), "sid").agg(one.alias("row")).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't cover beyond the limit. A text without words, a missing or an empty one
    is clean and stays, repeated rows stay or go together, and an empty benchmark leaves all."""
    _begin(spark)
    found = decontam.hits(docs, read(spark, sf_dir, "benchmark"))
    return _documents(found.where(~F.col("contaminated")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their spans of personal data replaced; n_chars follows the text. A missing text stays
    missing with its n_chars, an empty one empty; repeated rows all stay."""
    _begin(spark)
    out = pii.find(docs, redact=True)
    return _documents(out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))
                                     .otherwise(F.col("n_chars"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian 32-bit integers, with whether decoding them gives the text's bytes again. A missing or
    empty text has none; repeated rows each get theirs. The decoded bytes are compared by their SHA-256, so that texts
    need not be held and shuffled beside their words' numbers."""
    _begin(spark)
    vocabulary = byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
                                     public_tokenizers.PATTERN)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", "text", "lang", "source", F.sha2(body, 256).alias("digest"))
    out = byte_bpe.round_trip(texts, vocabulary, keep=["doc_id", "lang", "source", "digest"])
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      "ids", (F.sha2("bytes", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # a learned classifier and BPE have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
