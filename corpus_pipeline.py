"""From raw documents to packed training sequences, in stages that each work on the whole table that the stage before kept.

run() writes every stage's result as Parquet in the shared folder and reads it back, so that a stage is not computed twice and
survives the loss of executors. All stages but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty result; further columns are passed on by all stages but the last, whatever
their names; texts are whole, however long. Rows with a null id take part: they are never copies of anything, and are sampled and
packed as one id. Rows that repeat id and text are one row from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesmith.llm import jaccard_join, mixing, packing, pii, quality_model
from linesmith.llm.queries import GRADE, N_WORDS, TARGETS, mixing_dims
from linesmith.llm.shared import prepare, stored

#: The learned selection works here by the tail of grade 2: good and not toxic.
TAIL, LEAST = 2, 0.5
#: The longest list of ids (with two flags) that is broadcast; a longer one is shuffled with the documents.
MARKS = 1_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the best grade stay; the model is fitted on the rated ones among the stage's own input.

    Null, empty and wordless texts go; without ratings all others stay. A document at the limit of 0.5 stays.
    """
    prepare(spark)
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE))
    return quality_model.select_documents(docs, model, TAIL, LEAST)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the document with the smallest id stays; rows that repeat id and text count once.

    Null and empty texts are copies of nothing. If several texts of a group have the smallest id, all of these stay. If an id has
    several texts, those that are copies of a smaller id go and the others stay.
    """
    prepare(spark)
    joined = jaccard_join.jaccard_join(docs, words=5, percent=80, marks=True)
    copies = stored(joined.where("component_id <> doc_id").select("doc_id", "mark_a", "mark_b"))
    # Only ids that come twice need their texts compared; all other rows are kept or dropped by their id alone.
    twice = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    marks = stored(copies.select("doc_id").distinct().withColumn("__drop", F.lit(True)).join(twice.withColumn("__twice", F.lit(True)), "doc_id", "full_outer"))
    marks = F.broadcast(marks) if marks.count() <= MARKS else marks
    marked = docs.withColumn("__id", F.col("doc_id")).join(marks.withColumnRenamed("doc_id", "__id"), "__id", "left")
    once = marked.where("__twice IS NULL AND __drop IS NULL AND doc_id IS NOT NULL").select(*docs.columns)
    again = marked.where("__twice IS NOT NULL OR doc_id IS NULL").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    mixed = marked.where("__twice AND __drop AND text IS NOT NULL").select("doc_id", "text").distinct()
    gone = jaccard_join.set_marks(mixed, words=5).join(copies, ["doc_id", "mark_a", "mark_b"], "left_semi").select("doc_id", "text")
    return once.unionByName(again.join(gone, ["doc_id", "text"], "left_anti").select(*docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. Null and empty texts stay as they are."""
    prepare(spark)
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the target shares of sources, languages and topics.

    A null source or language is a value of its own; languages that are not in the targets go, as do texts without words.
    """
    return mixing.sample_mixture(docs, F.expr(N_WORDS), mixing_dims(), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences; those without words have a row without a place. Ties go by id and piece."""
    prepare(spark)
    return packing.pack_documents(docs, F.expr(N_WORDS), spread=F.col("text"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]
#: SQL has no form of the classifier, the random field or the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i < len(STAGES) else docs
    return docs
