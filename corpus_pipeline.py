"""The corpus pipeline: language ID, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows to the shared
folder and rereads them as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.llm import language, neardup, packing, pii
from crosstide.llm._common import discard_since, mark, table, written
from crosstide.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows without an id of their own get ids from here on, above those of the table.
FIRST_KEY = 1 << 62
#: Ids that are broadcast at most: 16 bytes each.
SMALL_SIDE = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the dictionaries come from the labelled ones among docs.

    Texts that are null or without letters and texts with a narrow margin go. A null
    lang becomes the predicted one, labels stay. Rows that repeat each stay; an
    empty table, and one without any label, gives no rows. Other columns are ignored.
    """
    learned = language.learn(docs, F.lit(True))
    found = language.identify(docs, learned, keep=COLUMNS[1:]).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of smallest id.

    A row whose id is null or occurs more than once is judged by its text: it gets a
    key from its id and text, after all single ids. So equal rows leave one row, and
    rows that share an id but not their text are kept or dropped each for itself.
    Texts without words are in no group and stay. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(*COLUMNS)
    # Ids alone are shuffled to find those that are not unique, mostly few; beyond SMALL_SIDE of them the join shuffles.
    several = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").select("doc_id", F.lit(True).alias("_several")), "several")
    several = F.broadcast(several) if several.count() <= SMALL_SIDE else several
    marked = rows.join(several, rows["doc_id"].eqNullSafe(several["doc_id"]), "left").drop(several["doc_id"])
    own = F.lit(FIRST_KEY) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3)
    keyed = marked.withColumn("_key", F.when(F.coalesce("_several", F.lit(False)), own).otherwise(F.col("doc_id")))
    found = neardup.near_duplicates(keyed.select("_key", "text"), id_col="_key")
    dropped = found.where(~F.col("kept")).select("_key").distinct()
    kept = keyed.join(dropped, "_key", "left_anti")
    single, shared = kept.where("_several is null"), kept.where("_several")
    first = F.row_number().over(Window.partitionBy("_key").orderBy("lang", "source", "n_chars"))
    return single.select(*COLUMNS).unionByName(shared.withColumn("_k", first).where("_k = 1").select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the length of the new text.

    A null text stays null, with a null length; rows that repeat each stay and get equal
    surrogates; an empty table gives no rows; other columns are ignored.
    """
    made = pii.anonymise(docs, pii.DEMONSTRATION_KEY, keep=("lang", "source"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null or empty text is one piece of one id; rows that repeat are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the compression classifier nor the surrogates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard_since(start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
