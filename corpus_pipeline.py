"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it again. A stage decides about
all rows first and writes its decisions; of what else it wrote, only its copy of the rows stays. All but
the last return the columns of ``documents``. Decisions belong to rows, not ids: a stage gives each
row a key first where others depend on it, so that rows with a null or repeated doc_id are judged like
any other. Whole rows are never joined with decisions about all of them: a bitmap of fixed size tells which
rows may be named, and the others pass as they are. Columns other
than those of ``documents`` are left out, whatever their names. An empty table gives no rows at every
stage. Ties are settled by doc_id, null after all others, and among rows of one doc_id by the other columns
(exact copies) or the row's key. ``docs`` is read more than once, so it should be a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, langid, minhash, packing, secrets
from emberlog.llm.common import discard, discard_since, key_bitmap, materialise, parted, read_table, written_so_far
from emberlog.llm.queries import PACK_TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A worker goes from stage to stage, so its stores of tokenised parts are smaller than those of the packing query and end with the task.
STORE_BYTES = 32 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``row``, a key of each row, written so that it stays the same."""
    return materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def decided(rows: DataFrame, decision: DataFrame, mark: int) -> DataFrame:
    """What a stage decided about ``rows``, written; of what it wrote since ``mark``, only that and the rows stay."""
    out = materialise(decision, "decided")
    discard_since(rows.sparkSession, mark, rows, out)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null or empty text, or no letters. The model is learned from all labelled rows; without any, all go. Very long texts are read whole, repeated rows share their fate."""
    model = langid.fit(docs, F.lit(True))
    return langid.language_id(docs, model, also=COLUMNS[1:]).where("lang_pred <> 'und'").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, lower-cased A-Z: with the largest doc_id, null only if all are; of rows that repeat an id, one."""
    return exact_dedup.one_of_each(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five words, similarity of 0.8 or more): with the smallest doc_id, null only if all are. Texts without words are linked with nothing and stay."""
    mark = written_so_far()
    rows = keyed(docs)
    found = minhash.near_duplicates(rows, width=5, percent=80, id_col="row").select("row", "component_id")
    members = materialise(found.join(rows.select("row", "doc_id"), "row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = decided(rows, members.join(first, "component_id").where("row <> first.row").select("row"), mark)
    named, plain = parted(rows, "row", key_bitmap(dropped, "row", written=True))
    return plain.unionByName(named.join(dropped, "row", "left_anti")).select(*COLUMNS)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask live-looking secrets that few owners share; all documents stay, and n_chars follows the text where it changed. Null text stays null; each row is masked by its own spans, whatever its id."""
    mark = written_so_far()
    rows = keyed(docs)
    found = secrets.secret_scan(rows, id_col="row", repository=F.col("doc_id")).select("row", "secrets").where(F.exists("secrets", lambda s: s["verdict"] == "live"))
    live = decided(rows, found, mark)
    named, plain = parted(rows, "row", key_bitmap(live, "row", written=True))
    text = F.when(F.col("secrets").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("secrets")))
    masked = named.join(live, "row", "left").select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("secrets").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))
    return plain.select(*COLUMNS).unionByName(masked)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 4096 tokens; null text is one piece of the end id, and repeated rows are packed each."""
    return packing.pack_documents(docs, PACK_TOKENIZER, store_bytes=STORE_BYTES, keep_store=False)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("secret scans", secret), ("best-fit packing", pack)]

#: No SQL expresses the tokenizer or the language model; tests/llm hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written_so_far()
        kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        # what a stage wrote on its way, and the result before it, serve nobody now
        discard_since(spark, mark, kept)
        if name != STAGES[0][0]:
            discard(docs)
        docs = kept
    return docs
