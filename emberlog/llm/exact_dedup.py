"""Exact deduplication: 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, key_bitmap, materialise, may_contain, parted


def _hashed(docs: DataFrame, own: Column, text_col: str, hash_bytes: int) -> DataFrame:
    """A column of ``docs`` with ``norm``, the normalised text, and ``h``, its hash."""
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(own, norm.alias("norm")).withColumn("h", F.expr(f"substring(unhex(md5(norm)), 1, {int(hash_bytes)})"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """The rows of ``docs``, of each group of equal texts (as for ``exact_dedup``) the one with the largest id, null only if all are; of rows that repeat that id, the largest by the other columns in their order.

    The hash is counted first. Rows whose hash occurs once (for certain, by a bitmap of fixed size)
    are not moved; the others are grouped by hash and text, partial groups first. No row needs a
    key, and ``docs`` is read three times; give a table.
    """
    names = docs.columns
    texts = _hashed(docs, F.struct(F.col(id_col).alias("id"), F.struct(*names).alias("row")).alias("own"), text_col, hash_bytes)
    again = texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    several, single = parted(texts, "h", key_bitmap(again, "h"))
    kept = several.groupBy("h", "norm").agg(F.max("own").alias("own"))
    return single.select("own.row.*").unionByName(kept.select("own.row.*"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_bytes: int = 16) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text).

    Texts are equal when their bytes are, after lower-casing A-Z. ``keep`` says which id of a group
    stays, "max" or "min". Only DataFrame functions run. The hash is counted first, so that text
    moves only for rows whose hash occurs twice (found by a bitmap of fixed size); those are
    grouped by hash and text, partial groups first, so copies never meet in one task. Rows with a
    hash of several texts, which ``hash_bytes`` below 16 can force, are matched by their text.

    Null and empty text are equal. A null id is never the smallest or largest unless all of the
    group are null. Rows that repeat an id share its decision. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    best = {"max": F.max, "min": F.min}[keep]
    texts = _hashed(docs, F.col(id_col).alias("id"), text_col, hash_bytes)
    keyed = materialise(texts.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "keyed")

    again = keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    candidates = may_contain(texts, "h", key_bitmap(again, "h"))
    classes = candidates.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = materialise(classes.select("h", F.unhex(F.sha2("norm", 256)).alias("class_sha"), "keep_id", "group_size"), "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")

    out = keyed
    if several.isEmpty():
        joined = out.join(classes.where("group_size > 1").select("h", "keep_id", "group_size"), "h", "left")
    else:
        plain = out.join(several, "h", "left_anti").join(classes.where("group_size > 1").select("h", "keep_id", "group_size"), "h", "left")
        shared = texts.join(several, "h", "left_semi")
        own = shared.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = shared.join(own, ["h", "norm"]).select("h", "id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
        joined = plain.unionByName(apart)
    group = F.coalesce("group_size", F.lit(1).cast("long"))
    keep_id = F.when(group > 1, F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        group.alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
