"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import ann, exact_dedup, langid, line_dedup, lm, minhash, packing, pieces, prefix_trie, repair, secrets, slack, suffix
from emberlog.llm.common import read_table
from emberlog.llm.conversation_sql import OP11_SQL, OP12_SQL
from emberlog.llm.digest import ordered_sha256

#: The vocabularies of the packing and the piece query.
PACK_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of this remainder of crc32(doc_id), by divisor, are held out.
LANG_HELD, LM_HELD = (4, 2), (7, 2)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every text and the digest of what they decode to."""
    encoded = pieces.encode(read_table(spark, sf_dir, "documents"), PIECE_MODEL)
    decoded = pieces.decode(encoded, PIECE_MODEL)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.remainder("doc_id", LM_HELD[0]) == LM_HELD[1]
    scores, _ = lm.lm_scores(read_table(spark, sf_dir, "documents"), ~held)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", suffix.removed_bytes().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = langid.remainder("doc_id", LANG_HELD[0]) == LANG_HELD[1]
    model = langid.fit(docs, ~held)
    out = langid.language_id(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs", "shares")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(read_table(spark, sf_dir, "conversations")))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of one segment are hashed in place; those of several as a stream of their segments."""
    reports, turns = repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")))
    texts = turns.select("conv_id", "part", "segment", "whole", repair.joined(F.col("turns")).alias("text"))
    whole = texts.where("whole").select("conv_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
    parts = ordered_sha256(texts.where("not whole"), "conv_id", ["part", "segment"], "text", "\n", "repaired_sha256")
    digests = whole.unionByName(parts).withColumnRenamed("conv_id", "own_id")
    return reports.join(digests, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id")


def op13_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack_documents(read_table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_learned_partitions,
        op2_best_fit_packing,
        op3_sampled_pieces,
        op4_deleted_interpolation,
        op5_secret_scan,
        op6_suffix_array_dedup,
        op7_minhash_near_dedup,
        op8_exact_dedup,
        op9_line_dedup,
        op10_language_id,
        op11_prefix_trie,
        op12_structure_repair,
        op13_bin_slack,
    )
    return {f.__name__: f for f in every}


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"

OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(0, (length(h) + 399) // 400)) AS j, h FROM d),
c AS MATERIALIZED (SELECT doc_id, n, j, substr(h, 400 * j + 1, 598) AS part FROM q),
p AS (SELECT doc_id, n, 200 * j AS base, part, unnest(range(0, least(200, n - 200 * j))) AS k FROM c),
b AS MATERIALIZED (SELECT doc_id, base + k AS i, substr(part, 2 * k + 1, 2) AS byte, CASE WHEN base + k + 100 <= n THEN substr(part, 2 * k + 1, 200) END AS w FROM p),
f AS (SELECT w, min(doc_id * 1000000000 + i) AS place FROM b WHERE w IS NOT NULL GROUP BY w),
g AS (SELECT b.doc_id, b.i, byte, coalesce(f.place < b.doc_id * 1000000000 + b.i, false) AS again FROM b LEFT JOIN f ON b.w = f.w),
o AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM g),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM o),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

OP7_SQL = (
    "WITH RECURSIVE d AS (SELECT doc_id, " + _WORDS.format("coalesce(text, '')") + """ AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.y, d.doc_id) AS component_id, coalesce(m.y, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
)

OP9_SQL = (
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS k, unnest(lines) AS line FROM d),
w AS (SELECT doc_id, k, doc_id * 1000000000 + k AS place, """ + _WORDS.format("line") + """ AS w FROM l),
t AS (SELECT w, len(w) AS n, array_to_string(w, ' ') AS whole, min(place) AS first FROM w WHERE len(w) > 0 GROUP BY w),
v AS (SELECT whole, n, first, unnest(range(1, n + 1)) AS i, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' '))) AS rest FROM t WHERE n >= 5),
replaced AS (SELECT v.whole, min(o.first) AS first FROM v JOIN (SELECT i, n, rest, min(first) AS first FROM v GROUP BY 1, 2, 3) o ON v.i = o.i AND v.n = o.n AND v.rest = o.rest GROUP BY 1),
longer AS (SELECT v.whole, min(t.first) AS first FROM v JOIN t ON t.whole = v.rest AND t.n = v.n - 1 AND t.n >= 5 GROUP BY 1),
shorter AS (SELECT t.whole, min(v.first) AS first FROM t JOIN v ON t.whole = v.rest AND t.n = v.n - 1 AND t.n >= 5 GROUP BY 1),
e AS (SELECT whole, min(first) AS earliest FROM (SELECT whole, first FROM t UNION ALL FROM replaced UNION ALL FROM longer UNION ALL FROM shorter) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(k, ',' ORDER BY k) AS removed FROM w JOIN e ON array_to_string(w.w, ' ') = e.whole WHERE place > earliest GROUP BY 1)
SELECT d.doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed_lines FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
)

def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_array_dedup": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL}
