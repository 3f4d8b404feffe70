"""Line deduplication by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import kernels
from emberlog.llm.chunks import chunked, in_key_order, shared_counts, texts
from emberlog.llm.common import discard, materialise

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = U64(pow(_BASE, -1, 1 << 64))


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (rows end lines, too) and each row's offsets into them; a row has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, "right") - 1
    per_row = np.bincount(row, minlength=len(offsets) - 1) + 1
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    return np.append(starts, offsets[-1]), np.concatenate([[0], np.cumsum(per_row)])


def variants(words: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes cut into lines: hashes of the lines, the line of each word, and the hash of that line without the word."""
    sizes = np.diff(cut)
    up, down = kernels._powers(1 << max(10, int(len(words) + 1).bit_length()))
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    first = down[cut[:-1]]
    whole = (sums[cut[1:]] - sums[cut[:-1]]) * first
    lines = kernels.mix(whole + sizes.astype(U64) * U64(_BASE))
    line = np.repeat(np.arange(len(sizes)), sizes)
    # left of the word as it is, right of it moved by one place
    moved = sums[1:] * _INVERSE
    base = moved[cut[1:] - 1] - sums[cut[:-1]]
    base[sizes == 0] = 0
    without = (sums[:-1] - moved + base[line]) * first[line]
    return lines, line, kernels.mix(without + ((sizes - 1).astype(U64) * U64(_BASE))[line])


def keyed_by_place(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of variants with the place of the word that is missing."""
    return kernels.mix(keys ^ kernels.mix((at + 1).astype(U64)))


def _lines(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, their line offsets, document and number of each line, and where lines start."""
    data, offsets = texts(row)
    starts, per_doc = line_offsets(data, offsets)
    found, cut, a, n = [], [np.zeros(1, np.int64)], 0, 0
    while a < len(starts) - 1:
        b = min(len(starts) - 1, max(a + 1, int(np.searchsorted(starts, starts[a] + (2 << 20), "right")) - 1))
        h, o = kernels.words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        found.append(h)
        cut.append(o[1:] + n)
        n, a = n + len(h), b
    words, cut = (np.concatenate(found) if found else np.zeros(0, U64)), np.concatenate(cut)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(per_doc))
    number = np.arange(len(doc)) - per_doc[doc]
    return words, cut, doc, number, starts


def _distinct(words: np.ndarray, cut: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct lines with words: number of a line that has each, which of them every line is (-1: none), their keys, and line, key and place of their variants.

    Lines of fewer than ``least_words`` words have no variants.
    """
    lines, line, shorter = variants(words, cut)
    full = np.flatnonzero(np.diff(cut) > 0)
    own, first, back = np.unique(lines[full], return_index=True, return_inverse=True)
    which = np.full(len(lines), -1, np.int64)
    which[full] = back
    chosen = full[first]
    use = np.zeros(len(lines), bool)
    use[chosen] = True
    use &= np.diff(cut) >= least_words
    word = np.flatnonzero(use[line])
    return chosen, which, own, which[line[word]], shorter[word], word - cut[line[word]]


def _shared(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """All keys of a chunk, shortened to 47 bits and one that tells variants (1) from whole lines (0)."""
    return np.concatenate([own & ~U64(0x1FFFF), keys & ~U64(0x1FFFF) | U64(0x10000)])


#: Answers are counts of 15 bits, the last of which is "as many or more"; the highest bit tells of keys of the other kind.
MANY = 0x7FFF


def _answers(_: int, distinct: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For sorted distinct keys and their counts: what chunks are told of each."""
    pair = np.flatnonzero((distinct[1:] ^ distinct[:-1]) == 0x10000)
    other = np.zeros(len(distinct), bool)
    other[pair] = other[pair + 1] = True
    return np.minimum(number, MANY) | (other.astype(np.int64) << 15)


_ROWS = "chunk long, row int, doc long, line int, key long, near array<long>, shrunk array<long>, body string"

#: What a row has a key for: a variant with its place, a variant that is a whole line, the whole line.
PLACED, SHRUNK, WHOLE = 0, 1, 2


def by_line(line: np.ndarray, keys: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order of their lines, signed, and where those of each line start."""
    order = np.argsort(line, kind="stable")
    return keys[order].astype(np.int64), np.searchsorted(line[order], np.arange(lines + 1))



def line_dedup(docs: DataFrame, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_removed`` and the numbers of ``removed`` lines, from 0.

    Lines end at line feeds. A line goes if an earlier one, by id and line number, is equal word
    for word or, with ``least_words`` words or more on both sides, differs by one word: inserted,
    deleted or replaced. Words ignore the case of A-Z. All variants of a line with one word
    deleted are hashed; variants that no other line shares are dropped first, by counts that chunks
    of documents ask for, of whole lines and variants apart. Rows of one variant meet in a partial
    minimum, never as pairs, since all lines of a variant with its place are within the bound of the
    earliest; so are a whole line and all that shrink to it. One candidate for each key of a line is
    then verified by its words.

    Lines without words stay. Null text has no lines, empty text one. Null ids are no earlier than
    any other. Repeated rows repeat lines. Other columns are ignored; an empty table gives no rows.
    """
    nulls = docs.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("doc"))
    chunks = chunked(docs.where(F.col(text_col).isNotNull()), id_col, text_col)

    def asked(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        words, cut, *_ = _lines(row)
        _, _, own, _, keys, _ = _distinct(words, cut, least_words)
        return {0: np.unique(_shared(own, keys), return_counts=True)}

    counts = shared_counts(chunks, asked, tell=_answers)

    def flagged(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        seen = in_key_order(answers).get(0, np.zeros(0, np.int64))
        for row in table.to_pylist():
            words, cut, doc, number, starts = _lines(row)
            chosen, which, own, line, keys, place = _distinct(words, cut, least_words)
            if not len(own):
                continue
            every = _shared(own, keys)
            order = np.argsort(every)
            new = np.append(True, np.diff(every[order]) != 0)
            count = np.empty(len(every), np.int64)
            count[order] = seen[np.cumsum(new) - 1]
            c_own, c_key = (count & MANY)[: len(own)], (count & MANY)[len(own) :]
            met = count > MANY
            sizes = np.diff(cut)[chosen]
            # variants that other lines have: more of them than this line has copies, each with the word at so many places
            new = np.ones(len(keys), bool)
            new[1:] = (line[1:] != line[:-1]) | (keys[1:] != keys[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(keys)))[np.cumsum(new) - 1]
            use = (c_key > c_own[line] * times) | (c_key == MANY)
            # variants that are whole lines
            short = met[len(own) :] & (sizes[line] > least_words) & new
            copies = np.bincount(which[which >= 0], minlength=len(own))
            need = (c_own > 1) | (copies > 1) | (met[: len(own)] & (sizes >= least_words))
            need[line[use | short]] = True
            placed, at = by_line(line[use], keyed_by_place(keys[use], place[use]), len(own))
            shrunk, cut_at = by_line(line[short], keys[short], len(own))
            data = texts(row)[0]
            for k in np.flatnonzero((which >= 0) & need[which]).tolist():
                i = which[k]
                body = data[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "replace")
                out.append((row["chunk"], int(doc[k]), row["ids"][doc[k]], int(number[k]), int(own[i].astype(np.int64)), placed[at[i] : at[i + 1]].tolist(), shrunk[cut_at[i] : cut_at[i + 1]].tolist(), body))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "row", "doc", "line", "key", "near", "shrunk", "body"])

    rows = materialise(chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(flagged, _ROWS), "lines")
    discard(counts)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "line", "chunk", "row").alias("place")
    placed = rows.select("key", "near", "shrunk", place, "body")
    distinct = materialise(placed.groupBy("key").agg(F.min(F.struct("place", "body", "near", "shrunk")).alias("m")).select("key", "m.*"), "distinct")

    # The key with a place links all of its lines; the key of a whole line links it with those that shrink to it, which are not linked with each other.
    kinds = {PLACED: F.explode("near"), SHRUNK: F.explode("shrunk"), WHOLE: F.col("key")}
    sides = [distinct.select(near.alias("near"), "key", "place", F.lit(kind).alias("kind")) for kind, near in kinds.items()]
    shared = sides[0].unionByName(sides[1]).unionByName(sides[2])
    least = lambda *of: F.min(F.when(F.col("kind").isin(*of), F.struct("place", "key")))
    first = shared.groupBy("near").agg(least(PLACED).alias("same"), least(SHRUNK).alias("longer"), least(WHOLE).alias("full"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.when(F.col("kind") == PLACED, F.col("same")).when(F.col("kind") == SHRUNK, F.col("full")).otherwise(F.col("longer"))
    met = shared.join(first, "near").select("key", "place", other.alias("other")).where("other.place < place")
    pairs = met.select("key", F.col("other.key").alias("other_key"), F.col("other.place").alias("near_place")).distinct()
    pairs = pairs.join(distinct.select("key", "body"), "key").join(distinct.select(F.col("key").alias("other_key"), F.col("body").alias("other_body")), "other_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([within_one(a, b) for a, b in zip(batch.column("body").to_pylist(), batch.column("other_body").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(good), batch.column("near_place").filter(good)], ["key", "near_place"])

    near_schema = distinct.schema["place"].dataType.simpleString()
    near = pairs.select("key", "near_place", "body", "other_body").mapInArrow(verify, f"key long, near_place {near_schema}")
    earliest = distinct.select("key", F.col("place").alias("first_place")).join(near.groupBy("key").agg(F.min("near_place").alias("near_place")), "key", "left").select("key", F.least("first_place", F.coalesce("near_place", "first_place")).alias("earliest"))
    # written, so that both sides of the next join are dealt by key alone and Spark can split a line that is everywhere
    earliest = materialise(earliest, "earliest")
    gone = placed.join(earliest, "key").where("earliest < place").groupBy(F.col("place.chunk").alias("chunk"), F.col("place.row").alias("row")).agg(F.sort_array(F.collect_set("place.line")).alias("removed"))
    gone = materialise(gone, "gone")
    discard(rows, distinct, earliest)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.diff(line_offsets(*texts(row))[1])
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(n)], ["chunk", "row", "doc", "n_lines"])

    every = chunks.mapInArrow(numbered, "chunk long, row int, doc long, n_lines long").join(gone, ["chunk", "row"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = every.select("doc", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
    empty = nulls.select("doc", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("removed"))
    return out.unionByName(empty).withColumnRenamed("doc", id_col)


def words_of(line: str) -> list[str]:
    return line.encode().translate(_LOWER).split()


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def within_one(a: str, b: str) -> bool:
    """Whether two lines differ by at most one word inserted, deleted or replaced."""
    x, y = words_of(a), words_of(b)
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1 :] or x[i + 1 :] == y[i:] or x[i + 1 :] == y[i + 1 :]
