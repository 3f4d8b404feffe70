"""Language-model scores by deleted interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import kernels
from emberlog.llm.chunks import chunked, in_key_order, pack_counts, shared_counts, texts, unpack_counts
from emberlog.llm.common import discard, materialise

U64 = np.uint64
END, BEGIN = U64(0x0E0D0E0D0E0D0E0D), U64(0x0B0E0B0E0B0E0B0E)
#: Context frequencies are bucketed by powers of two; likelihood ratios are binned for the learning of weights.
BUCKETS, STEP, SPAN = 48, 0.05, 30.0
BINS = int(2 * SPAN / STEP) + 2


@dataclass(frozen=True)
class Weights:
    """Training tokens, distinct ones, weight of the unigram, and of the bigram by context bucket."""

    tokens: int
    types: int
    unigram: float
    bigram: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def lower(self, c: np.ndarray, tokens: int) -> np.ndarray:
        return (self.unigram * c / tokens if tokens else 0.0) + (1 - self.unigram) / (self.types + 1) + np.zeros(len(c))


def stream(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk with an end after each document, their contexts, each document's offsets, and which tokens train."""
    data, offsets = texts(row)
    hashes, cut, step = [], [np.zeros(1, np.int64)], 0
    for lo in _slices(offsets):
        a, b = lo
        h, o = kernels.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(h)
        cut.append(o[1:] + step)
        step += len(h)
    flat, at = np.concatenate(hashes) if hashes else np.zeros(0, U64), np.concatenate(cut)
    tokens = np.insert(flat, at[1:], END)
    starts = at + np.arange(len(at))
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts[:-1]] = BEGIN
    train = np.repeat(np.asarray(row["flags"], bool), np.diff(starts))
    return tokens, context, starts, train


def _slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        yield a, b
        a = b


def _pairs(context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    # 56 bits keep the packed keys short; two of a billion pairs then share a key with a chance of a few in a hundred million each
    return kernels.mix(context * U64(0x9E3779B97F4A7C15) + tokens) & ~U64(0xFF)


def _keys(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    tokens, context, starts, train = stream(row)
    n_train = int(np.sum(row["flags"]))
    single = np.append(tokens, BEGIN)
    out = {}
    for kind, values, weight in ((0, single, np.append(train.astype(float), n_train)), (1, _pairs(context, tokens), train.astype(float))):
        keys, back = np.unique(values, return_inverse=True)
        out[kind] = keys, np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64)
    return out


def _of_count(c: np.ndarray) -> np.ndarray:
    """Bin of a count: exact below 1024, then 32 for each doubling."""
    c = np.maximum(c, 1)
    return np.where(c < 1024, c, 1024 + np.floor(32 * (np.log2(c) - 10))).astype(np.int64)


def _tally(kind: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """Of the words of a key range: how many have about each training count (kind 2), and their tokens (kind 3)."""
    if kind != 0:
        return []
    c = counts[(keys != BEGIN) & (counts > 0)]
    bins, back = np.unique(_of_count(c), return_inverse=True)
    number, tokens = np.bincount(back, minlength=len(bins)), np.bincount(back, weights=c, minlength=len(bins))
    return [x for b, n, t in zip(bins, number, tokens, strict=True) for x in ((2, int(b), int(n)), (3, int(b), int(t)))]


def _em(ratio: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """Weight of the first of two components, given how many times likelier it is, by EM."""
    if n.sum() == 0:
        return 0.0
    w = 0.5
    for _ in range(rounds):
        new = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
        if abs(new - w) < 1e-7:
            break
        w = new
    return min(max(w, 0.0), 1 - 1e-6)


def _bucket(context_count: np.ndarray) -> np.ndarray:
    return np.where(context_count > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(context_count, 1))).astype(int) + 1), 0)


_JOINED = "ids array<long>, flags array<boolean>, starts binary, word binary, pair binary, begin long"


def _join(docs: pa.Table, answers: pa.Table) -> pa.Table:
    out = []
    for row in docs.to_pylist():
        tokens, context, starts, _ = stream(row)
        counts = in_key_order(answers)
        single = np.unique(np.append(tokens, BEGIN))
        pairs = _pairs(context, tokens)
        word = counts[0][np.searchsorted(single, tokens)]
        pair = counts[1][np.searchsorted(np.unique(pairs), pairs)] if len(pairs) else np.zeros(0, np.int64)
        out.append({"ids": row["ids"], "flags": row["flags"], "starts": pack_counts(starts), "word": pack_counts(word), "pair": pack_counts(pair), "begin": int(counts[0][np.searchsorted(single, BEGIN)])})
    return pa.Table.from_pylist(out, schema=pa.schema([("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("starts", pa.binary()), ("word", pa.binary()), ("pair", pa.binary()), ("begin", pa.int64())]))


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document offsets and, for each token, counts of the word, of its context, and of the pair."""
    starts, word, pair = unpack_counts(row["starts"]), unpack_counts(row["word"]), unpack_counts(row["pair"])
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[starts[:-1]] = row["begin"]
    return starts, word, context, pair


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Weights]:
    """Scores of all rows under a bigram model learned from the rows where ``train`` holds, and the model's weights.

    Columns: id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, the log10 probability of the text. p(w | v) mixes the maximum-likelihood bigram with
    the unigram, which is itself mixed with the uniform distribution over known words and one
    unknown. Weights depend on how often the context v occurs, by powers of two, and are learned by
    EM on deleted counts: each training token is judged by the counts without it. Counts cover all
    training rows. Only sums over bins, of fixed number, reach the driver.

    A null text is empty: its one token is the end. Nulls in ids stay null. Repeated rows count each
    and repeat their score. Other columns are ignored, an empty table gives no rows, and without
    training rows every token is the unknown one.
    """
    chunks = chunked(docs, id_col, text_col, train)
    answers = shared_counts(chunks, _keys, extra=_tally)

    sums: dict[int, dict[int, int]] = {2: {}, 3: {}}
    for r in answers.where("chunk = -1").select("kind", "range", "counts").mapInArrow(_numbers, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        sums[r["kind"]][r["bin"]] = r["n"]
    types, tokens = sum(sums[2].values()), sum(sums[3].values())
    mean = {b: sums[3][b] / n for b, n in sums[2].items()}
    held = np.array([sums[3][b] for b in mean], float)
    ratio = np.array([(mean[b] - 1) / max(1, tokens - 1) * (types + 1) for b in mean])
    first = Weights(tokens, types, _em(ratio, held), np.zeros(BUCKETS))

    joined = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(_join, _JOINED)
    joined = materialise(joined, "joined")
    discard(chunks, answers)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS * BINS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                starts, word, context, pair = _open(row)
                use = np.repeat(np.asarray(row["flags"], bool), np.diff(starts))
                word, context, pair = word[use] - 1, context[use] - 1, pair[use] - 1
                low = first.lower(word, max(1, first.tokens - 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = np.log(pair / np.maximum(context, 1) / low)
                b = np.where(pair > 0, np.clip((x + SPAN) / STEP, 0, BINS - 2).astype(int) + 1, 0)
                seen += np.bincount(_bucket(context) * BINS + b, minlength=BUCKETS * BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bin": at.astype(np.int32), "n": seen[at]})

    table = np.zeros((BUCKETS, BINS))
    for r in joined.select("flags", "starts", "word", "pair", "begin").mapInArrow(tally, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        table[divmod(r["bin"], BINS)] = r["n"]
    odds = np.exp((np.arange(BINS) - 0.5) * STEP - SPAN)
    odds[0] = 0
    weights = Weights(tokens, types, first.unigram, np.array([0.0, *(_em(odds, table[b]) for b in range(1, BUCKETS))]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, word, context, pair = _open(row)
                w = weights.bigram[_bucket(context)]
                p = w * pair / np.maximum(context, 1) + (1 - w) * weights.lower(word, weights.tokens)
                total = lambda v: np.add.reduceat(v, starts[:-1])  # noqa: E731  every document has its end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["flags"], pa.bool_()), pa.array(np.diff(starts)), pa.array(total((word > 0).astype(np.int64))), pa.array([weights.tokens] * len(row["ids"]), pa.int64()), pa.array(total(weights.base(word))), pa.array(total(np.log10(p)))],
                    ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = joined.mapInArrow(score, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col), weights


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [int(unpack_counts(c.as_py())[0]) for c in batch.column("counts")]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("range"), pa.array(values, pa.int64())], ["kind", "bin", "n"])


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / max(1, tokens))
