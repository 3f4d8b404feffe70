"""Language identification by a mixture of languages within each document."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Languages, log prior, and per language the likelihood of each hashed byte trigram.

    ``likelihood`` has ``len(languages) * 2 ** bits`` entries, a size set by the label set and not
    by the corpus, so it is safe to broadcast.
    """

    languages: list[str]
    prior: np.ndarray
    likelihood: np.ndarray
    bits: int


def trigrams(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the lower-cased letters of ``text`` and their counts; of a text without letters, such as number signs, there are none."""
    found = _LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for run in found for c in run):
        return np.zeros(0, np.int64), np.zeros(0)
    b = np.frombuffer((" " + " ".join(found) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    values, counts = np.unique(code, return_counts=True)
    return values.astype(np.int64), counts.astype(float)


def fit(docs: DataFrame, train: Column, bits: int = 16, smoothing: float = 0.2) -> Model:
    """Count trigrams of every training row with text and a language; counts are summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                own = seen.setdefault(lang.as_py(), np.zeros((1 << bits) + 1, np.int64))
                values, counts = trigrams(text.as_py(), bits)
                own[values] += counts.astype(np.int64)
                own[-1] += 1
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "code": at.astype(np.int32), "n": own[at]})

    used = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = used.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), (1 << bits) + 1))
    table[[languages.index(x) for x in rows["lang"]], rows["code"].to_numpy(dtype=int)] = rows["n"]
    grams, n_docs = table[:, :-1] + smoothing, table[:, -1]
    prior = np.log((n_docs + 1) / (n_docs.sum() + max(1, len(languages))))
    return Model(languages, prior, (grams / grams.sum(1, keepdims=True)).astype(np.float32) if languages else grams, bits)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 30, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Mixing proportions of the rows of ``p`` (languages by trigrams, counted ``n``) by EM, and the log-likelihood."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(rounds):
        new = share * (p @ (n / (share @ p))) / total
        moved, share = np.abs(new - share).max(), new
        if moved < close:
            break
    return share, float(n @ np.log(share @ p))


def identify(text: str | None, model: Model, penalty: float = 3.0) -> tuple[str, float, list[str], list[float]]:
    """Language, its share of the text, and the selected set with shares.

    The set grows from the likeliest single language while each further one raises the
    log-likelihood by more than ``penalty`` times log(number of trigrams). Trigrams overlap, so
    likelihoods count a third.
    """
    at, n = trigrams(text, model.bits)
    if not len(at) or not model.languages:
        return "und", 0.0, [], []
    p = model.likelihood[:, at].astype(float)
    p /= p.max(0)
    n = n / 3
    single = np.log(p) @ n + model.prior
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(np.log(p[chosen[0]]) @ n)
    if len(model.languages) > 1:
        order = [int(i) for i in np.argsort(-mixture(p, n)[0], kind="stable") if i != chosen[0]]
        for i in order:
            new, value = mixture(p[[*chosen, i]], n)
            if value - best <= penalty * math.log(3 * n.sum() + 1):
                break
            chosen, share, best = [*chosen, i], new, value
    top = int(np.argmax(share))
    rank = np.argsort(-share, kind="stable")
    return model.languages[chosen[top]], float(min(1.0, share[top])), [model.languages[chosen[i]] for i in rank], [float(share[i]) for i in rank]


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (share of that language), ``langs`` and ``shares`` of the selected set, and the columns ``also``.

    Null text and text without letters are ``und`` with score 0; so is everything when no language
    was learned. Rows are independent: repeated rows repeat their answer, an empty table gives no
    rows, very long texts are read whole, and other columns are ignored but for those in ``also``,
    which come back as they are, the text as a string; so whole rows can be filtered without a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [identify(t.as_py(), own) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in carried), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.float64()))],
                ["id", *carried, "lang_pred", "score", "langs", "shares"],
            )

    carried = ["text" if c == text_col else f"c{k}" for k, c in enumerate(also)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(inner) for c, inner in zip(also, carried, strict=True) if c != text_col))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["id", *carried])
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, langs array<string>, shares array<double>")
    return out.select(F.col("id").alias(id_col), *(F.col(inner).alias(c) for c, inner in zip(also, carried, strict=True)), "lang_pred", "score", "langs", "shares")


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
