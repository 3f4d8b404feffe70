"""SentencePiece encoding with sampled segmentations, and decoding."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import slices
from emberlog.llm.kernels import mix

U64 = np.uint64
#: How a vocabulary writes a space.
SPACE = "▁"
#: Units of more characters are drawn one by one, the others together by their length.
LONG = 48
SLOT_BITS = 20
#: Lattice edges held at once, 12 bytes each and a few copies.
CELLS = 2_000_000
_SPREAD = U64(0xD6E8FEB86659FD93)


class Lattice:
    """The piece lattice of units, the parts of a text between spaces, each with its space before it.

    No piece spans two units, so a text's lattice is a chain of its units' lattices. A path's
    probability is the product of its pieces' weights: exp(score) for a unigram vocabulary; the
    scores of a BPE vocabulary are merge ranks r, so there 1 / (r + 2). ``heat`` is a power on
    them: 0 draws all segmentations alike. A character that is no piece, and a literal U+2581, goes
    as byte pieces.
    """

    def __init__(self, model_file: str, heat: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in plain]
        ranks = min(scores) < -1000
        self.weight = {sp.id_to_piece(i): (i, heat * (-math.log(2 - s) if ranks else s)) for i, s in zip(plain, scores, strict=True) if SPACE not in sp.id_to_piece(i)[1:]}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary needs byte pieces")
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.int32)
        self.rare = heat * -12.0
        self.longest = max(map(len, self.weight))
        self.text = [b""] * sp.get_piece_size()
        for piece, (i, _) in self.weight.items():
            self.text[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        names = list(self.weight)
        lengths, raw = np.array([len(p) for p in names]), np.zeros(len(names), U64)
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            codes = _codes([names[k] for k in same.tolist()], n)
            raw[same] = ((codes + U64(1)) * _SPREAD * _powers(n)[0][:n]).sum(1, dtype=U64) + U64(n)
        hashes = mix(raw)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for i, _ in self.weight.values()], np.int32)[order]
        self.logs = np.array([w for _, w in self.weight.values()])[order]
        # two tables of places by parts of the hash; the second holds pieces whose place in the first is taken
        self.slots = np.full((2, 1 << SLOT_BITS), -1, np.int32)
        low = (self.hashes & U64((1 << SLOT_BITS) - 1)).astype(np.int64)
        self.slots[0, low] = np.arange(len(low))
        rest = np.flatnonzero(self.slots[0, low] != np.arange(len(low)))
        self.slots[1, (self.hashes[rest] >> U64(SLOT_BITS) & U64((1 << SLOT_BITS) - 1)).astype(np.int64)] = rest
        if (self.find(self.hashes) != np.arange(len(low))).any():
            raise ValueError("the vocabulary does not fit the tables of its hashes")
        # most substrings are no pieces: a byte for each place, by the hash before it is mixed, tells of those that may be
        self.maybe = np.zeros(1 << SLOT_BITS, bool)
        self.maybe[_slot(raw)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in ``hashes``, -1 for none."""
        at = self.slots[0, (hashes & U64((1 << SLOT_BITS) - 1)).astype(np.int64)]
        at = np.where((at >= 0) & (self.hashes[at] == hashes), at, self.slots[1, (hashes >> U64(SLOT_BITS) & U64((1 << SLOT_BITS) - 1)).astype(np.int64)])
        return np.where((at >= 0) & (self.hashes[at] == hashes), at, -1)

    def edges(self, unit: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """Edges into each place of one unit, shortest first, as (from, ids, log weight), and the forward log sums."""
        n = len(unit)
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        forward = [0.0]
        for j in range(1, n + 1):
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                piece = unit[i:j]
                if piece in self.weight and not (i and piece[0] == SPACE):
                    at, w = self.weight[piece]
                    into[j].append((i, (at,), w))
                elif i == j - 1:
                    raw = b" " if j == 1 else piece.encode()
                    into[j].append((i, tuple(self.byte[b] for b in raw), self.rare * len(raw)))
            top = max(forward[a] + w for a, _, w in into[j])
            forward.append(top + math.log(sum(math.exp(forward[a] + w - top) for a, _, w in into[j])))
        return into, forward

    def backward(self, into: list, forward: list[float], draws: Iterator[float]) -> list[int]:
        """One path drawn from the end: each edge in proportion to its share of the forward sum."""
        at, out = len(forward) - 1, []
        while at:
            u = next(draws)
            for a, ids, w in into[at]:
                u -= math.exp(forward[a] + w - forward[at])
                if u < 0:
                    break
            out.append(ids)
            at = a
        return [i for ids in reversed(out) for i in ids]

    def filtered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length (a row of code points each): ids and cumulative shares of the edges into each place, by piece length.

        An id of -1 is a character that goes as bytes.
        """
        units, n = codes.shape
        most = min(n, self.longest)
        up, down = _powers(n)
        sums = np.zeros((n + 1, units), U64)
        np.cumsum(((codes + U64(1)) * _SPREAD * up[:n]).T, axis=0, out=sums[1:])
        ids = np.full((units, n + 1, most), -2, np.int32)
        share = np.full((units, n + 1, most), -np.inf)
        for size in range(1, most + 1):
            raw = ((sums[size:] - sums[:-size]) * down[: n + 1 - size, None] + U64(size)).ravel()
            near = np.flatnonzero(self.maybe[_slot(raw)])
            at = self.find(mix(raw[near]))
            near, at = near[at >= 0], at[at >= 0]
            i, unit = near // units, near % units
            plain = (i == 0) | (codes[unit, i] != ord(SPACE))
            i, unit, at = i[plain], unit[plain], at[plain]
            ids[unit, i + size, size - 1] = self.ids[at]
            share[unit, i + size, size - 1] = self.logs[at]
        lone = ids[:, 1:, 0] == -2
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        width[:, 0] = 1
        ids[:, 1:, 0][lone] = -1
        share[:, 1:, 0][lone] = self.rare * width[lone]
        forward = np.zeros((units, n + 1))
        for j in range(1, n + 1):
            m = min(j, most)
            log = share[:, j, :m] + forward[:, j - m : j][:, ::-1]
            top = log.max(1)
            total = np.cumsum(np.exp(log - top[:, None]), axis=1)
            forward[:, j] = top + np.log(total[:, -1])
            share[:, j, :m] = total / total[:, -1:]
            share[:, j, m:] = 1
        return ids, share

    def encode(self, texts: list[str] | pa.Array, keys: list[int], long: int = LONG) -> list[np.ndarray]:
        """Ids of a segmentation of each text drawn by its key: equal keys and texts give equal ids. Units of over ``long`` characters are drawn one by one."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        into = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], U64)
        bits = mix(mix(np.repeat(seed, sizes)) + into.astype(U64) * U64(0x9E3779B97F4A7C15))
        length = np.array([len(u) + 1 for u in names], np.int32)
        rank = np.empty(len(names), np.int32)
        by_length = np.argsort(length, kind="stable")
        rank[by_length] = np.arange(len(names))
        # occurrences by the length of their unit, those of one unit together
        order = np.argsort(rank[which], kind="stable").astype(np.int32)
        ordered = rank[which][order]
        steps, count, slow = [], np.zeros(len(which), np.int64), {}
        for n in np.unique(length).tolist():
            lo, hi = np.searchsorted(length[by_length], [n, n + 1]).tolist()
            if n > long:
                for r in order[slice(*np.searchsorted(ordered, [lo, hi]))].tolist():
                    draws = (float(mix(bits[r : r + 1] + U64(k))[0] >> U64(11)) * 2.0**-53 for k in range(1 << 62))
                    slow[r] = self.backward(*self.edges(SPACE + names[which[r]]), draws)
                    count[r] = len(slow[r])
                continue
            many = max(64, CELLS // ((n + 1) * min(n, self.longest)))
            for a in range(lo, hi, many):
                part = by_length[a : min(hi, a + many)]
                codes = np.full((len(part), n), ord(SPACE), U64)
                if n > 1:
                    codes[:, 1:] = _codes([names[k] for k in part.tolist()], n - 1)
                ids, share = self.filtered(codes)
                begin, stop = np.searchsorted(ordered, [a, a + len(part)])
                live, kind = order[begin:stop], ordered[begin:stop] - a
                at, step = np.full(len(live), n, np.int32), 0
                while len(live):
                    draw = (mix(bits[live] + U64(step)) >> U64(11)) * 2.0**-53
                    size = np.minimum((share[kind, at] <= draw[:, None]).sum(1, dtype=np.int32), np.minimum(at, share.shape[2]) - 1)
                    got = ids[kind, at, size]
                    lone = np.flatnonzero(got < 0)
                    char = np.where(at[lone] == 1, U64(32), codes[kind[lone], at[lone] - 1])
                    wide = np.ones(len(live), np.int8)
                    wide[lone] += (char >= 0x80).astype(np.int8) + (char >= 0x800) + (char >= 0x10000)
                    count[live] += wide
                    steps.append((live, got, lone, char, wide))
                    at = at - size - 1
                    more = np.flatnonzero(at)
                    live, kind, at, step = live[more], kind[more], at[more], step + 1
        end = np.cumsum(count)
        out, free = np.zeros(int(end[-1]) if len(end) else 0, np.int32), end.copy()
        for live, got, lone, char, wide in steps:
            free[live] -= wide
            plain = np.flatnonzero(got >= 0) if len(lone) else slice(None)
            out[free[live[plain]]] = got[plain]
            for c, at in zip(char.tolist(), free[live[lone]].tolist(), strict=True):
                raw = chr(c).encode()
                out[at : at + len(raw)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        for r, own in slow.items():
            out[end[r] - len(own) : end[r]] = own
        cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])] if len(sizes) else np.zeros(1, int)
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.text[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


@functools.cache
def _lattice(model_file: str, heat: float = 1.0) -> Lattice:
    """The lattice of a vocabulary, kept by the worker from one task to the next."""
    return Lattice(model_file, heat)


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words of ``n`` characters, a row each."""
    return np.array(words, f"<U{n}").view("<u4").reshape(len(words), n).astype(U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    return np.array([pow(base, k, 1 << 64) for k in range(n + 1)], U64), np.array([pow(inverse, k, 1 << 64) for k in range(n + 1)], U64)


def _slot(raw: np.ndarray) -> np.ndarray:
    return (raw * _SPREAD >> U64(64 - SLOT_BITS)).astype(np.int64)


def encode(docs: DataFrame, model_file: str, heat: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, a segmentation drawn by forward filtering and backward sampling.

    The draw depends on the row's id, ``seed`` and the text only. Forward sums are made once for each
    distinct unit of a few MB of text, all units of one length together, and so are the draws. Pieces
    are found by 64-bit hashes; each text's ids are decoded again, and a text that does not come
    back is drawn with pieces looked up by name, so nothing is lost. Null text gives null ids, empty
    text the one unit of a space; a null id is a key of its own. Repeated rows repeat their ids, an
    empty table gives no rows, texts are never cut, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_file, heat)
        for batch in batches:
            for part in slices(batch, "text", 5 << 20):
                texts = part.column("text")
                got = lattice.encode(texts.fill_null(""), part.column("key").to_pylist())
                none = texts.is_null()
                for k, (text, key) in enumerate(zip(texts.to_pylist(), part.column("key").to_pylist(), strict=True)):
                    if lattice.decode(got[k]) != (text or ""):  # a hash met another substring's: look pieces up by name
                        got[k] = lattice.encode([text], [key], long=0)[0]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(got)), mask=none)
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, the ids and ``text``, exactly what was encoded; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_file)
        for batch in batches:
            for part in (batch.slice(a, 512) for a in range(0, batch.num_rows, 512)):
                texts = [None if not x.is_valid else lattice.decode(x.values.to_numpy()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, text string").withColumnRenamed("id", id_col)
