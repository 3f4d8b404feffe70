"""Removal of repeated byte strings with suffix arrays over shards of related text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import kernels
from emberlog.llm.chunks import FAN_BITS, chunked, expand, in_key_order, pack_counts, range_bits, shared_counts, squeeze, texts, unpack_counts
from emberlog.llm.common import discard, materialise

U64 = np.uint64
#: Bytes of the hashed grams; a window's grams are all those inside it.
GRAM = 32
#: Occurrences from which the windows of a key are dealt by all of their bytes.
HOT = 20_000
#: Logarithm of the bits of the map of such keys: 16 MB.
HOT_BITS = 27
#: Chunks, and then groups, whose fragments meet at one level.
BLOCK = 256


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as smallest."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _append(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Put ``items`` at the ends of their buckets, in order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    sa[at[c] + step * rank] = items[order]
    at[c[first]] += step * np.diff(np.append(first, len(c)))


def _induce_buckets(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """Induced sorting, bucket by bucket: each step moves all suffixes of a bucket that are known so far."""
    n, size = len(t), np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    head = end - size
    sa = np.full(n, -1, np.int64)
    seeds: list[np.ndarray] = [lms[:0]] * sigma
    order = np.argsort(t[lms], kind="stable")
    cut = np.cumsum(np.bincount(t[lms], minlength=sigma))
    for c in np.flatnonzero(np.diff(cut, prepend=0)):
        seeds[c] = lms[order[cut[c - 1] if c else 0 : cut[c]]]
    at = head.copy()
    sa[at[t[n - 1]]] = n - 1
    at[t[n - 1]] += 1
    for c in np.flatnonzero(size):
        done = head[c]
        while done < at[c]:
            known, done = sa[done : at[c]], at[c]
            before = known[known > 0] - 1
            before = before[t[before] >= c]
            if len(before):
                _append(sa, at, t[before], before, 1)
        before = seeds[c] - 1
        if len(before):
            _append(sa, at, t[before], before, 1)
    larger = at.copy()
    at = end - 1
    for c in np.flatnonzero(size)[::-1]:
        done = end[c] - 1
        while done > at[c]:
            known, done = sa[at[c] + 1 : done + 1][::-1], at[c]
            before = known[known > 0] - 1
            before = before[t[before] <= c]
            if len(before):
                _append(sa, at, t[before], before, -1)
        known = sa[head[c] : larger[c]][::-1]
        before = known[known > 0] - 1
        before = before[t[before] < c]
        if len(before):
            _append(sa, at, t[before], before, -1)
    return sa


def _induce_items(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """Induced sorting, one suffix after another, for alphabets with few suffixes in a bucket."""
    n, size = len(t), np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    as_l, as_s = np.where(small, -1, t).tolist(), np.where(small, t, -1).tolist()
    sa, at = [-1] * n, (end - 1).tolist()
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        sa[at[c]] = i
        at[c] -= 1
    at = (end - size).tolist()
    c = int(t[n - 1])
    sa[at[c]] = n - 1
    at[c] += 1
    # a list that is walked shows what is put into it further on
    for i in sa:
        if i > 0:
            c = as_l[i - 1]
            if c >= 0:
                k = at[c]
                sa[k] = i - 1
                at[c] = k + 1
    at = (end - 1).tolist()
    for i in reversed(sa):
        if i > 0:
            c = as_s[i - 1]
            if c >= 0:
                k = at[c]
                sa[k] = i - 1
                at[c] = k - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Suffix array by induced sorting: classify, sort and name leftmost-smaller substrings, sort the string of names the same way, induce.

    Buckets of many suffixes are induced bucket by bucket, all that is known at once; in a string of
    names most buckets hold few, and its suffixes are induced one after another.
    """
    n = len(t)
    if n <= 1:
        return np.arange(n, dtype=np.int64)
    t = t.astype(np.int64)
    induce = _induce_buckets if n > 1000 * sigma else _induce_items
    small = _types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) == 0:
        return induce(t, small, sigma, lms)
    rough = induce(t, small, sigma, lms)
    rough = rough[is_lms[rough]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n)) + 1
    a, b = rough[:-1], rough[1:]
    la, lb = length[number[a]], length[number[b]]
    same = (la == lb) & (a + la <= n) & (b + lb <= n)
    at = np.flatnonzero(same)
    if len(at):
        size = la[at]
        first = np.cumsum(size) - size
        into = np.arange(size.sum()) - np.repeat(first, size)
        differ = t[np.repeat(a[at], size) + into] != t[np.repeat(b[at], size) + into]
        same[at] = np.add.reduceat(differ, first) == 0
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[rough]] = names
        rough = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(t, small, sigma, rough)


def permuted_common_prefix(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every position, bytes shared with the suffix before it in the array, up to ``most``.

    A position shares at least as much as the one ``d`` places before it, less ``d``. Every 64th
    position is compared first, then those half-way between, and so on, each from what its
    predecessor leaves it, eight bytes at a time; so bytes are compared about once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    for step in (0, 32, 16, 8, 4, 2, 1):
        at = np.arange(step, n, 2 * step or 64)
        out[at] = np.maximum(out[at - step] - step, 0)
        live = at[before[at] >= 0]
        live = live[out[live] < most]
        while len(live):
            k = out[live]
            x = word[live + k] ^ word[before[live] + k]
            same = x == 0
            last = x[~same]
            # the lowest bit that differs is in the first byte that does
            out[live[~same]] += np.log2((last & (~last + U64(1))).astype(float)).astype(np.int64) >> 3
            live = live[same]
            out[live] += 8
            live = live[out[live] < most]
        room = n - np.maximum(at, before[at])
        out[at] = np.where(before[at] >= 0, np.minimum(np.minimum(out[at], most), room), 0)
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose smallest gram hash stands in one place: start, number of windows, key.

    The leftmost smallest gram is set by a window's bytes alone, so equal windows have equal keys,
    and no two windows of one run are equal.
    """
    starts, sizes, keys = [], [], []
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = min(rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + (2 << 20), "right")) - 1))
        lo, hi = int(offsets[a]), int(offsets[b])
        grams = kernels.window_hashes(data[lo:hi], GRAM)
        low = U64((1 << max(22, len(grams).bit_length())) - 1)
        least = kernels.sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), width - GRAM + 1)
        n = len(least)
        if n > 0:
            cut = offsets[a : b + 1] - lo
            change = np.zeros(n + 1, np.int32)
            np.add.at(change, np.minimum(np.maximum(cut[1:] - width + 1, cut[:-1]), n), 1)
            np.add.at(change, np.minimum(cut[1:], n), -1)
            inside = np.cumsum(change[:n]) == 0
            edge = np.ones(n + 1, bool)
            edge[1:n] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
            edge[np.minimum(cut[:-1], n)] = True
            at = np.flatnonzero(edge)
            begin, size = at[:-1], np.diff(at)
            begin, size = begin[inside[begin]], size[inside[begin]]
            starts.append(begin + lo)
            sizes.append(size)
            keys.append(kernels.mix(grams[(least[begin] & low).astype(np.int64)]))
        a = b
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(starts, np.int64), join(sizes, np.int64), join(keys, U64)


def _window_keys(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all bytes of the windows at the places ``at``: of their first and last 2 ** k bytes, which meet or overlap."""
    part = 1 << (width.bit_length() - 1)
    if len(at) == 0:
        return np.zeros(0, U64)
    out = np.empty(len(at), U64)
    order = np.argsort(at, kind="stable")
    for lo in range(0, len(data), 2 << 20):
        a, b = np.searchsorted(at[order], [lo, lo + (2 << 20)])
        if b > a:
            grams = kernels.window_hashes(data[lo : lo + (2 << 20) + width], part)
            own = at[order[a:b]] - lo
            out[order[a:b]] = kernels.mix(grams[own] * U64(0x9E3779B97F4A7C15) + grams[own + width - part])
    return out


def _seen(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[np.searchsorted(np.unique(key), key)] if len(key) else np.zeros(0, np.int64)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [unpack_counts(c.as_py())[0] for c in batch.column("counts")]
        yield pa.RecordBatch.from_arrays([pa.array((np.array(keys, np.int64).view(U64) >> U64(64 - HOT_BITS)).astype(np.int64))], ["place"])


def _bitmap(keys: DataFrame) -> np.ndarray | None:
    """The places of keys, ``HOT_BITS`` bits of each, as a bitmap of fixed size; none if there are no keys. It may tell of a few keys more."""
    bit = keys.select("counts").mapInArrow(_numbers, "place long").select((F.col("place") + 1).alias("bit"))
    rows = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bm")).collect()
    if not rows:
        return None
    out = np.zeros(1 << (HOT_BITS - 3), np.uint8)
    for r in rows:
        own = np.frombuffer(r["bm"], np.uint8)
        out[(r["bucket"] - 1) * len(own) : r["bucket"] * len(own)] = own
    return out


def _is_hot(key: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(key), bool)
    place = (key >> U64(64 - HOT_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _hot_windows(data: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of hot keys, and hashes of their bytes."""
    start, size, key = runs
    use = _is_hot(key, bitmap)
    start, size = start[use], size[use]
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    return at, _window_keys(data, at, width)


def _fragments(row: dict, answers: dict[int, np.ndarray], width: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, document offsets, and the fragments that may repeat: start, windows, shard key, and the fragment of this chunk that stands for it.

    Windows of a hot key that the corpus has twice are a fragment each, keyed by all of their bytes:
    a passage that many documents share is so dealt by its windows, and what each document has
    beside it is left out.
    """
    data, offsets = texts(row)
    start, size, key = _runs(data, offsets, width)
    use = (_seen(key, answers.get(0, np.zeros(0, np.int64))) > 1) & ~_is_hot(key, bitmap)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
    at, whole = _hot_windows(data, (start, size, key), width, bitmap)
    if len(at):
        twice = _seen(whole, answers[1]) > 1
        at, whole = at[twice], whole[twice]
    n = int(use.sum())
    start, size, key = np.concatenate([start[use], at]), np.concatenate([size[use], np.ones(len(at), np.int64)]), np.concatenate([key[use], kernels.mix(whole)])
    doc = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((start, ids[doc])) if len(start) else np.zeros(0, np.int64)
    raw, first, stands = data.tobytes(), {}, np.arange(len(start))
    plain = order[order < n]
    for i, a, b in zip(plain.tolist(), start[plain].tolist(), (start + size)[plain].tolist(), strict=True):
        stands[i] = first.setdefault(raw[a : b + width - 1], i)
    single = order[order >= n]
    if len(single):
        _, where, back = np.unique(key[single], return_index=True, return_inverse=True)
        mine = single[where][back]
        window = np.lib.stride_tricks.sliding_window_view(data, width)
        for a in range(0, len(single), 1 << 16):
            i, j = single[a : a + (1 << 16)], mine[a : a + (1 << 16)]
            same = (window[start[i]] == window[start[j]]).all(1)
            stands[i[same]] = j[same]
    return data, offsets, start, size, key, stands


_FRAME = "node long, range int, chunks binary, ids binary, places binary, sizes binary, keys binary, text binary"
_NAMES = ["node", "range", "chunks", "ids", "places", "sizes", "keys", "text"]


def _frames(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)], _NAMES)


def _known(node: int, chunk: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple]:
    """Rows on windows that are known to repeat; they go past all shards."""
    if len(chunk) == 0:
        return []
    none = pack_counts(np.zeros(0, np.int64))
    return [(node, -1, pack_counts(chunk), none, pack_counts(place), pack_counts(size), none, b"")]


def _dealt(node: int, bits: int, chunk: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray, key: np.ndarray, texts_of: list[bytes]) -> list[tuple]:
    """Fragments by the first ``bits`` bits of their keys, packed, a row for each range that has any."""
    shard = (key >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = order[a:b]
        text = squeeze(b"".join([texts_of[i] for i in own.tolist()]))
        out.append((node, int(shard[own[0]]), *(pack_counts(x[own]) for x in (chunk, ids, place, size, key.view(np.int64))), text))
    return out


def _ship(width: int, bits: int, bitmap: Broadcast | None):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in docs.to_pylist():
            data, offsets, start, size, key, stands = _fragments(row, in_key_order(told), width, bitmap and bitmap.value)
            alone = stands == np.arange(len(start))
            chunk = np.full(len(start), row["chunk"], np.int64)
            out += _known(row["chunk"], chunk[~alone], start[~alone], size[~alone])
            mine = np.flatnonzero(alone)
            doc = np.searchsorted(offsets, start[mine], "right") - 1
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(start[mine].tolist(), (start + size + width - 1)[mine].tolist(), strict=True)]
            out += _dealt(row["chunk"], bits, chunk[mine], ids[doc], start[mine], size[mine], key[mine], pieces)
        return _frames(out)

    return run


def _opened(rows: list[dict], width: int) -> tuple[list[np.ndarray], bytes, np.ndarray]:
    """Columns of a group's fragments, their text, and where each one's text begins."""
    columns = [np.concatenate([unpack_counts(r[c]) for r in rows]) for c in ("chunks", "ids", "places", "sizes", "keys")]
    return columns, b"".join(expand(r["text"]) for r in rows), np.concatenate([[0], np.cumsum(columns[3] + width - 1)])


def _earliest(ids: np.ndarray, chunks: np.ndarray, places: np.ndarray, raw: bytes, cut: np.ndarray) -> np.ndarray:
    """The earliest of the fragments that are equal to each: by id, and in one id by chunk and place."""
    first, stands, ends = {}, np.zeros(len(ids), np.int64), cut.tolist()
    for i in np.lexsort((places, chunks, ids)).tolist():
        stands[i] = first.setdefault(raw[ends[i] : ends[i + 1]], i)
    return stands


def _join_on(width: int, bits: int):
    """One level of groups: equal fragments of the chunks that meet here become one, and go on by finer ranges."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows or rows[0]["range"] < 0:
            return table.select(_NAMES)
        (chunk, ids, place, size, key), raw, cut = _opened(rows, width)
        alone = _earliest(ids, chunk, place, raw, cut) == np.arange(len(ids))
        node, mine = rows[0]["node"], np.flatnonzero(alone)
        pieces = [raw[a:b] for a, b in zip(cut[:-1][mine].tolist(), cut[1:][mine].tolist(), strict=True)]
        return _frames(_known(node, chunk[~alone], place[~alone], size[~alone]) + _dealt(node, bits, chunk[mine], ids[mine], place[mine], size[mine], key[mine].view(U64), pieces))

    return run


def repeated_windows(ids: np.ndarray, chunks: np.ndarray, places: np.ndarray, sizes: np.ndarray, keys: np.ndarray, raw: bytes, width: int) -> np.ndarray:
    """For all windows of all fragments, whether the same bytes start earlier by (id, chunk, place) in any of them.

    Of equal fragments the earliest stands for all. A key with one fragment left has no equal
    windows; the fragments of all others are sorted together.
    """
    cut = np.concatenate([[0], np.cumsum(sizes + width - 1)])
    windows = np.concatenate([[0], np.cumsum(sizes)])
    again = np.zeros(windows[-1], bool)
    stands = _earliest(ids, chunks, places, raw, cut)
    later = np.flatnonzero(stands != np.arange(len(ids)))
    again[np.repeat(windows[later] - np.cumsum(sizes[later]) + sizes[later], sizes[later]) + np.arange(sizes[later].sum())] = True
    own = np.flatnonzero(stands == np.arange(len(ids)))
    _, back, number = np.unique(keys[own], return_inverse=True, return_counts=True)
    own = own[number[back] > 1]
    if len(own) == 0:
        return again
    text = np.frombuffer(b"".join(raw[cut[i] : cut[i + 1]] for i in own.tolist()), np.uint8)
    sa = suffix_array(text)
    shared = permuted_common_prefix(text, sa, width) >= width
    at = np.cumsum(sizes[own] + width - 1) - (sizes[own] + width - 1)
    into = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    valid = np.repeat(at, sizes[own]) + into
    where = np.full(len(text), -1, np.int64)
    where[valid] = np.repeat(windows[own], sizes[own]) + into
    group = np.cumsum(~shared[sa])
    slot = where[sa]
    group, slot = group[slot >= 0], slot[slot >= 0]
    fragment = np.searchsorted(windows, slot, "right") - 1
    begin = places[fragment] + slot - windows[fragment]
    order = np.lexsort((begin, chunks[fragment], ids[fragment], group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    again[slot[order[later]]] = True
    return again


def _sort_shard(width: int):
    """Runs of repeated windows, by chunk."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chunk = begin = number = np.zeros(0, np.int64)
        if rows and rows[0]["range"] < 0:
            chunk, begin, number = (np.concatenate([unpack_counts(r[c]) for r in rows]) for c in ("chunks", "places", "sizes"))
        elif rows:
            (chunks, ids, places, sizes, keys), raw, _ = _opened(rows, width)
            own = np.flatnonzero(repeated_windows(ids, chunks, places, sizes, keys, raw, width))
            first = np.cumsum(sizes) - sizes
            fragment = np.searchsorted(first, own, "right") - 1
            new = np.ones(len(own), bool)
            new[1:] = (np.diff(own) != 1) | (np.diff(fragment) != 0)
            head = np.flatnonzero(new)
            chunk, begin, number = chunks[fragment[head]], (places[fragment] + own - first[fragment])[head], np.diff(np.append(head, len(own)))
        order = np.argsort(chunk, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        out = [(int(chunk[order[a]]), pack_counts(np.concatenate([begin[order[a:b]], number[order[a:b]]]))) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())], ["chunk", "runs"])

    return run


def _cut_out(width: int):
    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        out = []
        for row in docs.to_pylist():
            data, offsets = texts(row)
            change = np.zeros(len(data) + 1, np.int32)
            for packed in runs.column("runs").to_pylist():
                start, size = unpack_counts(packed).reshape(2, -1)
                np.add.at(change, start, 1)
                np.add.at(change, start + size + width - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            raw, kept = data.tobytes(), data[~gone].tobytes()
            left = np.concatenate([[0], np.cumsum(~gone)])
            for i, doc in enumerate(row["ids"]):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if left[b] - left[a] == b - a:
                    out.append({"id": doc, "n_bytes": b - a, "removed": [], "kept": raw[a:b]})
                    continue
                own = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1), strict=True)]
                out.append({"id": doc, "n_bytes": b - a, "removed": spans, "kept": kept[left[a] : left[b]]})
        return pa.Table.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return run


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Per row: id, ``n_bytes``, ``removed`` spans (bytes, end exclusive) and the ``kept`` bytes.

    A byte goes if a ``width``-byte string over it also starts earlier: in a smaller id, or in the
    same one further left. Strings are judged on the input and never cross rows. Every window of
    ``width`` bytes is keyed by the smallest hash of its grams, so equal windows share a key; keys
    that occur twice in the corpus send their windows' text, each distinct fragment once from a
    chunk, to a shard of their key range. A shard is sorted by an induced suffix array, and windows
    equal in their first ``width`` bytes lie side by side, as the permuted common prefixes show.

    Windows of keys of more than ``hot`` occurrences, which a bitmap of fixed size tells, are counted
    by all of their bytes, and only those that occur twice are sent, each by itself; so a passage
    found everywhere is dealt by its windows. Chunks deal their fragments into 256 ranges at most; where there are more chunks than
    ``block``, groups of that many join their equal fragments and deal on.

    A null text is empty. Null ids come last. Rows of one id, and rows without one, come in the order
    in which the table is read, so of repeated rows one stays. Texts shorter than ``width`` stay whole. Other columns are ignored; an
    empty table gives no rows.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} or more")
    chunks = chunked(docs, id_col, text_col)
    n = max(1, chunks.select("chunk").count())

    def keys(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {0: np.unique(_runs(*texts(row), width)[2], return_counts=True)}

    def crowded(_: int, every: np.ndarray, total: np.ndarray) -> list[tuple[int, int, int]]:
        return [(9, 0, k) for k in every[total > hot].view(np.int64).tolist()]

    counts = shared_counts(chunks, keys, extra=crowded)
    told, again, found = counts.where("chunk >= 0"), None, _bitmap(counts.where("chunk < 0"))
    bitmap = None if found is None else chunks.sparkSession.sparkContext.broadcast(found)

    def windows(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        data, offsets = texts(row)
        return {1: np.unique(_hot_windows(data, _runs(data, offsets, width), width, bitmap.value)[1], return_counts=True)}

    if bitmap is not None:
        again = shared_counts(chunks, windows)
        told = told.unionByName(again)

    blocks = [-(-n // block)]
    while blocks[-1] > 1:
        blocks.append(-(-blocks[-1] // block))
    last = range_bits(n, 1) + 2
    bits = [min(last, FAN_BITS * (level + 1)) for level in range(len(blocks) - 1)] + [last]
    past = F.col("range") < 0
    group = lambda origin, count: F.when(past, -1 - F.pmod(F.xxhash64("node"), F.lit(1 << last))).otherwise(F.shiftleft(F.pmod(F.xxhash64(origin), F.lit(count)), 32) + F.col("range"))
    parts = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ship(width, bits[0], bitmap), _FRAME).withColumn("node", group(F.col("node"), blocks[0]))
    for level, count in enumerate(blocks[1:], 1):
        parts = materialise(parts, "fragments").groupBy("node").applyInArrow(_join_on(width, bits[level]), _FRAME).withColumn("node", group(F.shiftright("node", 32), count))
    runs = materialise(parts.groupBy("node").applyInArrow(_sort_shard(width), "chunk long, runs binary"), "runs")
    discard(*(t for t in (counts, again) if t is not None))
    out = chunks.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_cut_out(width), "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def removed_bytes(removed: str = "removed"):
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
