"""SHA-256 over many rows of a key, in order, without holding them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_sha256(rows: DataFrame, key: str, order: list[str], part: str, separator: str, name: str) -> DataFrame:
    """(``key``, ``name``): lowercase SHA-256 hex of the key's ``part`` strings in order, joined by ``separator``.

    The digest of a key is sequential by nature, so its rows stream through one task, sorted on disk
    if need be; no more than a batch of them is held. Join short parts before. A null key is a key,
    a null part is left out; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between, own, at, some = separator.encode(), None, None, False
        for batch in batches:
            keys, digests = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if own is None or k != at:
                    if own is not None:
                        keys.append(at)
                        digests.append(own.hexdigest())
                    own, at, some = hashlib.sha256(), k, False
                if text is not None:
                    own.update(between + text.encode() if some else text.encode())
                    some = True
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests, pa.string())], [key, name])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([own.hexdigest()], pa.string())], [key, name])

    kinds = dict(rows.dtypes)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kinds[key]]
    ordered = rows.select(F.col(key).alias("key"), F.col(part).alias("part"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    ordered = ordered.repartition("key").sortWithinPartitions("key", *(f"o{k}" for k in range(len(order))))
    return ordered.select("key", "part").mapInArrow(run, f"{key} {kinds[key]}, {name} string")
