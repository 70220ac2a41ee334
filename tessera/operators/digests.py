"""MD5 of long lists of texts, which no task holds whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece, about.
PIECE = 1 << 20


def _joined(keys: list[str], between: str, most: int):
    """Runs of texts of one key, in order, as pieces with their number in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, number, part = None, [], 0, 0, 0

        def piece(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([v], schema.field(k).type) for k, v in zip(keys, now)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([between.join(held) if held else None], pa.string())], names=[*keys, "part", "number", "piece"])

        for batch in batches:
            for *key, own, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "part", "text"))):
                if now != key or size > most:
                    if now is not None:
                        yield piece(batch.schema)
                        number += 1
                    now, held, size, part = key, [], 0, own
                if text is not None:
                    held.append(text)
                    size += len(text) + len(between)
            schema = batch.schema
        if now is not None:
            yield piece(schema)

    return work


def _hashed(keys: list[str], head: str, between: str):
    """The digest of each key's pieces, which come in order, fed one after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, md5, begun, schema = None, None, False, None

        def said(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], schema.field(k).type) for i, k in enumerate(keys)), pa.array([r[-1] for r in rows], pa.string())], names=[*keys, "md5"])

        for batch in batches:
            schema, out = batch.schema, []
            for at in range(batch.num_rows):  # pieces are long, so one at a time
                *key, text = (batch.column(c)[at].as_py() for c in (*keys, "piece"))
                if now != key:
                    if now is not None:
                        out.append((*now, md5.hexdigest()))
                    now, md5, begun = key, hashlib.md5(head.encode()), False
                if text is not None:
                    md5.update(((between if begun else "") + text).encode())
                    begun = True
            yield said(out)
        if now is not None:
            yield said([(*now, md5.hexdigest())])

    return work


def list_digests(rows: DataFrame, keys: list[str], order: list[Column], text: Column, between: str, head: str = "", most: int = PIECE) -> DataFrame:
    """(*keys, md5) of rows: MD5 of `head` and the texts of a key in order, null ones left
    out, joined by `between`. Tasks join the texts of a range of keys and order, so what
    one task hashes for a key of very many rows is a few long pieces, one at a time."""
    names = [f"order_{i}" for i in range(len(order))]
    shaped = rows.select(*keys, *(c.alias(n) for c, n in zip(order, names)), text.alias("text"))
    ranged = shaped.repartitionByRange(*keys, *names).sortWithinPartitions(*keys, *names).withColumn("part", F.spark_partition_id())
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    pieces = ranged.select(*keys, "part", "text").mapInArrow(_joined(keys, between, most), f"{kinds}part int, number long, piece string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "number").mapInArrow(_hashed(keys, head, between), f"{kinds}md5 string")
