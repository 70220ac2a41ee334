"""SentencePiece encoding with source spans, decoding, and token counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .piece_bpe import PieceModel
from .store import slices

#: Tokens over which `over_limit` holds.
LIMIT = 4096


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """A model, read once in each worker."""
    return PieceModel(path)


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _passed(df: DataFrame, ident: str, text: str) -> tuple[DataFrame, str]:
    return df.select(ident, text), f"`{ident}` {df.schema[ident].dataType.simpleString()}"


def _encoded(m: PieceModel, lib, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Ids with begin and end, begins, ends, and the decoded text."""
    ids, begins, ends = m.encode(text)
    ids = np.concatenate(([m.bos], ids, [m.eos])).astype("<u4")
    last = len(text.encode("utf-8"))
    return ids, np.concatenate(([0], begins, [last])).astype("<u4"), np.concatenate(([0], ends, [last])).astype("<u4"), lib.decode(ids.tolist())


def encode(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids, begins, ends, decoded) of every row.

    ids are those of the sentencepiece library with begin and end ids and without
    sampling; decoded is its decoding of all of them. begins and ends are, for each
    id, the bytes of the original text it covers; begin and end ids cover none.
    A null text counts as empty. Repeated rows each give a row; an empty table
    gives none; further columns are ignored. `path` must exist on every worker; its
    model may have no user-defined or unused pieces.
    """
    rows, schema = _passed(docs, ident, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lib = model(path), processor(path)
        for b in slices(batches):
            found = [_encoded(m, lib, t or "") for t in b.column(1).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype("<i4"))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array([f[3] for f in found], pa.string())], names=[ident, "ids", "begins", "ends", "decoded"])

    return rows.mapInArrow(run, f"{schema}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256, spans_sha256): `encode`, with its
    arrays and decoded text digested where they arise, so that only digests leave the
    worker. ids, and begins followed by ends, count as little-endian unsigned 32-bit
    integers, text as UTF-8."""
    rows, schema = _passed(docs, ident, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lib = model(path), processor(path)
        for b in slices(batches):
            sizes, digests = [], []
            for t in b.column(1).to_pylist():
                ids, begins, ends, decoded = _encoded(m, lib, t or "")
                sizes.append(len(ids))
                digests.append([hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), decoded.encode("utf-8"), begins.tobytes() + ends.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in range(3))], names=[ident, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return rows.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def count_tokens(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(ident, n_bytes, n_tokens, over_limit) of every row.

    Counts are initial symbols minus merges, without begin and end; no identifiers
    are made. A null text counts as empty. Repeated rows each give a row; an empty
    table gives none; further columns are ignored.
    """
    rows, schema = _passed(docs, ident, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array([m.count(t) for t in texts], dtype=np.int64)
            size = np.array([len(t.encode("utf-8")) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[ident, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
