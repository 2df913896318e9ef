"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import texts_of
from .packing import codec


def _encode(path: str, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, len(doc_ids), 500):
                ids = [c.encode(t) for t in texts_of(batch.column(1)[at : at + 500])]
                own = pa.array(doc_ids[at : at + 500], pa.int64())
                if digest:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    yield pa.RecordBatch.from_arrays([own, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i) for i in ids]), pa.array([sha(c.decode(i)) for i in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
                    yield pa.RecordBatch.from_arrays([own, pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            raw = [None if x is None else c.decode(np.array(x, "<u4").tobytes()) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return run


def _offsets(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in c.offsets(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "offsets"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text); a null or empty text has no ids; repeated rows each have a row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path, pattern, False), "doc_id long, ids array<int>")


def token_offsets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and each token's first and end character; tokens that split a character all span it."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_offsets(path, pattern), "doc_id long, offsets array<struct<start:int,end:int>>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and raw, the bytes of the ids; null ids stay null."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, raw binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each row's ids and of the bytes decoded from them."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
