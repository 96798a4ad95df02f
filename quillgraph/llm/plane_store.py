"""Token ids in files of shuffled planes.

Documents are dealt by ranges of doc_id, encoded, and gathered into segments of whole
documents. A segment's ids are cut into blocks of fixed size; each block is transposed into
bit planes or byte planes, each plane is compressed with zstandard, and an index holds where
every plane of every block starts. A segment is one row of a Parquet file, so Spark's commit
protocol covers retried tasks and any store that Spark reaches can hold the files; blocks
can be read one by one by means of the index.

Columns of the files: shard and segment (in order of doc_id), first_id (ids of the shard
before the segment), doc_ids and n_tokens (parallel lists), width (bytes an id), planes
("bit" or "byte"), block (ids a block), n_ids, index (offsets into data, one more than
blocks times planes), data.

Defined results: a null text is empty and consists of the end id alone; null doc_ids come
first; rows with equal doc_id all appear, ordered by text. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, small_batches, texts, tidied
from .tokens import default_vocabulary, encoder

SEGMENT, BLOCK = 1 << 18, 1 << 16  #: ids
SHARD_BYTES = 32 << 20  #: of text in a shard, about
STORE = "shard int, segment int, first_id bigint, doc_ids array<bigint>, n_tokens array<bigint>, width int, planes string, block int, n_ids bigint, index array<bigint>, data binary"


def shuffled(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of one block; bits are padded to whole bytes with zeros."""
    raw = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(ids.itemsize)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(bits.shape[1])]


def unshuffled(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel()


def compressed(ids: np.ndarray, planes: str, block: int = BLOCK) -> tuple[bytes, list[int]]:
    import zstandard

    pack, frames, index = zstandard.ZstdCompressor(level=1).compress, [], [0]
    for at in range(0, len(ids), block):
        for plane in shuffled(np.ascontiguousarray(ids[at : at + block]), planes):
            frames.append(pack(plane))
            index.append(index[-1] + len(frames[-1]))
    return b"".join(frames), index


def decompressed(data: bytes, index: list[int], n: int, width: int, planes: str, block: int = BLOCK) -> np.ndarray:
    import zstandard

    unpack, each = zstandard.ZstdDecompressor().decompress, width * (8 if planes == "bit" else 1)
    out = [np.zeros(0, f"<u{width}")]
    for k in range(0, len(index) - 1, each):
        size = min(block, n - k // each * block)
        out.append(unshuffled([unpack(data[a:z]) for a, z in zip(index[k : k + each], index[k + 1 : k + each + 1])], size, width, planes))
    return np.concatenate(out)


def encode_store(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, planes: str = "byte") -> DataFrame:
    """Segments of all documents, ``end_id`` after each (columns of STORE)."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows that share an id are dealt by how their texts begin, which agrees with their order
    dealt = rows.repartitionByRange(max(parallelism(docs.sparkSession), size // SHARD_BYTES), "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype)
        segment, first, docs_, counts, parts, size = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data, index = compressed(ids, planes)
            row = {"shard": shard, "segment": segment, "first_id": first, "doc_ids": docs_, "n_tokens": counts, "width": ids.itemsize, "planes": planes, "block": BLOCK, "n_ids": len(ids), "index": index, "data": data}
            schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("width", pa.int32()), ("planes", pa.string()), ("block", pa.int32()), ("n_ids", pa.int64()), ("index", pa.list_(pa.int64())), ("data", pa.binary())])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                docs_.append(doc)
                counts.append(len(ids) + 1)
                parts += [ids, end]
                size += len(ids) + 1
                if size >= SEGMENT:
                    yield flush()
                    segment, first, docs_, counts, parts, size = segment + 1, first + size, [], [], [], 0
        if parts:
            yield flush()

    return dealt.mapInArrow(tidied(run), STORE)


def decode_store(store: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Documents read back: doc_id, start (ids before it), n_tokens, ids_crc32, and with ``keep_ids`` ids."""
    small_batches(store.sparkSession)
    fields = [("shard", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if keep_ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decompressed(row["data"], row["index"], row["n_ids"], row["width"], row["planes"], row["block"]).astype("<u4")
                edge = np.concatenate(([0], np.cumsum(row["n_tokens"]))).astype(np.int64)
                if edge[-1] != len(ids):
                    raise ValueError(f"segment {row['shard']}/{row['segment']}: {len(ids)} ids, {edge[-1]} expected")
                cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
                view = memoryview(ids).cast("B")
                columns = [pa.array([row["shard"]] * len(cuts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + edge[:-1]), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(view[4 * a : 4 * z]) for a, z in cuts], pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = store.mapInArrow(tidied(run), "shard int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids)
    # a row for each shard: as many as there are partitions, so the broadcast stays small
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return out.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, planes: str = "byte") -> None:
    """Write the files of ``docs`` below ``path``."""
    encode_store(docs, vocabulary, end_id, planes).write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, planes: str = "byte") -> DataFrame:
    """Write the files to the shared folder, read them back and digest each document's ids."""
    return decode_store(materialize(encode_store(docs, vocabulary, end_id, planes), "planes", codec="uncompressed"), keep_ids=False)
