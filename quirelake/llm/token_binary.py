"""Token ids as files of frequency-ranked, byte-aligned variable-length integers.

Ids are renumbered by corpus frequency (rank 0 is the most frequent), so most take one byte.  A file is

    magic "QLTB0001", uint64 values, uint64 documents, uint64 data bytes,
    control bytes (four 2-bit lengths each, first value in the low bits; length 1 to 4 bytes),
    data bytes (little-endian, all values in order),
    document ids (int64) and token counts (int64) of its documents, in ascending order of id,

all little-endian; the rank table is a file of its own, int32 ids in rank order.  Decoding looks each control byte up
in a 256-row table of lengths and gathers all values of a file at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import _rows
from .tokens import encoder, vocabulary_size
from .warc import _filesystem
from .work import new_path, stored

MAGIC = b"QLTB0001"
ENCODED = "doc_id long, n_tokens long, ids binary"
FILES = "path string, part int, seq int, documents long, tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Lengths of the four values that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.int64) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] < size[:, None]]
    return np.bitwise_or.reduce(codes, axis=1).astype(np.uint8).tobytes() if len(values) else b"", data.tobytes()


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (max(0, len(padded) - 3), 4), (1, 1))[at]
    return np.ascontiguousarray(words).view("<u4").ravel() & MASKS[size]


def _encode(path: str, end_id: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for a, b, ids, sizes in tokens.runs(batch.column(1)):
                # the end mark follows each document's ids
                blob = pa.py_buffer(np.insert(ids, np.cumsum(sizes), end_id).astype(kind))
                ends = np.r_[0, np.cumsum(sizes + 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(sizes + 1), pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), blob])], ["doc_id", "n_tokens", "ids"]
                )

    return run


def _frequencies(wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def _write(folder: str, ranks, wide: bool, file_tokens: int):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _filesystem(folder)
        part, seq, held, size, files = TaskContext.get().partitionId(), 0, [], 0, []

        def close() -> None:
            # a name of its own for each attempt: a task that is run again leaves only unlisted files behind
            path = f"{base}/{uuid.uuid4().hex}.qltb"
            ids, counts = np.array([d if d is not None else np.iinfo(np.int64).min for d, _ in held], "<i8"), np.array([len(v) for _, v in held], "<i8")
            control, data = pack_values(np.concatenate([v for _, v in held]))
            with store.open_output_stream(path) as out:
                for x in (MAGIC, struct.pack("<QQQ", int(counts.sum()), len(held), len(data)), control, data, ids.tobytes(), counts.tobytes()):
                    out.write(x)
            files.append((path, part, seq, len(held), int(counts.sum())))

        rank = ranks.value
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = rank[np.frombuffer(blob.as_buffer(), kind)]
                held.append((doc, values))
                size += len(values)
                if size >= file_tokens:
                    close()
                    seq, held, size = seq + 1, [], 0
        if held:
            close()
        if files:
            yield _rows(files, FILES)

    return run


def read_file(raw: bytes, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, all token ids) of one file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    values, documents, size = struct.unpack_from("<QQQ", raw, 8)
    at = 32
    control, at = raw[at : at + -(-values // 4)], at + -(-values // 4)
    data, at = raw[at : at + size], at + size
    ids = np.frombuffer(raw, "<i8", documents, at)
    counts = np.frombuffer(raw, "<i8", documents, at + 8 * documents)
    return ids, counts, by_rank[unpack_values(control, data, values)]


def _read(folder: str, rank_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        with store.open_input_stream(rank_path) as f:
            by_rank = np.frombuffer(f.read(), "<i4").astype("<u4")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as f:
                    ids, counts, tokens = read_file(f.read(), by_rank)
                ends = np.cumsum(counts)
                raw = memoryview(tokens).cast("B")
                begin = ends - counts
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                null = ids == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(start + begin), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_tokens: int = 4 << 20) -> tuple[DataFrame, str]:
    """Encode and write; (files in order: path, start, documents, tokens; path of the rank table).

    Texts are encoded once.  What reaches the driver is a count for each id of the vocabulary and, as a broadcast,
    goes back as the rank table: both bounded by the vocabulary.
    """
    spark = docs.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    wide = size > 1 << 16
    encoded = stored(docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, wide), ENCODED), "encoded")
    found = encoded.select("ids").mapInArrow(_frequencies(wide), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["id"].to_numpy()] = found["n"].to_numpy()
    by_rank = np.lexsort((np.arange(size), -total)).astype("<i4")
    rank = np.empty(size, "<u4")
    rank[by_rank] = np.arange(size)
    folder = folder or new_path(spark, "tokens")
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    rank_path = f"{base}/ranks.i32"
    with store.open_output_stream(rank_path) as out:
        out.write(by_rank.tobytes())
    ordered = encoded.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    files = stored(ordered.mapInArrow(_write(folder, spark.sparkContext.broadcast(rank), wide, file_tokens), FILES), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder)), rank_path


def read_tokens(files: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    row = files.select("folder").head()
    folder = row.folder if row else rank_path.rpartition("/")[0]
    n = max(1, files.count())
    return files.select("path", "start").repartition(min(n, 10_000), "path").mapInArrow(_read(folder, rank_path), DOCUMENTS)


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in ascending doc_id order, read them back: one row per input row.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as little-endian
    uint32).  A null text is empty: its only id is the end id; a null doc_id comes first; rows repeated under one
    doc_id follow each other; other columns are ignored; an empty table gives no rows.
    """
    files, rank_path = write_tokens(docs, tokenizer, end_id)
    return read_tokens(files, rank_path)
