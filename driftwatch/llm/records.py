"""Length-delimited binary records with masked checksums and an offset index.

A record file is a run of frames

    length   unsigned 64-bit, little-endian
    masked CRC-32C of the length, unsigned 32-bit
    payload  ``length`` bytes: token ids, little-endian, 2 bytes each if the
             vocabulary allows it, else 4
    masked CRC-32C of the payload, unsigned 32-bit

and beside it stands an index file of fixed 24-byte entries (document id as
signed 64-bit, offset of the frame as unsigned 64-bit, number of ids as unsigned
64-bit), so a shuffled reader can seek to any record. Mask: the checksum
rotated right by 15 bits, plus a constant, modulo 2^32.

Spark sorts the documents by id over the files (range partitions, so file k
holds smaller ids than file k + 1); each task encodes its rows as a stream,
writes one file of each kind under a name of its own attempt and moves both into
place when complete. A task that is lost is run again and writes the same.
Paths are those of the shared folder, opened with ``pyarrow.fs``.
"""
from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.tokens import encoder
from driftwatch.session import checkpoint_dir, cut_lineage

MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78
BLOCK = 512
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
#: Stands for a null id in the index file.
NO_ID = -(1 << 63)
#: Bytes of text to one record file.
FILE_BYTES = 16 << 20
#: Tasks that read; beyond it a task reads several files, one after the other.
MOST_TASKS = 20_000
#: Rows to one Arrow batch that is given back.
ROWS_OUT = 8192


class Crc32c:
    """CRC-32C by its linearity. The start value is XORed into the first four
    bytes; from state 0, zeros in front change nothing, so the data are padded
    to whole blocks. A block's checksum is the XOR of one table entry per (byte,
    bytes that follow in the block), all gathered at once, and blocks are chained
    by moving the state over ``BLOCK`` zero bytes."""

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
        rows = [one]
        for _ in range(BLOCK - 1):
            rows.append(one[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
        self.one, self.table = one.tolist(), np.concatenate(rows)
        self.place = np.arange(BLOCK - 1, -1, -1, dtype=np.intp) * 256
        self.move = []
        for k in range(4):
            state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(BLOCK):
                state = one[state & 0xFF] ^ (state >> 8)
            self.move.append(state.tolist())

    def __call__(self, data: bytes) -> int:
        if len(data) < 32:
            state = 0xFFFFFFFF
            for byte in data:
                state = self.one[(state ^ byte) & 0xFF] ^ (state >> 8)
            return state ^ 0xFFFFFFFF
        pad = -len(data) % BLOCK
        a = np.zeros(pad + len(data), np.uint8)
        a[pad:] = np.frombuffer(data, np.uint8)
        a[pad:pad + 4] ^= 0xFF
        at = a.astype(np.intp).reshape(-1, BLOCK)
        at += self.place
        parts = np.bitwise_xor.reduce(self.table.take(at, mode="clip"), axis=1).tolist()
        state, (m0, m1, m2, m3) = parts[0], self.move
        for part in parts[1:]:
            state = m0[state & 0xFF] ^ m1[(state >> 8) & 0xFF] ^ m2[(state >> 16) & 0xFF] ^ m3[state >> 24] ^ part
        return state ^ 0xFFFFFFFF


_CRC: list[Crc32c] = []


def masked_crc(data: bytes) -> int:
    if not _CRC:
        _CRC.append(Crc32c())
    c = _CRC[0](data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(source) -> bytes | None:
    """The next payload, None at the end; ValueError if a checksum doesn't fit."""
    head = source.read(12)
    if not head:
        return None
    length, check = struct.unpack("<QI", head)
    if check != masked_crc(head[:8]):
        raise ValueError("length checksum")
    payload = source.read(length)
    (check,) = struct.unpack("<I", source.read(4))
    if len(payload) != length or check != masked_crc(payload):
        raise ValueError("payload checksum")
    return payload


def _filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          blanks: str = "drop", lower: bool = True, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` in ascending id order; returns the manifest, one row per file:
    ``(part, file, n_docs, n_tokens)``.

    A null or empty text becomes the end id alone; null ids come first; rows
    with equal ids follow each other by their text; an empty table writes no file.
    """
    from tokenizers import Tokenizer
    if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) > 1 << 8 * width:
        raise ValueError(f"ids of this vocabulary do not fit {width} bytes")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # one number
    parts = int(size // file_bytes) + 1
    kind = f"<u{width}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        system, root = _filesystem(folder)
        name, attempt = f"part-{part:06d}", uuid.uuid4().hex
        enc, end, at, total, entries, out = encoder(vocabulary, blanks, lower), struct.pack("<I", end_id), 0, 0, [], None
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/.{name}.{attempt}.rec")
                    ids = np.frombuffer(enc.ids(text.as_py()) + end, "<u4")
                    framed = frame(ids.astype(kind).tobytes())
                    out.write(framed)
                    key = doc_id.as_py()
                    entries.append((NO_ID if key is None else key, at, len(ids)))
                    at, total = at + len(framed), total + len(ids)
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        with system.open_output_stream(f"{root}/.{name}.{attempt}.idx") as index:
            index.write(np.array(entries, ENTRY).tobytes())
        for ending in ("idx", "rec"):
            system.move(f"{root}/.{name}.{attempt}.{ending}", f"{root}/{name}.{ending}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(entries)], "n_tokens": [total]})

    return cut_lineage(rows.mapInArrow(store, "part long, file string, n_docs long, n_tokens long"))


def read(manifest: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """Read the files of a manifest back: ``(doc_id, start, n_tokens, ids binary)`` per record,
    ids as little-endian unsigned 32-bit, ``start`` the ids of all records before it.
    Every checksum is verified, and every frame against its index entry."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # a number of its own: the manifest is so small that one chosen by the planner is one task
    files = files.repartition(min(2 * manifest.count() or 1, MOST_TASKS), "part")
    kind = f"<u{width}"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                start, at, out = row["base"], 0, []
                with system.open_input_stream(f"{root}/{row['file']}.rec") as f:
                    for doc_id, offset, n in index.tolist():
                        payload = read_frame(f)
                        if offset != at or payload is None or len(payload) != n * width:
                            raise ValueError(f"{row['file']}: record at {at} and index disagree")
                        ids = np.frombuffer(payload, kind).astype("<u4").tobytes()
                        out.append((None if doc_id == NO_ID else doc_id, start, n, ids))
                        start, at = start + n, at + len(payload) + 16
                        if len(out) >= ROWS_OUT or len(ids) > 1 << 20:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("file", "base").mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def digests(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what was read."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
