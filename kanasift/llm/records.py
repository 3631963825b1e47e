"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard file holds records one after another:

    length of the payload   8 bytes, unsigned, little-endian
    masked CRC-32 of those 8 bytes   4 bytes
    payload
    masked CRC-32 of the payload     4 bytes

with payload = doc_id (8 bytes, signed), flags (1 byte: 1 if doc_id is null, 2 if ids take 4 bytes, else 2
bytes each), ids. The index file beside it has 24 bytes a record: doc_id, offset of the record, ids of the
shard before it. Records are in ascending doc_id order over shards and within them, null first.

A shard's files have the name of the attempt that wrote them, and only those of attempts that succeeded stand in
the shards' table, so nothing is ever renamed or written over; what lost attempts left is removed at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import new_path, written
from .tokens import batches_of_texts, encoder

END = (2).to_bytes(4, "little")
_HEAD, _ENTRY = "<QI", "<qQQ"
_ENTRIES = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("start", "<u8")])
SHARDS = "shard int, file string, records long, tokens long"
#: Bytes of text of a shard; there are as many shards as shuffle partitions at least.
SHARD_BYTES = 1 << 28
#: Records that are read at once, and their bytes unless one has more.
RUN, RUN_BYTES = 2000, 1 << 25
#: Characters of a text by which documents of one doc_id are dealt out.
FRONT = 32


def masked(data: bytes) -> int:
    """A CRC-32 rotated and shifted, so that checksums of data that hold checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record; ids are little-endian unsigned 32-bit integers."""
    x = np.frombuffer(ids, "<u4")
    wide = bool(len(x)) and int(x.max()) > 0xFFFF
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * wide) + (ids if wide else x.astype("<u2").tobytes())
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, bytes, int]:
    """(doc_id, ids, where the next record begins) of the record at `at`; ValueError if it is damaged or cut off."""
    if len(data) < at + struct.calcsize(_HEAD):
        raise ValueError("a record is cut off")
    n, check = struct.unpack_from(_HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError("a record's length is damaged")
    at += struct.calcsize(_HEAD)
    if len(data) < at + n + 4:
        raise ValueError("a record is cut off")
    payload = bytes(data[at : at + n])
    if masked(payload) != struct.unpack_from("<I", data, at + n)[0]:
        raise ValueError("a record's payload is damaged")
    doc_id, flags = struct.unpack_from("<qB", payload)
    ids = payload[9:] if flags & 2 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes()
    return None if flags & 1 else doc_id, ids, at + n + 4


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, uri: str | None = None, shards: int | None = None, path: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text), encoded and ended by id 2, in ascending doc_id order; returns the shards' table.

    The texts are dealt by range before they are encoded, so only texts move: by doc_id, the text's first
    characters and the place in the input, so that many rows of one doc_id or none are dealt to many shards. Null
    texts are empty; repeated rows are records each; ties of doc_id come in order of their texts' first FRONT
    characters; no rows give no records; other columns are ignored.
    """
    spark = docs.sparkSession
    uri = uri or new_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = rows.select("*", F.substring("text", 1, FRONT).alias("front"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(shards, "doc_id", "front", "place").sortWithinPartitions("doc_id", "front", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        code, shard = encoder(path), context.partitionId()
        store, base = _store(uri)
        store.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{context.taskAttemptId()}"
        records = tokens = at = 0
        with store.open_output_stream(f"{base}/{name}.rec") as data, store.open_output_stream(f"{base}/{name}.idx") as index:
            for b in batches:
                doc_ids = b.column(0).to_pylist()
                for first, some in batches_of_texts(b.column(1).to_pylist()):
                    for doc_id, ids in zip(doc_ids[first : first + len(some)], code.encode(some), strict=True):
                        ids += END
                        record = frame(doc_id, ids)
                        data.write(record)
                        index.write(struct.pack(_ENTRY, doc_id or 0, at, tokens))
                        at += len(record)
                        tokens += len(ids) // 4
                        records += 1
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{uri}/{name}", pa.string()), (records, pa.int64()), (tokens, pa.int64()))], names=["shard", "file", "records", "tokens"])

    made = written(rows.mapInArrow(run, SHARDS), "shards")
    _sweep(uri, made)
    return made


def _sweep(uri: str, shards: DataFrame) -> None:
    """Removes files of attempts that no row of the shards' table names."""
    from pyarrow import fs

    store, base = _store(uri)
    named = {r[0].rsplit("/", 1)[1] for r in shards.select("file").toLocalIterator()}
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.rsplit(".", 1)[0] not in named:
            store.delete_file(info.path)


def read_records(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files and checked against the index.

    start counts the ids of all records before it: a sum over the shards' rows, of which there are few.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = shards.withColumn("before", before).select("file", "before", "records").where("records > 0")
    rows = rows.repartition(max(1, shards.count()), "file")

    def run(batches):
        for b in batches:
            for file, base, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, local = _store(file)
                if (size := store.get_file_info(f"{local}.idx").size) != records * _ENTRIES.itemsize:
                    raise ValueError(f"{file} has {size / _ENTRIES.itemsize} records, not {records}")
                at, size = 0, store.get_file_info(f"{local}.rec").size
                with store.open_input_file(f"{local}.rec") as f, store.open_input_file(f"{local}.idx") as index:
                    k = 0
                    while k < records:
                        entries = np.frombuffer(index.read_at(min(RUN + 1, records - k) * _ENTRIES.itemsize, k * _ENTRIES.itemsize), _ENTRIES)
                        ends = np.r_[entries["at"][1:], [] if k + len(entries) < records else size].astype(np.int64)
                        some = max(1, int(np.searchsorted(ends, at + RUN_BYTES, side="right")))
                        data, out, here = memoryview(f.read(int(ends[some - 1]) - at)), [], 0
                        for e in entries[:some]:
                            if at + here != int(e["at"]):
                                raise ValueError(f"{file}: the index does not fit")
                            doc_id, ids, here = unframe(data, here)
                            out.append((doc_id, base + int(e["start"]), len(ids) // 4, zlib.crc32(ids)))
                        at += len(data)
                        k += some
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(file: str, positions: list[int]) -> list[tuple[int | None, list[int]]]:
    """Records of one shard by position, in the order asked: a shuffled read through the offset index."""
    store, local = _store(file)
    entries = np.frombuffer(store.open_input_file(f"{local}.idx").read(), _ENTRIES)
    size, out = store.get_file_info(f"{local}.rec").size, []
    with store.open_input_file(f"{local}.rec") as f:
        for p in positions:
            at, end = int(entries["at"][p]), int(entries["at"][p + 1]) if p + 1 < len(entries) else size
            f.seek(at)
            doc_id, ids, _ = unframe(memoryview(f.read(end - at)), 0)
            out.append((doc_id, np.frombuffer(ids, "<u4").tolist()))
    return out
