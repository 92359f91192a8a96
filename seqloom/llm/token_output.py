"""Token-id files: ids are replaced by frequency ranks and coded in 1 to 4 bytes, with the lengths in separate control bytes.

A file is a run of blocks. A block: magic, number of documents, number of ids, bytes of data (u32, u32, u32, u64), then each
document's id (i64) and number of ids (u32), then control bytes (2 bits an id: its length less 1, four ids a byte; each document
begins a byte), then the data bytes, little-endian. `ranks.bin` beside the files holds the id of each rank (u32). Decoding looks up the four lengths of a control
byte in a table and gathers all ids of a block with numpy.

Texts are encoded once, into a table of ids in the shared folder. One pass over it counts ids; a second deals the documents into ranges of
(doc_id, hash of the ids), by a sample that Spark takes, codes them by rank and writes each range as files of about FILE_IDS ids. A
file is written under a name of its own attempt, and only files that the job returns are listed, so lost executors do no harm.

Defined results: a null text is empty and has the end id alone; documents with one doc_id or a null one stay next to each
other, nulls first, and are in order of a hash of their ids, so that many of them are no task's alone; repeated rows are written each; ids that occur equally often are ranked by their number;
very long texts are taken whole; an empty table gives no files and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from . import common, tokens

END_ID, MAGIC, BLOCK_IDS, FILE_IDS = 2, 0x314B4F54, 1 << 19, 64_000_000
NULL_ID = -(1 << 63)

# ---- coding


def _lengths() -> np.ndarray:
    codes = np.arange(256)
    return np.stack([(codes >> (2 * i) & 3) + 1 for i in range(4)], 1).astype(np.uint8)


LENGTHS = _lengths()


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    short = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    short[: len(n)] = n - 1
    control = short[0::4] | short[1::4] << 2 | short[2::4] << 4 | short[3::4] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) < n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents again; counts: how many each has."""
    counts = counts.astype(np.int64)
    n, bytes_ = int(counts.sum()), -(-counts // 4)
    # where a document's ids lie among the lengths, as each begins a control byte
    shift = np.repeat(4 * (np.cumsum(bytes_) - bytes_) - (np.cumsum(counts) - counts), counts)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[shift + np.arange(n)]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(docs: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """Of (doc id, number of ids, control bytes, data bytes)."""
    data = b"".join(x[3] for x in docs)
    head = np.array([MAGIC, len(docs), sum(x[1] for x in docs)], "<u4").tobytes() + np.array([len(data)], "<u8").tobytes()
    return b"".join([head, np.array([x[0] for x in docs], "<i8").tobytes(), np.array([x[1] for x in docs], "<u4").tobytes(), *(x[2] for x in docs), data])


def read_blocks(f, id_of: np.ndarray):
    """Of each block: doc ids, lengths, and the ids of all its documents."""
    while head := f.read(20):
        magic, docs, _ = np.frombuffer(head, "<u4", 3).tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        size = int(np.frombuffer(head, "<u8", 1, 12)[0])
        doc_ids, n = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(4 * docs), "<u4")
        control = f.read(int((-(-n.astype(np.int64) // 4)).sum()))
        yield doc_ids, n, id_of[unpack(control, f.read(size), n)]


# ---- storage: any file system that pyarrow reaches by the address of the shared folder


def storage(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if ":" in address else "file://" + address)


# ---- operator


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids: the ids of every document, the end id included, as bytes (u16, or u32 for a vocabulary over 65,536), and their width."""

    def run(batches):
        enc, end = tokens.encoder(path), np.array([end_id], np.uint32)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            texts, out = common.texts(batch), []
            for part in tokens.blocks(texts):
                out += [np.concatenate((x, end)).astype(kind).tobytes() for x in enc.encode(texts[part])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array([int(kind[2])] * len(out), pa.int32())], names=["doc_id", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, width int")


def count_ids(table: DataFrame) -> np.ndarray:
    """How often each id occurs. What reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{batch.column('width')[0].as_py()}"), minlength=len(total))
                n[: len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = table.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Writes the files; returns (name, first position of its ids, number of ids) of each in order of doc_id."""
    spark = docs.sparkSession
    table = common.stage(encoded(docs, path, end_id), "ids")
    counts = count_ids(table)
    id_of = np.argsort(-counts, kind="stable").astype("<u4")
    rank = np.empty(len(id_of), np.uint32)
    rank[id_of] = np.arange(len(id_of), dtype=np.uint32)
    fs, at = storage(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/ranks.bin") as f:
        f.write(id_of.tobytes())
    shared = spark.sparkContext.broadcast(rank)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), "h"]
    df = table.withColumn("h", F.xxhash64("ids")).repartitionByRange(4 * tasks, *keys).sortWithinPartitions(*keys, "ids")

    def run(batches):
        from pyspark import TaskContext

        part, out, name, f, n, waiting, size = TaskContext.get().partitionId(), [], "", None, 0, [], 0
        fs, at = storage(folder)

        def flush():
            nonlocal waiting, size
            if waiting:
                f.write(block_bytes(waiting))
                waiting, size = [], 0

        def close():
            nonlocal f, n
            flush()
            f.close()
            out.append((part, len(out), name, n))
            f, n = None, 0

        for batch in batches:
            for doc_id, ids, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width"))):
                ids = np.frombuffer(ids, f"<u{width}")
                if f is None:
                    name = f"part-{part:08d}-{len(out):06d}-{uuid.uuid4().hex}.bin"
                    f = fs.open_output_stream(f"{at}/{name}")
                waiting.append((NULL_ID if doc_id is None else doc_id, len(ids), *pack(shared.value[ids])))
                n, size = n + len(ids), size + len(ids)
                if size >= BLOCK_IDS:
                    flush()
                if n >= file_ids:
                    close()
        if f is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["r", "k", "name", "n"])

    files, start = [], 0
    for r in sorted(df.select("doc_id", "ids", "width").mapInArrow(run, "r long, k long, name string, n long").collect()):
        files.append((r.name, start, r.n))
        start += r.n
    return files


def read(spark, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    kind = schema("doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(files or [("", 0, 0)], "name string, start long, n long").where(F.col("n") > 0)
    spread = listed.repartition(max(1, min(len(files), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def run(batches):
        fs, at = storage(folder)
        id_of = None
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                if id_of is None:
                    with fs.open_input_stream(f"{at}/ranks.bin") as f:
                        id_of = np.frombuffer(f.read(), "<u4")
                with fs.open_input_stream(f"{at}/{name}") as f:
                    for doc_ids, n, ids in read_blocks(f, id_of):
                        data, ends = memoryview(ids.astype("<u4").view(np.uint8)), np.cumsum(n.astype(np.int64))
                        crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                        begin = start + ends - n
                        start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(begin, pa.int64()), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, kind)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents into a new folder of the shared ones and reads them back."""
    spark = docs.sparkSession
    folder = common.new_folder(spark, "tokens")
    return read(spark, folder, write(docs, folder, path))
