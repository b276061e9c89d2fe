"""Operator 2, token-id output in training order: fixed-stride binary shards written by range partitions.

Texts are tokenised once; the ids of a partition's documents, each with its end id, are cut into sequences one after another,
so that only a partition's last sequence is padded, and stored as a table. A sequence's row number in it goes
through one keyed Feistel permutation with cycle walking over all sequences, which gives its global slot; from the slot
follow the shard, which is a range of slots, and the place in it. The task that gets a shard writes its file: a sequence's
bytes are at (slot - the shard's first slot) * stride, so reads are sequential and can resume anywhere. The sequences of a
document spread over all shards, so no id, text or source makes a large shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tokens import END_OF_TEXT, WordBpe
from .common import new_table_path, slices, stored
from .feistel import permuted, unpermute

SEQUENCE = 512
#: Sequences of a shard: 8 MB, which a task holds while it writes them. The last shard may have fewer.
SHARD_SEQUENCES = 8192
KEY = 31337
#: The stored sequences are read once: compressing them harder saves disk and costs some 30 CPU seconds a GB.
ZSTD_LEVEL = 7
#: Ids are little-endian unsigned 16-bit; unused places of a sequence hold this.
PADDING = 65535

#: One row a sequence: its ids without padding, and the documents' pieces in it, in order, as PIECE records.
SEQUENCES = "ids binary, pieces binary"
#: Whether the document has an id, that id, the piece's start and its length.
PIECE = np.dtype([("known", "u1"), ("doc", "<i8"), ("start", "<i8"), ("length", "<u4")])
#: What the writing tasks return; shard, byte_offset and path follow from the slot.
MANIFEST = "doc_id long, start long, length long, ids_crc32 long, slot long, offset long"


SHARD_NAME = "shard-%06d.bin"


def _write(folder: str, shard: int, data: bytes) -> None:
    """Write a shard's file whole, then give it its name: a task that is run again leaves the same file."""
    import uuid

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name, draft = f"{root}/{SHARD_NAME % shard}", f"{root}/.{SHARD_NAME % shard}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, name)


def read_slots(path: str, first: int, count: int, sequence: int = SEQUENCE) -> list[np.ndarray]:
    """The ids of `count` sequences of a shard's file from local slot `first` on, without padding."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        data = np.frombuffer(f.read_at(count * sequence * 2, first * sequence * 2), "<u2").reshape(-1, sequence)
    return [row[: int((row != PADDING).sum())] for row in data]


def sequences(docs: DataFrame, tokenizer_path: str, sequence: int, id_col: str, text_col: str) -> DataFrame:
    """SEQUENCES: the ids of every text and its end id, one document after another, cut every `sequence` ids."""

    def run(batches):
        bpe = WordBpe.opened(tokenizer_path)
        end = np.array([END_OF_TEXT], np.uint32)
        held, info = [], []  # ids of the open sequence, and the pieces they are from
        rows: list[tuple[bytes, bytes]] = []
        size = 0

        def close():
            rows.append((np.concatenate(held).astype("<u2").tobytes(), np.array(info, PIECE).tobytes()))
            held.clear()
            info.clear()

        def out():
            ids, pieces = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(pieces, pa.binary())], ["ids", "pieces"])

        for batch in slices(batches):
            for doc, own in zip(batch.column(0).to_pylist(), bpe.many(batch.column(1).to_pylist()), strict=True):
                ids, at = np.concatenate((own, end)), 0
                while at < len(ids):
                    n = min(len(ids) - at, sequence - size)
                    held.append(ids[at : at + n])
                    info.append((doc is not None, doc or 0, at, n))
                    at += n
                    size += n
                    if size == sequence:
                        close()
                        size = 0
                if len(rows) >= 512:
                    yield out()
        if info:
            close()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SEQUENCES)


def with_row_numbers(table: DataFrame) -> tuple[DataFrame, int]:
    """A table read from files with `row`, gapless from 0 by file name and place in the file, and the row count. Nothing is
    moved; the driver sees one count a file."""
    placed = table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    firsts, total = [], 0
    for name, count in sorted(tuple(r) for r in placed.groupBy("__file").count().collect()):
        firsts.append((name, total))
        total += count
    firsts = table.sparkSession.createDataFrame(firsts, "__file string, __first long")
    out = placed.join(F.broadcast(firsts), "__file").withColumn("row", F.col("__first") + F.col("__index"))
    return out.drop("__file", "__first", "__index"), total


def write_training_order(docs: DataFrame, tokenizer_path: str, folder: str | None = None, sequence: int = SEQUENCE, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns one row per piece of a document in a sequence: doc_id, start (its document's ids before
    it), length, ids_crc32 (of the ids as unsigned 32-bit), slot, offset (ids before it in the sequence), shard,
    byte_offset (of the sequence in the shard), path.

    Every id of every document, the end id included, is in exactly one piece. Null texts are empty and give a piece of the
    end id alone. Ids may be null or repeated; an empty table gives no rows and no files. Other columns are ignored. The
    folder is a URI all executors can write to; by default a new one below the shared folder. The result is a
    stored table: the files are there when it is returned, and are not written again when it is used. The order is the
    same for every run over the same input partitions, and a task that is run again writes the same file.
    """
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "shards")
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    pieces, total = with_row_numbers(stored(sequences(docs, tokenizer_path, sequence, id_col, text_col), "sequences", ZSTD_LEVEL))
    each = SHARD_SEQUENCES
    slotted = pieces.withColumn("slot", permuted(F.col("row"), total, key)).withColumn("shard", F.floor(F.col("slot") / F.lit(each)).cast("int"))
    dealt = slotted.repartition("shard").sortWithinPartitions("slot").select("shard", "slot", "ids", "pieces")

    def write(batches):
        shard, data, info = None, None, []

        def finish():
            _write(folder, shard, data.tobytes())
            slots = np.repeat(np.array([i[0] for i in info], "<i8"), [len(i[1]) for i in info])
            pieces, crcs = np.concatenate([i[1] for i in info]), np.concatenate([i[2] for i in info])
            length = pieces["length"].astype("<i8")
            before = np.cumsum(length) - length
            first = np.concatenate(([True], slots[1:] != slots[:-1]))
            offset = before - before[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            doc = pa.array(pieces["doc"].copy(), mask=pieces["known"] == 0)
            cols = [doc, *(pa.array(c) for c in (pieces["start"].copy(), length, crcs, slots, offset))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "slot", "offset"])

        for batch in slices(batches):
            for s, slot, ids, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if shard is not None:
                        yield finish()
                    shard, info = s, []
                    data = np.full((min(each, total - s * each), sequence), PADDING, "<u2")
                own = np.frombuffer(ids, "<u2")
                data[slot - s * each, : len(own)] = own
                wide, pieces = own.astype("<u4").tobytes(), np.frombuffer(pieces, PIECE)
                ends = (4 * np.cumsum(pieces["length"].astype("<i8"))).tolist()
                info.append((slot, pieces, np.array([zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends, strict=False)], "<i8")))
        if shard is not None:
            yield finish()

    out = stored(dealt.mapInArrow(write, MANIFEST), "manifest")
    out = out.withColumn("shard", F.floor(F.col("slot") / each).cast("int")).withColumn("byte_offset", F.col("slot") % each * (2 * sequence))
    out = out.withColumn("path", F.format_string(f"{folder.replace('%', '%%')}/{SHARD_NAME}", "shard"))
    return out.withColumnRenamed("doc_id", id_col)


def row_at(slot: int, total: int, key: int = KEY) -> int:
    """The row number of the sequence at a slot, of all there are."""
    return unpermute(slot, total, key)
