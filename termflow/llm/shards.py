"""Token-id files by bit-plane shuffling.

A file image holds consecutive documents: a header, the table of documents, a
chunk index, and for every block of ids its bit or byte planes, each compressed
with zstandard.  Images are binary values of a table in the shared folder, so
that any store Spark can write will do."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, store, table, text_of
from .tokens import codec, default_vocabulary

MAGIC = b"PLANE001"
HEAD = struct.Struct("<8sBIQII")  # magic, planes are bits, ids a block, ids, documents, blocks
BLOCK = 1 << 16
FILE_IDS = 1 << 20
END_ID = 0


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """32 bit planes or 4 byte planes of a block of ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(each, axis=1, bitorder="little")
    else:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(raw).view("<u4").ravel()


def write_image(doc_ids: list, counts: list[int], ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """The image of one file.  A null doc_id is kept by a flag."""
    press = zstandard.ZstdCompressor(level=3)
    blocks = [[press.compress(p) for p in planes_of(ids[i:i + block], bits)] for i in range(0, len(ids), block)]
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    index = np.cumsum([0, *[len(p) for b in blocks for p in b]]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(ids), len(docs), len(blocks)), null.tobytes(), docs.tobytes(),
                     np.array(counts, "<u4").tobytes(), index.tobytes(), *[p for b in blocks for p in b]])


class Image:
    """Reads an image; blocks are decompressed one by one through the chunk index."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, bits, self.block, self.n_ids, n, n_blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.planes = bool(bits), 32 if bits else 4
        at = HEAD.size
        null = np.frombuffer(self.data, np.uint8, n, at)
        docs = np.frombuffer(self.data, "<i8", n, at := at + n)
        self.doc_ids = [None if z else int(d) for z, d in zip(null, docs)]
        self.counts = np.frombuffer(self.data, "<u4", n, at := at + 8 * n).astype(np.int64)
        self.index = np.frombuffer(self.data, "<u8", n_blocks * self.planes + 1, at := at + 4 * n).astype(np.int64)
        self.body = at + 8 * len(self.index)

    def read_block(self, b: int) -> np.ndarray:
        n = min(self.block, self.n_ids - b * self.block)
        size = (n + 7) // 8 if self.bits else n
        press, k = zstandard.ZstdDecompressor(), b * self.planes
        planes = [press.decompress(bytes(self.data[self.body + self.index[i]:self.body + self.index[i + 1]]), max_output_size=size)
                  for i in range(k, k + self.planes)]
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n, from the blocks that hold them."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        got = np.concatenate([self.read_block(b) for b in range(first, last + 1)])
        return got[start - first * self.block:start - first * self.block + n]

    def documents(self):
        """(doc_id, start, ids) of every document, one pass over the blocks."""
        held, first, start = np.zeros(0, "<u4"), 0, 0
        b = 0
        for doc, n in zip(self.doc_ids, self.counts):
            parts = [held]
            have = first + len(held)
            while have < start + n:
                parts.append(self.read_block(b))
                have += len(parts[-1])
                b += 1
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield doc, start, held[start - first:start - first + n]
            start += n
            held, first = held[start - first:], start


def write_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                end_id: int = END_ID, file_ids: int = FILE_IDS, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """The table of files (part, file, n_ids, image), written to the shared folder.

    Parts are ranges of doc_id in ascending order (null first), files follow
    each other within a part; a file is closed once it has ``file_ids`` ids.
    Rows that repeat an id stand next to each other.
    """
    path = vocabulary or default_vocabulary()

    def run(frames):
        c = codec(path)
        end = np.array([end_id], "<u4")
        part = None
        docs_, counts, ids, size, file = [], [], [], 0, 0

        def close():
            image = write_image(docs_, counts, np.concatenate(ids), block, bits)
            return pd.DataFrame({"part": [part], "file": [file], "n_ids": [size], "image": [image]})

        for f in frames:
            known = f["doc_id"].astype("object").where(f["doc_id"].notna(), None)
            for doc, got, p in zip(known, c.encode_many(f["text"].tolist()), f["part"]):
                part = p
                docs_.append(doc)
                counts.append(len(got) + 1)
                ids += [got, end]
                size += len(got) + 1
                if size >= file_ids:
                    yield close()
                    docs_, counts, ids, size, file = [], [], [], 0, file + 1
        if docs_:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .withColumn("part", F.spark_partition_id()))
    return store(rows.mapInPandas(run, "part int, file int, n_ids long, image binary"))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Starts are prefix sums in two levels: over the parts, and over the files of a part."""
    def run(frames):
        for f in frames:
            for first, data in zip(f["first"], f["image"]):
                rows = [(doc, first + start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
                        for doc, start, ids in Image(data).documents()]
                got = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got

    sizes = store(files.select("part", "file", "n_ids"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "at", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    firsts = (sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .join(parts, "part").select("part", "file", (F.col("at") + F.col("in_part")).alias("first")))
    small = sizes.count() <= 100_000  # a row is 16 bytes
    rows = files.join(F.broadcast(firsts) if small else firsts, ["part", "file"]).select("first", "image")
    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op5_token_files")
def op5(spark, sf_dir):
    """Files of all documents (null text: only the end id), written and read back."""
    return read_files(write_files(table(spark, sf_dir, "documents")))
