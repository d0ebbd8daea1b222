"""Array files (S12) and array bundles (K5, K6) as a Python data source.

``array_vectors`` reads a ``.npy`` matrix, a row a vector, with the ids of a sidecar
``.npy``, in partitions that are byte ranges of the file, and writes bundles: every
task writes a matrix and an id file of its own, and the commit makes them visible by
one ``meta.json`` that names them.  Files are opened through Arrow's file systems, so
any path that those know will do."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship_package

FORMAT = "array_vectors"
SCHEMA = "id string, vector array<float>"
#: Bytes of an array file that one task reads.
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 4096
META = "meta.json"


def _at(path: str):
    """(file system, path in it)."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Header:
    """Where the rows of a ``.npy`` file lie."""

    def __init__(self, path: str):
        system, name = _at(path)
        with system.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, fortran, self.dtype = read(f)
            self.start = f.tell()
        if fortran or self.dtype.hasobject:
            raise ValueError(f"{path}: an array in row order of plain values is needed")
        self.path, self.rows = path, self.shape[0]
        self.row_bytes = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def read(self, first: int, rows: int) -> np.ndarray:
        system, name = _at(self.path)
        with system.open_input_file(name) as f:
            f.seek(self.start + first * self.row_bytes)
            data = f.read(rows * self.row_bytes)
        return np.frombuffer(data, self.dtype).reshape(rows, *self.shape[1:])


class Slice(InputPartition):
    def __init__(self, vectors: str, ids: str, first: int, rows: int):
        super().__init__(None)
        self.vectors, self.ids, self.first, self.rows = vectors, ids, first, rows


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        path, split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        if path.endswith(".npy"):
            pairs = [(path, options["ids"])]
        else:
            system, name = _at(path)
            with system.open_input_file(f"{name}/{META}") as f:
                meta = json.loads(f.read())
            pairs = [(f"{path}/{p['vectors']}", f"{path}/{p['ids']}") for p in meta["parts"]]
        self.slices = []
        for vectors, ids in pairs:
            v, i = Header(vectors), Header(ids)
            if len(v.shape) != 2:
                raise ValueError(f"{vectors}: a matrix is needed, not {len(v.shape)} dimensions")
            if v.rows != i.rows:
                raise ValueError(f"{vectors} has {v.rows} rows, its ids {ids} have {i.rows}")
            step = max(1, split // max(1, v.row_bytes))
            self.slices += [Slice(vectors, ids, a, min(step, v.rows - a)) for a in range(0, v.rows, step)]

    def partitions(self):
        return self.slices or [Slice("", "", 0, 0)]

    def read(self, part):
        if not part.rows:
            return
        vectors, ids = Header(part.vectors), Header(part.ids)
        for a in range(part.first, part.first + part.rows, BATCH_ROWS):
            n = min(BATCH_ROWS, part.first + part.rows - a)
            v = vectors.read(a, n).astype(np.float32)
            flat = pa.array(v.ravel(), pa.float32())
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in ids.read(a, n).tolist()], pa.string()),
                                              pa.ListArray.from_arrays(offsets, flat)], ["id", "vector"])


class Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int, width: int | None):
        self.name, self.rows, self.width = name, rows, width


class ArrayWriter(DataSourceArrowWriter):
    """Tasks write ``part-<name>.vectors.npy`` and ``.ids.npy``; nothing is read that ``meta.json`` does not name."""

    def __init__(self, options):
        self.path = options["path"]
        self.dtype = np.dtype(options.get("dtype", "float32"))
        self.names = json.loads(options.get("featurenames", "null"))

    def _save(self, name: str, array: np.ndarray) -> None:
        system, path = _at(f"{self.path}/{name}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            np.lib.format.write_array(f, array, allow_pickle=False)

    def write(self, batches):
        name, ids, vectors = f"part-{uuid.uuid4().hex}", [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            vectors.append(np.array(b.column(1).to_pylist(), self.dtype).reshape(b.num_rows, -1))
        if not ids:
            return Part(name, 0, None)
        if None in ids:
            raise ValueError("a vector without id")
        if len({v.shape[1] for v in vectors}) > 1:
            raise ValueError("vectors of different lengths")
        self._save(f"{name}.vectors.npy", np.concatenate(vectors))
        self._save(f"{name}.ids.npy", np.array([i.encode() for i in ids]))
        return Part(name, len(ids), vectors[0].shape[1])

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        widths = {m.width for m in parts}
        if len(widths) > 1 or self.names is not None and widths and widths != {len(self.names)}:
            self.abort(messages)
            raise ValueError(f"vectors of {sorted(widths)} entries")
        meta = {"rows": sum(m.rows for m in parts), "width": max(widths, default=0), "dtype": str(self.dtype), "features": self.names,
                "parts": [{"vectors": f"{m.name}.vectors.npy", "ids": f"{m.name}.ids.npy", "rows": m.rows} for m in parts]}
        system, path = _at(f"{self.path}/{META}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(json.dumps(meta, indent=1).encode())

    def abort(self, messages):
        for m in messages:
            if m is not None and m.rows:
                for kind in ("vectors", "ids"):
                    system, path = _at(f"{self.path}/{m.name}.{kind}.npy")
                    system.delete_file(path)


class ArrayVectors(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArrayReader(dict(self.options))

    def writer(self, schema, overwrite):
        return ArrayWriter(dict(self.options))


def read_vectors(spark: SparkSession, path: str, ids: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, vector) of a ``.npy`` matrix and its id sidecar, or of a bundle folder.  Entries of any
    width are widened (or narrowed) to float; another number of ids than rows raises."""
    ship_package(spark)
    spark.dataSource.register(ArrayVectors)
    r = spark.read.format(FORMAT).option("splitBytes", split_bytes)
    return (r.option("ids", ids) if ids else r).load(path)


def write_vectors(rows: DataFrame, path: str, id_col: str = "id", vec: str = "vector", dtype: str = "float32", feature_names: list[str] | None = None) -> None:
    """K5/K6: (id, vector) rows as a bundle: array files, ids and ``meta.json`` with sizes and feature names.  A bundle
    that is written again shows the new files once all of them stand; a job that fails shows none."""
    ship_package(rows.sparkSession)
    rows.sparkSession.dataSource.register(ArrayVectors)
    out = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("vector"))
    w = out.write.format(FORMAT).mode("append").option("dtype", dtype)
    if feature_names is not None:
        w = w.option("featureNames", json.dumps(feature_names))
    w.save(path)
