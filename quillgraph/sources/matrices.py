"""Matrix and vector files: Matrix Market, plain vectors, big-endian binary vectors and matrices, adjacency lists, catalogs.

Text files are written by range partitions as a folder whose part files, in order of their names, are the file; readers
take such a folder or a single file. Lines are ordered by file name, place of the block in the file, and place in the
block, so a large file is read by many tasks. A binary file is one value of at most 2 GB to Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import linalg

_PLACE = ("file", "block", "at")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, block, at): trimmed lines that are not empty, with their place."""
    meta = "_metadata.file_name", "_metadata.file_block_start"
    read = spark.read.text(path).select("value", F.col(meta[0]).alias("file"), F.col(meta[1]).alias("block"), F.monotonically_increasing_id().alias("at"))
    return read.select(F.trim("value").alias("line"), *_PLACE).where("line <> ''")


def _write_lines(rows: DataFrame, keys: list[str], path: str) -> None:
    """``rows`` (keys, line) as text in order of ``keys``, by range partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) from 0 of a coordinate file. Symmetric files are mirrored; pattern files have values of 1."""
    lines = _lines(spark, path)
    kinds = lines.where(F.lower("line").startswith("%%matrixmarket")).select(F.lower("line")).first()[0].split()
    plain = lines.where(~F.col("line").startswith("%"))
    size = plain.agg(F.min(F.struct(*_PLACE)).alias("p")).first()["p"]
    is_size = (F.col("file") == size["file"]) & (F.col("block") == size["block"]) & (F.col("at") == size["at"])
    parts = plain.where(~is_size).select(F.split("line", r"\s+").alias("p"))
    value = F.lit(1.0) if "pattern" in kinds else F.col("p")[2].cast("double")
    rows = parts.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), value.alias("v"))
    if "symmetric" not in kinds:
        return rows
    mirror = F.when(F.col("i") != F.col("j"), F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))).otherwise(F.array(F.struct("i", "j", "v")))
    return rows.select(F.explode(mirror).alias("e")).select("e.*")


def write_matrix_market(a: DataFrame, path: str, n: int) -> None:
    """A general coordinate file as a folder: the header comes before all entries, which are sorted by (j, i)."""
    nnz = a.count()
    head = a.sparkSession.createDataFrame([(-1, -1, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{n} {n} {nnz}")], "j long, i long, line string")
    body = a.select("j", "i", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("line"))
    _write_lines(head.unionByName(body), ["j", "i"], path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, v) of a text with the length and then the values, a line or any white space apart. Another number of values
    than the length raises."""
    words = _lines(spark, path).select(*_PLACE, F.posexplode(F.split("line", r"\s+")).alias("word", "x"))
    numbered = linalg.numbered(words, *_PLACE, "word")
    values = numbered.where("new > 0").select((F.col("new") - 1).alias("i"), F.col("x").cast("double").alias("v"))
    first = numbered.where("new = 0").select("x").first()
    if first is None or int(float(first["x"])) != values.count():
        raise ValueError(f"{path} does not hold as many values as it says")
    return values


def write_vector(x: DataFrame, path: str, length: bool = True) -> None:
    """A value a line in order of i, after the length (unless ``length`` is False)."""
    rows = x.select("i", F.col("v").cast("string").alias("line"))
    if length:
        rows = rows.unionByName(x.agg(F.lit(-(2**62)).alias("i"), F.count("*").cast("string").alias("line")))
    _write_lines(rows, ["i"], path)


VECTOR_CLASS = 1211214
MATRIX_CLASS = 1211216


def _vector_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for raw in frame["content"]:
            kind, n = struct.unpack_from(">ii", raw)
            if kind != VECTOR_CLASS:
                raise ValueError("not a vector file")
            values = np.frombuffer(raw, dtype=">f8", offset=8, count=n).astype(np.float64)
            yield pd.DataFrame({"i": np.arange(n), "v": values})


def read_binary_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, v) of a big-endian file: class number, length, doubles."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_vector_values, "i long, v double")


def vector_bytes(values: list[float]) -> bytes:
    return struct.pack(f">ii{len(values)}d", VECTOR_CLASS, len(values), *values)


def _matrix_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for raw in frame["content"]:
            kind, rows, _, nnz = struct.unpack_from(">iiii", raw)
            if kind != MATRIX_CLASS:
                raise ValueError("not a matrix file")
            lengths = np.frombuffer(raw, dtype=">i4", offset=16, count=rows)
            columns = np.frombuffer(raw, dtype=">i4", offset=16 + 4 * rows, count=nnz)
            values = np.frombuffer(raw, dtype=">f8", offset=16 + 4 * rows + 4 * nnz, count=nnz)
            yield pd.DataFrame({"i": np.repeat(np.arange(rows), lengths), "j": columns.astype(np.int64), "v": values.astype(np.float64)})


def read_binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a big-endian compressed-row file: class number, rows, columns, entries, row lengths, column numbers,
    doubles."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_matrix_entries, "i long, j long, v double")


#: Bytes that one binary file may have: it is put together in one task.
LARGEST_BINARY = 1 << 30


def binary_vector(x: DataFrame) -> DataFrame:
    """One row, ``content``: the file :func:`read_binary_vector` reads, of a vector over 0, 1, ... Too many values raise."""
    n = x.count()
    if 8 + 8 * n > LARGEST_BINARY:
        raise ValueError(f"{n} values are too many for one binary file; write Parquet")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.zeros(n, dtype=">f8")
        for frame in frames:
            values[frame["i"].to_numpy()] = frame["v"].to_numpy()
        yield pd.DataFrame({"content": [struct.pack(">ii", VECTOR_CLASS, n) + values.tobytes()]})

    return x.select("i", "v").repartition(1).mapInPandas(packed, "content binary")


def binary_matrix(a: DataFrame, n: int) -> DataFrame:
    """One row, ``content``: the file :func:`read_binary_matrix` reads, of an n by n matrix. Too many entries raise."""
    nnz = a.count()
    if 16 + 4 * n + 12 * nnz > LARGEST_BINARY:
        raise ValueError(f"{nnz} entries are too many for one binary file; write Parquet")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, columns, values = np.zeros(n, dtype=">i4"), [], []
        for frame in frames:
            lengths += np.bincount(frame["i"].to_numpy(), minlength=n).astype(">i4")
            columns.append(frame["j"].to_numpy().astype(">i4").tobytes())
            values.append(frame["v"].to_numpy().astype(">f8").tobytes())
        yield pd.DataFrame({"content": [struct.pack(">iiii", MATRIX_CLASS, n, n, nnz) + lengths.tobytes() + b"".join(columns) + b"".join(values)]})

    return a.select("i", "j", "v").repartition(1).sortWithinPartitions("i", "j").mapInPandas(packed, "content binary")


def write_binary(files: DataFrame, path: str) -> None:
    """Write the ``content`` of a one-row table to the file ``path``, from the driver; its size has been checked."""
    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(files.first()["content"]))
    out.close()


def adjacency_lines(a: DataFrame) -> DataFrame:
    """(i, line): the neighbours of each vertex, numbered from 1, without the diagonal."""
    near = F.sort_array(F.collect_list(F.when(F.col("i") != F.col("j"), F.col("j") + 1)))
    return a.groupBy("i").agg(F.array_join(near, " ").alias("line"))


def write_adjacency(a: DataFrame, path: str) -> None:
    """Adjacency file as a folder: a line with the numbers of vertices and edges, then the neighbours of vertices 0, 1,
    ..., which must all have a row in ``a`` (their diagonal, if nothing else). ``a`` must be symmetric."""
    n, entries = a.agg(F.countDistinct("i"), F.count(F.when(F.col("i") != F.col("j"), 1))).first()
    head = a.sparkSession.createDataFrame([(-1, f"{n} {entries // 2}")], "i long, line string")
    _write_lines(head.unionByName(adjacency_lines(a)), ["i"], path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Collection metadata: a CSV file with two leading lines and no header."""
    schema = "`group` string, name string, rows long, cols long, nnz long, real int, `binary` int, geom int, posdef int, psym double, nsym double, kind string"
    numbered = linalg.numbered(_lines(spark, path), *_PLACE).where("new >= 2")
    parsed = numbered.select((F.col("new") - 1).alias("id"), F.from_csv("line", schema).alias("c")).select("id", "c.*")
    return parsed.withColumns({k: F.col(k) == 1 for k in ("real", "binary", "geom", "posdef")})


def export(a: DataFrame, path: str, n: int) -> None:
    """One matrix in all formats below ``path``: Parquet, Matrix Market, and a binary file."""
    a.write.mode("overwrite").parquet(f"{path}/parquet")
    write_matrix_market(a, f"{path}/mtx", n)
    write_binary(binary_matrix(a, n), f"{path}/matrix.bin")
