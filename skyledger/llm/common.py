"""Helpers that all operators of this package share: words, stable hashes, batches, table cuts."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
MIN_LONG = -(1 << 63)
M64 = (1 << 64) - 1
#: Entries of a memo in a Python worker; it is emptied beyond, which costs time and no result.
MEMO = 150_000


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a whole text as UTF-8; ``lower`` maps A-Z only. Null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


#: Memos of this process. A Python worker lives on from stage to stage; those of one operator go when
#: a task of another begins.
MEMOS: list[dict] = []
_OWNER = [""]


def claim(owner: str) -> None:
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for memo in MEMOS:
            memo.clear()


class WordHashes(dict):
    """Memo from a word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = WordHashes()
MEMOS.append(WORD_HASHES)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n hashes, in order; none if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
        out ^= out >> np.uint64(29)
    return mix64(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, no word none."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"short " + b" ".join(tokens))], np.uint64)
    return np.unique(windows(word_hashes(tokens), n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def crc_mod(doc_id: int | None, mod: int) -> int:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def crc_mod_col(doc_id: Column, mod: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over dicts of Python lists; ``fn`` yields dicts of lists or arrays. Rows are
    taken in slices of bounded bytes, so long texts do not add up."""
    from pyspark.sql.types import StructType

    target = pa.schema([(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def slices(batches):
        for batch in batches:
            step = max(1, min(batch.num_rows, int(SLICE_BYTES * max(1, batch.num_rows) / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step).to_pydict()

    owner = fn.__module__

    def run(batches):
        claim(owner)
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


#: Bytes of a slice of rows that is turned into Python objects at once.
SLICE_BYTES = 4 << 20


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to a Parquet table in the folder that spark.checkpoint.dir
    names, which all executors share, and are read from there. A folder of our own only where the
    session has none and all runs in one process (tests); on a cluster that is an error, since
    executors would write to folders that nobody else sees. Tables that a result no longer needs are
    let go by ``release``, the others when the session ends; the garbage collection lets Spark's
    cleaner drop the shuffle files behind the table at once."""
    spark = df.sparkSession
    jvm = spark._jvm
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/skyledger"
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes the tables behind results of ``cut`` that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns'."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(doc_id: Column) -> Column:
    """A key that can be joined on: null becomes the least long."""
    return F.coalesce(doc_id.cast("long"), F.lit(MIN_LONG))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
