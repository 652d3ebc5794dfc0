"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; a local one only where that is unset and driver and executors are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quillgraph-"))
        base = _own[0]
    return f"{base.rstrip('/')}/quillgraph-{uuid.uuid4().hex}"


_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables stored() has written so far: a mark for cleared()."""
    return len(_written)


def cleared(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes the tables that stored() wrote from one mark to another; nothing may still read them."""
    for path in _written[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:until]


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number strictly between 0 and 1, the same in every run for the same values (52 bits of md5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df doesn't have (columns of callers may clash with ours)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


REST = "_columns_of_the_caller"


def packed(df: DataFrame, *used: str) -> DataFrame:
    """df's columns of these names (those it has), and all others in one column, where no name clashes with ours."""
    rest = [c for c in df.columns if c not in used]
    return df.select(*[c for c in df.columns if c in used], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias(REST)] if rest else []))


def unpacked(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The given columns in order, from a table that packed(table, *used) became."""
    return df.select(*[F.col(c) if c in used else F.col(REST).getField(c).alias(c) for c in columns])


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def released(run):
    """run, and then what it freed goes back to the system: workers outlive their task, and allocators keep free memory."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of 1,000 rows, where the session has no number of its own: texts may be long, and workers are small."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":  # Spark's default
        conf.set(_ROWS, "1000")
    return df.mapInArrow(released(run), schema)


#: Bits of the map that tells which keys a table can't hold.
MAP_BITS = 1 << 21


def maybe_in(keys: DataFrame, column: str, key: Column | str) -> Column:
    """False only where no row of keys has `key` in `column`: a map of MAP_BITS hashed bits, whatever the size of keys.

    It lets a join shuffle few rows where keys are few; where they are many it fills up, and the join does all.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    p = keys.select(place(F.col(column)).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    found = {r.w: r.bits for r in p.collect()}
    words = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(MAP_BITS // 64))), ",").cast("array<bigint>")
    at = place(F.col(key) if isinstance(key, str) else key)
    return F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
