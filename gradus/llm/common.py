"""Helpers shared by the training-data operators: tables, shared folder, constants."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage, as a character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows and bytes of one Arrow batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests) a temporary folder is set where the session has none; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jsc.get() if jsc.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='gradus-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gradus-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there.

    Unlike a cache or a local checkpoint it survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs run inside; what was set before comes back, after errors too."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the job that made them ends (a lost one is computed anew).
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Tables that an operator keeps while it runs: written ones in the shared folder, cached ones on executors' disks.

    All are gone when it ends, but for those that stay, and so are the shuffle files of its jobs.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables, self.held, self.conf = spark, {}, [], [], session_conf(spark, TIDY)

    def __enter__(self) -> Scratch:
        self.conf.__enter__()
        return self

    def stored(self, df: DataFrame, name: str, stays: bool = False, by: str | None = None, apart: str | None = None) -> DataFrame:
        """``df`` written and read back; with ``by`` in buckets of that column, which joins need not deal out again, with ``apart`` in a folder for each value of it."""
        path = shared_path(self.spark, name)
        if not stays:
            self.paths.setdefault(name, []).append(path)
        writer = df.write if apart is None else df.write.partitionBy(apart)
        if by is None:
            writer.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        self.tables.append(table)
        writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def drop_part(self, name: str, apart: str, value: int) -> None:
        """Delete one folder of the tables ``name`` that are stored ``apart``."""
        for path in self.paths.get(name, []):
            delete(self.spark, f"{path}/{apart}={value}")

    def kept(self, df: DataFrame) -> DataFrame:
        self.held.append(kept(df))
        return self.held[-1]

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.paths):
            for path in self.paths.pop(name, []):
                delete(self.spark, path)

    def free(self) -> None:
        """Unpersist what `kept` holds so far."""
        while self.held:
            self.held.pop().unpersist()

    def __exit__(self, *error) -> None:
        self.conf.__exit__(*error)
        self.free()
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        self.drop()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: on the disks of the executors, and anew from its lineage where one is lost."""
    return df.persist(StorageLevel.DISK_ONLY)


#: A key with more than one in this many of all rows is hot: there are fewer such keys than this.
HOT = 1024


def by_size(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and the number of its rows in ``size``.

    Hot keys, fewer than ``HOT`` by their size, are broadcast; what is dealt out has no key with more
    rows than that share of all.
    """
    hot, cold = side.where(F.col(size) * HOT > total), side.where(F.col(size) * HOT <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: log2 of the bits of a bitmap.
MAP_BITS = 24


def bitmap(marks: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """One row of fixed size: the bits that ``marks`` (mark: long) set, in pieces of 32,768 bits by their number.

    It lets rows go that cannot be wanted before they are dealt out; with more marks than bits more pass, never fewer.
    """
    at = F.pmod("mark", F.lit(1 << bits))
    per = marks.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("_map"))  # 2^(bits - 15) pieces of 4 KB at most


def may_be(mark: Column, bits: int = MAP_BITS) -> Column:
    """Whether the bitmap in ``_map`` has the bit of a mark."""
    at = F.pmod(mark, F.lit(1 << bits))
    place = F.bitmap_bit_position(at)
    byte = F.substring(F.col("_map")[F.bitmap_bucket_number(at)], (place / 8).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int"))
    return F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))


def few(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, for tables that are far smaller than what they come from."""
    return df.repartition(-(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, in rows and in bytes: texts differ much in length.

    Results are lazy, so the setting stays; smaller ones of the session are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def crc32_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod`` (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod))


#: The row key that `keyed` adds.
KEY = "_key"


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a key for each row, and whether every row has a key of its own.

    The key is the doc_id; for a row without one, and for all but one of several texts under one id, it
    is a number above all usual ids made from id and text. It depends on nothing but these two, so it is
    the same whenever it is computed, and only rows that repeat id and text share it.
    """
    ids = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if ids.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id")), True
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"), F.min(F.xxhash64("text")).alias("_least")).where("_n > 1").drop("_n")
    own = F.col("doc_id").isNotNull() & (F.col("_least").isNull() | (F.col("_least") == F.xxhash64("text")))
    made = F.expr("4611686018427387904 + pmod(xxhash64(doc_id, text), 4611686018427387904)")
    rows = docs.join(twice, F.col("doc_id") == F.col("_id"), "left")
    return rows.select(*docs.columns, F.when(own, F.col("doc_id")).otherwise(made).alias(KEY)), False


def staying(docs: DataFrame, decide) -> DataFrame:
    """The rows of ``docs`` that ``decide`` (doc_id, text to doc_id, kept) keeps by their keys; of repeated rows one."""
    rows, single = keyed(docs)
    stays = decide(rows.select(F.col(KEY).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(KEY))
    found = rows.join(stays.hint("shuffle_hash"), KEY, "left_semi")
    return (found if single else found.dropDuplicates([KEY])).select(*docs.columns)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
