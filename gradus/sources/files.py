"""File sources: strict CSV, JSON manifests and sidecars, checkpoints, bytes and images, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import safe_relative
from .csv_records import records

_BAD = "_corrupt"
#: Fields of a checkpoint record, without its own hash.
RECORD = ("qa_id", "status", "raw_output", "prediction", "error", "attempts", "signature", "prompt_sha256", "selected_frames")
CHECKPOINT = "qa_id string, status string, raw_output string, prediction string, error string, attempts int, signature string, prompt_sha256 string, selected_frames array<string>, record_sha256 string"
MANIFEST = "schema_version int, baseline_id string, files array<struct<path: string, bytes: bigint, sha256: string>>"
SUMMARY = (
    "status string, execution_mode string, signature string, target_ids array<string>, counts struct<valid: int, invalid: int, failed: int, pending: int, prompt_leakage: int>, resumed_valid int, "
    "elapsed_seconds double, latency struct<batch: struct<throughput_rps: double, batches: int, requests: int>>, backend struct<backend: string, load_seconds: double, tensor_parallel_size: int, versions: map<string, string>>"
)
CONTRACT = "contract struct<engine: string, dataset: string, engine_options: map<string, string>>"


class SourceError(ValueError):
    """A file that breaks its format."""


def cells(c: str, schema: str | T.StructType) -> Column:
    """The cells of a record as a struct; its last field tells a record of another width."""
    return F.from_csv(F.col(c), schema if isinstance(schema, str) else schema.simpleString()[7:-1], {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"})


def header(found: DataFrame, path: str) -> list[str]:
    """Column names of CSV records, without byte order mark; the same in all files, unique and not empty, or an error."""
    heads = found.where("row = 0").select("text").distinct().limit(2).collect()
    if len(heads) != 1:
        raise SourceError(f"{path}: {'files differ in their header' if heads else 'no header'}")
    text = heads[0][0].lstrip("\ufeff")
    spark = found.sparkSession
    got = spark.createDataFrame([(text,)], "v string").select(cells("v", ", ".join(f"c{i} string" for i in range(text.count(",") + 1)))).first()[0]
    names = [n or "" for n in got]
    while names and names[-1] == "" and len(names) > 1 and not text.endswith(","):
        names.pop()
    if not names or "" in names or len(set(names)) != len(names):
        raise SourceError(f"{path}: header must be unique and not empty: {names}")
    return names


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, strict: bool = True, mode: str = "superset") -> DataFrame:
    """All columns as strings, empty cells as empty strings, with ``pos`` (0-based row number, over the files in the order of their names).

    Strict files have at least one row and no ragged rows, and close their quotes. ``columns`` are compared by
    ``mode``: ``ordered``, ``set`` or ``superset``. Files are read in as many tasks as Spark splits them into.
    """
    found = records(spark, path)
    names = header(found, path)
    if columns is not None and not {"ordered": tuple(names) == tuple(columns), "set": set(names) == set(columns), "superset": set(columns) <= set(names)}[mode]:
        raise SourceError(f"{path}: columns {names} are not {mode} {list(columns)}")
    inner = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{_BAD} string"])
    rows = found.where("pos >= 0").select("pos", "text", cells("text", inner).alias("_c"))
    if strict:
        open_ = F.pmod(F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))), F.lit(2)) == 1
        seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col(f"_c.{_BAD}").isNotNull() | open_).alias("bad")).first()
        if seen["n"] == 0 or seen["bad"]:
            raise SourceError(f"{path}: {seen['n']} rows, {seen['bad']} ragged")
    return rows.select("pos", *(F.coalesce(F.col(f"_c.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)))


def try_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> tuple[DataFrame, str | None]:
    """A lenient read: rows (none, where the file is missing or unreadable) and what is wrong with it, for a check row."""
    none = spark.createDataFrame([], "pos long, " + ", ".join(f"`{c}` string" for c in columns))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return none, f"{path}: missing"
    try:
        return read_csv(spark, path, strict=False), None
    except SourceError as e:
        return none, str(e)


def read_qa(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Questions in the exact column layout, every rule of a question row checked in one pass.

    Ids have no outer white space; categories are in the taxonomy letter by letter.
    """
    from ..functions.answers import CATEGORIES, option_letters
    from ..functions.text import clean
    from ..operators.validation import QA_COLUMNS

    rows = read_csv(spark, path, QA_COLUMNS, mode="ordered")
    found = rows.agg(
        F.count("*").alias("rows"), F.count_distinct(clean("qa_id")).alias("ids"), F.count_if(clean("qa_id") == "").alias("blank ids"),
        F.count_if(clean("qa_id") != F.col("qa_id")).alias("padded ids"), F.count_if(~F.col("category").isin(*CATEGORIES)).alias("unknown categories"), F.count_if(clean("question") == "").alias("blank questions"), F.count_if(option_letters() == "").alias("rows without options"),
    ).first().asDict()
    if found["rows"] != found["ids"] or (expected is not None and found["rows"] != expected) or any(found[k] for k in list(found)[2:]):
        raise SourceError(f"{path}: {found}")
    return rows


def read_manifest(spark: SparkSession, path: str, baseline: str | None = None, prefix: str = "data/") -> DataFrame:
    """path, bytes, sha256 of a manifest's files, below ``prefix``, unique and safe."""
    doc = spark.read.json(path, schema=MANIFEST, multiLine=True)
    if doc.where("schema_version = 1").isEmpty():
        raise SourceError(f"{path}: another version of the schema")
    if baseline is not None and doc.where(F.col("baseline_id") == baseline).isEmpty():
        raise SourceError(f"{path}: another baseline")
    rows = doc.select(F.inline("files"))
    bad = rows.where(~safe_relative("path")).limit(1).count() + rows.groupBy("path").count().where("count > 1").limit(1).count()
    if bad:
        raise SourceError(f"{path}: unsafe or duplicate paths")
    return rows.withColumn("path", F.regexp_replace("path", f"^{prefix}", ""))


def read_sidecars(spark: SparkSession, root: str, schema: str, name: str = "metadata.json") -> DataFrame:
    """Every sidecar below a folder with the path of its own folder (relative to the root)."""
    rows = spark.read.json(root, schema=schema, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name)
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), f"{root.split('://')[-1].rstrip('/')}/(.*)/[^/]*$", 1))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines checkpoint with the hash that each should have, malformed lines as an error."""
    from ..functions.hashing import fingerprint

    rows = spark.read.json(path, schema=f"{CHECKPOINT}, {_BAD} string", columnNameOfCorruptRecord=_BAD)
    if rows.agg(F.count("qa_id"), F.count(_BAD)).first()[1]:
        raise SourceError(f"{path}: malformed lines")
    return rows.drop(_BAD).withColumn("expected_sha256", fingerprint(*RECORD))


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative), bytes and sha256 of every file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select(F.regexp_extract("path", f"{root.split('://')[-1].rstrip('/')}/(.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Segments before a JPEG's frame header that are walked over at most; its frame markers (fixed values).
SEGMENTS = 4096
_FRAMES = "c0 c1 c2 c3 c5 c6 c7 c9 ca cb cd ce cf"


def image_header(content: str = "content") -> Column:
    """kind (jpeg, png or null), width, height, channels of an image's bytes, from its header; null where there is none.

    A JPEG's segments are walked to the frame header; a JPEG that does not end with its end marker, or a PNG without
    its last chunk, is cut off and has no size. A PNG's palette counts as three channels.
    """
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    size = F.length(content)
    # at: where a marker is, -1 at the end of the walk; frame: where the frame header is
    frames = F.array(*(F.lit(x.upper()) for x in _FRAMES.split()))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        marker = F.hex(F.substring(content, at + 1, F.lit(1)))
        goes = (at > 0) & (at + 3 <= size) & (F.hex(F.substring(content, at, F.lit(1))) == "FF")
        alone = (marker == "01") | marker.between("D0", "D7")
        last = marker.isin("D9", "DA", "00")
        after = F.when(~goes | last | F.array_contains(frames, marker), -1).when(marker == "FF", at + 1).when(alone, at + 2).otherwise(at + 2 + number(at + 2, F.lit(2)))
        return F.struct(after.cast("int").alias("at"), F.when(goes & F.array_contains(frames, marker), at).otherwise(state["frame"]).cast("int").alias("frame"))

    jpeg, png = F.hex(F.substring(content, 1, 3)) == "FFD8FF", F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    begin = F.struct(F.lit(3).alias("at"), F.lit(-1).alias("frame"))
    # long walks are rare: a first short one tells nearly all images
    short = F.aggregate(F.sequence(F.lit(1), F.lit(64)), begin, step)
    frame = F.aggregate(F.when(short["at"] > 0, F.sequence(F.lit(1), F.lit(SEGMENTS))).otherwise(F.array().cast("array<int>")), short, step)["frame"]
    whole = F.hex(F.substring(content, size - 1, F.lit(2))) == "FFD9"
    ended = F.hex(F.substring(content, size - 7, F.lit(4))) == "49454E44"
    colour = number(F.lit(26), F.lit(1))
    of_png = F.when(ended, F.struct(number(F.lit(17), F.lit(4)).alias("width"), number(F.lit(21), F.lit(4)).alias("height"), F.when(colour == 0, 1).when(colour == 4, 2).when(colour == 6, 4).otherwise(3).alias("channels")))
    of_jpeg = F.when(whole & (frame > 0), F.struct(number(frame + 7, F.lit(2)).alias("width"), number(frame + 5, F.lit(2)).alias("height"), number(frame + 9, F.lit(1)).alias("channels")))
    found = F.when(jpeg, of_jpeg).when(png, of_png)
    return F.struct(F.when(jpeg, "jpeg").when(png, "png").alias("kind"), found["width"].alias("width"), found["height"].alias("height"), found["channels"].alias("channels"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels (3: RGB), is_jpeg, kind of every file below a folder, in one scan and without decoding.

    What is no image, or cut off, has width -1 (the rules are those of the suites); Spark does not list empty files, which so are missing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), image_header().alias("h"))
    known = lambda c: F.coalesce(F.col(f"h.{c}"), F.lit(-1)).alias(c)
    return rows.select("path", known("width"), known("height"), known("channels"), F.coalesce(F.col("h.kind") == "jpeg", F.lit(False)).alias("is_jpeg"), F.col("h.kind").alias("kind"))


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run summaries at any depth below a folder (the folder itself left out) with their relative id and contract, in the order of ids."""
    top = root.split("://")[-1].rstrip("/")
    run = F.regexp_extract(F.col("_metadata.file_path"), f"{top}/(.+)/[^/]*$", 1)
    read = lambda name, schema: spark.read.json(root, schema=schema, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name, mode="PERMISSIVE").withColumn("run_id", run)
    summaries = read("run_summary.json", SUMMARY).where("run_id <> ''")
    contracts = read("resume_state.json", CONTRACT)
    return summaries.join(contracts, "run_id", "left").select(
        "run_id", "status", "signature", F.coalesce("contract.engine", F.lit("transformers")).alias("engine"), F.coalesce("contract.dataset", F.lit("?")).alias("dataset"),
        F.coalesce("contract.engine_options", F.create_map().cast("map<string,string>")).alias("engine_options"), F.coalesce(F.size("target_ids"), F.lit(0)).alias("targets"), F.coalesce("resumed_valid", F.lit(0)).alias("resumed"),
        "counts.*", F.col("elapsed_seconds").alias("elapsed_s"), F.col("backend.backend").alias("backend"), F.col("backend.load_seconds").alias("load_s"), F.col("latency.batch.throughput_rps").alias("throughput_rps"),
    ).orderBy("run_id")


def preferred_predictions(exported: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """run_id, qa_id, prediction: a run's exported predictions, or its valid records where it exported none."""
    a = exported.select("run_id", "qa_id", "prediction", F.lit(0).alias("rank"))
    b = checkpoint.where("status = 'valid' and prediction is not null and prediction <> ''").select("run_id", "qa_id", "prediction", F.lit(1).alias("rank"))
    rows = a.union(b)
    return rows.withColumn("least", F.min("rank").over(W.partitionBy("run_id"))).where("rank = least").drop("rank", "least")
