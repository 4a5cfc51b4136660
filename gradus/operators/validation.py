"""Validation suites: every check is a row (code, status, observed, expected, detail); none stops the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import CATEGORIES, category_of, option_layout_ok, option_letters, options_unique, with_assessment
from ..functions.arrays import ascending, close, midpoints
from ..functions.paths import safe_relative
from ..functions.text import clean

QA_COLUMNS = ("qa_id", "source", "path", "category", "question", "A", "B", "C", "D")
SUBMISSION_COLUMNS = ("qa_id", "prediction")

# Budgets of an archive.
MAX_ARCHIVE_BYTES = MAX_EXPANDED_BYTES = 512 << 20
MAX_ENTRIES, MAX_MEMBER_BYTES, MAX_RATIO = 20_000, 16 << 20, 50.0


def check(code: str, passed: Column, observed: Column, expected: Column, detail: Column) -> Column:
    """One check as a struct; to be exploded out of a one-row aggregate."""
    ok = F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
    return F.struct(F.lit(code).alias("code"), ok.alias("status"), observed.cast("string").alias("observed"), expected.cast("string").alias("expected"), detail.alias("detail"))


def checks(row: DataFrame, *which: Column) -> DataFrame:
    return row.select(F.explode(F.array(*which)).alias("c")).select("c.*")


def zero(code: str, count: str, what: str, examples: str | None = None) -> Column:
    """A check that a counter of the row is 0."""
    detail = F.lit(what) if examples is None else F.concat(F.lit(f"{what}: "), F.array_join(F.col(examples), ", "))
    return check(code, F.col(count) == 0, F.col(count), F.lit(0), detail)


def first_values(rows: DataFrame, value: Column, order: Column | str, name: str, n: int = 10) -> DataFrame:
    """One row: the values of the first ``n`` rows in order, a bounded list whatever the number of rows."""
    top = rows.select((F.col(order) if isinstance(order, str) else order).alias("o"), value.alias("v")).orderBy("o", "v").limit(n)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name))


def schema_checks(spark: SparkSession, tables: dict[str, tuple[list[str], tuple[str, ...], str]]) -> DataFrame:
    """Column checks: name to (observed, wanted, mode); modes are ``ordered``, ``set`` and ``superset``."""
    rows = []
    for code, (seen, want, mode) in tables.items():
        ok = {"ordered": tuple(seen) == tuple(want), "set": set(seen) == set(want) and len(seen) == len(want), "superset": set(want) <= set(seen)}[mode]
        gone = sorted(set(want) - set(seen))
        rows.append((code, "PASS" if ok else "FAIL", ",".join(seen), f"{mode}: {','.join(want)}", f"missing: {','.join(gone)}" if gone else "complete"))
    return spark.createDataFrame(rows, "code string, status string, observed string, expected string, detail string")


def judged(submission: DataFrame, tests: DataFrame) -> DataFrame:
    """Each submission row with its first test row's category and the error of its prediction, if any."""
    first = tests.withColumn("_id", clean("qa_id")).withColumn("_rn", F.row_number().over(W.partitionBy("_id").orderBy("pos"))).where("_rn = 1 and _id <> ''")
    first = first.select("_id", category_of("category").alias("category"), option_letters().alias("_options"), F.lit(True).alias("known"))
    rows = submission.withColumn("_id", clean("qa_id")).join(first, "_id", "left")
    raw = F.coalesce("prediction", F.lit(""))
    rows = with_assessment(rows, raw, "category", "_options", "_own")
    error = F.when(F.col("known").isNull(), F.lit("unknown id")).when(F.col("_own.error").isNotNull(), F.col("_own.error")).when(raw != F.col("_own.canonical"), F.concat(F.lit("non-canonical; expected "), F.col("_own.canonical")))
    return rows.select("pos", F.col("_id").alias("qa_id"), "category", raw.alias("prediction"), error.alias("error"))


def _first(rows: DataFrame, value: Column, order: str, n: int = 10) -> str:
    """The values of the first ``n`` rows in order, for a message."""
    return ", ".join(r["v"] for r in rows.select(F.col(order).alias("o"), value.alias("v")).orderBy("o", "v").limit(n).collect())


def submission_report(tests: DataFrame, template: DataFrame, submission: DataFrame) -> DataFrame:
    """All checks of a submission against its template and test questions (each with a 0-based ``pos``).

    Evaluated when called: rows of questions, ids and positions of the three tables, and predictions are aggregated once
    each; examples are looked up for the checks that failed alone.
    """
    spark = tests.sparkSession
    columns = lambda d: [c for c in d.columns if c != "pos"]
    found = [tuple(r) for r in schema_checks(spark, {"test_schema": (columns(tests), QA_COLUMNS, "superset"), "template_columns": (columns(template), SUBMISSION_COLUMNS, "ordered"), "submission_columns": (columns(submission), SUBMISSION_COLUMNS, "ordered")}).collect()]

    def add(code: str, ok: bool, observed: object, expected: object, detail: str) -> None:
        found.append((code, "PASS" if ok else "FAIL", str(observed), str(expected), detail))

    def none(code: str, n: int, what: str, rows: DataFrame | None = None, value: Column | None = None, order: str = "", most: int = 10) -> None:
        add(code, n == 0, n, 0, what if rows is None else f"{what}: {_first(rows, value, order, most) if n else ''}")

    # questions
    rows = tests.select("pos", clean("qa_id").alias("id"), category_of("category").alias("kind"), option_layout_ok().alias("laid"), options_unique().alias("apart"))
    seen = rows.agg(F.array_sort(F.collect_set(F.when(~F.col("kind").isin(*CATEGORIES), F.substring("kind", 1, 40)))).alias("kinds"), F.count_if(~F.col("laid")).alias("layout"), F.count_if(~F.col("apart")).alias("twice")).first()
    add("test_categories", not seen["kinds"], ",".join(seen["kinds"]), "known taxonomy", "test categories")
    none("test_option_layout", seen["layout"], "option layout", rows.where("not laid"), F.col("id"), "pos")
    none("test_unique_options", seen["twice"], "equal options", rows.where("not apart"), F.col("id"), "pos")

    # ids and positions of all three tables
    names = ("test", "template", "submission")
    every = reduce(DataFrame.unionByName, (d.select("pos", clean("qa_id").alias("id"), F.lit(n).alias("t")) for n, d in zip(names, (tests, template, submission), strict=True)))
    per = every.groupBy("id").agg(*(F.count_if(F.col("t") == n).alias(n) for n in names))
    known = F.col("id") != ""
    ids = per.agg(
        *(F.sum(F.col(n)).alias(f"{n}_rows") for n in names), *(F.sum(F.when(~known, F.col(n)).otherwise(0)).alias(f"{n}_blank") for n in names), *(F.count_if(known & (F.col(n) > 1)).alias(f"{n}_twice") for n in names),
        F.count_if((F.col("template") > 0) & (F.col("submission") == 0)).alias("missing"), F.count_if((F.col("template") == 0) & (F.col("submission") > 0)).alias("unexpected"),
    ).first()
    ids = {k: v or 0 for k, v in ids.asDict().items()}
    for n in names:
        none(f"{n}_nonempty_ids", ids[f"{n}_blank"], f"{n} blank qa_id")
        none(f"{n}_unique_ids", ids[f"{n}_twice"], f"{n} duplicate qa_id", per.where(known & (F.col(n) > 1)), F.col("id"), "id")
    places = every.groupBy("pos").agg(*(F.max(F.when(F.col("t") == n, F.col("id"))).alias(n) for n in names))
    pairs = {"template_matches_test_order": ("template", "test", "template ids must follow the test questions"), "submission_id_order": ("submission", "template", "ids must follow the template")}
    differ = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    order = places.agg(*(c for code, (x, y, _) in pairs.items() for c in (F.count_if(differ(x, y)).alias(code), F.min(F.when(F.col(x) != F.col(y), F.col("pos") + 1)).alias(f"{code}_first")))).first()
    for code, (_, _, what) in pairs.items():
        add(code, order[code] == 0, "exact" if order[code] == 0 else f"first mismatch at data row {order[f'{code}_first']}", "exact order", what)
    add("submission_row_count", ids["submission_rows"] == ids["template_rows"], ids["submission_rows"], ids["template_rows"], "one row per template row")
    add("submission_id_set", not (ids["missing"] or ids["unexpected"]), f"{ids['missing']},{ids['unexpected']}", "0,0", "missing, unexpected ids")

    # predictions
    wrong = judged(submission, tests).where("error is not null").select("pos", "qa_id", "error")
    none("prediction_format", wrong.count(), "predictions must be canonical", wrong, F.concat_ws(":", "qa_id", "error"), "pos", 5)
    return spark.createDataFrame(found, "code string, status string, observed string, expected string, detail string")


def submission_counts(submission: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows of a submission by the category of their question (of questions that are known), and how many of them are no canonical answer."""
    rows = judged(submission, tests).where("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("invalid"), (F.count("*") - F.count_if(F.col("error").isNotNull())).alias("canonical"))


def submission_totals(submission: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: rows of a submission, canonical ones, and invalid ones: all others, unknown ids among them."""
    ok = F.col("error").isNull()
    return judged(submission, tests).agg(F.count("*").alias("rows"), F.count_if(ok).alias("canonical"), F.count_if(~ok).alias("invalid"), F.count_if(F.col("error") == "unknown id").alias("unknown"))


def verdict(report: DataFrame) -> DataFrame:
    """One row: PASS only if every check passed, and the codes that did not."""
    failed = F.col("status") != "PASS"
    return report.agg(F.when(F.count_if(failed) == 0, "PASS").otherwise("FAIL").alias("status"), F.count("*").alias("checks"), F.array_sort(F.collect_list(F.when(failed, F.col("code")))).alias("failed"))


def required(report: DataFrame) -> None:
    """Raise with the first failed check (hard mode of any suite)."""
    row = report.where("status <> 'PASS'").orderBy("code").first()
    if row is not None:
        raise ValueError(f"{row['code']}: {row['detail']} (observed {row['observed']}, expected {row['expected']})")


def link_report(qa: DataFrame, frames: DataFrame) -> DataFrame:
    """Checks that every question is linked to one clip of its source by the packed id lists of a frame index."""
    links = frames.select("sample_id", F.col("source").alias("_source"), "qa_count", F.explode(F.split("qa_ids", ";")).alias("qa_id"))
    twice = links.groupBy("qa_id").count().where("count > 1").agg(F.count("*").alias("twice"))
    rows = qa.join(links, "qa_id", "left").agg(F.count_if(F.col("sample_id").isNull()).alias("lone"), F.count_if(F.col("source") != F.col("_source")).alias("other"))
    sizes = frames.agg(F.count_if(F.size(F.split("qa_ids", ";")) != F.col("qa_count").cast("int")).alias("sizes"))
    return checks(twice.crossJoin(rows).crossJoin(sizes), zero("qa_linked_once", "twice", "questions linked twice"), zero("qa_linked", "lone", "questions without clip"), zero("qa_source", "other", "source differs from its clip's"), zero("qa_count", "sizes", "qa_count differs from qa_ids"))


def timeline_report(frames: DataFrame, n: int) -> DataFrame:
    """Checks of unpacked timelines (normalized_positions, target/actual timestamps, frame paths)."""
    rules = {
        "frame_count": F.size("frame_paths") == n,
        "positions": close(F.col("normalized_positions"), midpoints(n)),
        "timestamps_sorted": ascending("actual_timestamps_seconds"),
        "timestamp_count": F.size("actual_timestamps_seconds") == F.size("target_timestamps_seconds"),
        "safe_paths": F.forall("frame_paths", safe_relative),
    }
    row = frames.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in rules.items()))
    return checks(row, *(zero(k, k, f"samples that fail {k}") for k in rules))


def sidecar_differences(rows: DataFrame, sidecar: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column of every value that differs between a row and its sidecar, or whose sidecar is missing."""
    other = sidecar.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.select(key, *columns).join(other, key, "left")
    wrong = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("<missing>")), *(F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)))
    return both.select(key, F.explode(wrong).alias("column"))


def file_report(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem of manifest entries (path, bytes, sha256) against files of the same columns, both ways."""
    m = manifest.select("path", F.col("bytes").alias("_b"), F.lower("sha256").alias("_h"))
    twice = m.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("problem"))
    both = m.dropDuplicates(["path"]).join(files.select("path", "bytes", "sha256"), "path", "full_outer")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").when(F.col("_b") != F.col("bytes"), "size").when(F.col("_h") != F.col("sha256"), "sha256")
    return both.select("path", problem.alias("problem")).where("problem is not null").union(twice)


def archive_report(entries: DataFrame, manifest: DataFrame, marker: str, archive_bytes: int) -> DataFrame:
    """Checks of an archive's entry table (name, file_size, compress_size, compress_type, flag_bits, external_attr, is_dir)."""
    kind = F.expr("(external_attr div 65536) & 61440")
    ratio = F.col("file_size") / F.nullif(F.col("compress_size"), F.lit(0))
    clash = entries.groupBy(F.lower("name").alias("n")).count().where("count > 1").agg(F.count("*").alias("clash"))
    row = entries.agg(
        F.count("*").alias("n"), F.count_if(~safe_relative("name")).alias("unsafe"), F.count_if(F.col("is_dir") | (F.expr("flag_bits & 1") == 1)).alias("dirs"), F.count_if(~kind.isin(0, 32768)).alias("special"),
        F.count_if(~F.col("compress_type").isin(0, 8)).alias("methods"), F.count_if((F.col("file_size") < 0) | (F.col("file_size") > MAX_MEMBER_BYTES)).alias("large"),
        F.count_if((F.col("file_size") > 0) & F.coalesce(ratio > MAX_RATIO, F.lit(True))).alias("ratio"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("expanded"), F.count_if(F.col("name") == marker).alias("marker"),
    )
    listed = manifest.select(F.col("path").alias("name"), F.col("bytes").alias("_b"), "sha256").join(entries.where(F.col("name") != marker).select("name", "file_size"), "name", "full_outer")
    own = listed.agg(F.count_if(~F.col("_b").eqNullSafe(F.col("file_size"))).alias("differ"), F.count_if(F.col("_b").isNotNull() & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("digests"))
    return checks(
        row.crossJoin(clash).crossJoin(own),
        check("archive_bytes", F.lit(archive_bytes <= MAX_ARCHIVE_BYTES), F.lit(archive_bytes), F.lit(MAX_ARCHIVE_BYTES), F.lit("compressed size")),
        check("entries", F.col("n").between(1, MAX_ENTRIES), F.col("n"), F.lit(MAX_ENTRIES), F.lit("number of entries")),
        check("expanded", F.col("expanded") <= MAX_EXPANDED_BYTES, F.col("expanded"), F.lit(MAX_EXPANDED_BYTES), F.lit("expanded size")),
        check("marker", F.col("marker") == 1, F.col("marker"), F.lit(1), F.lit("manifest entry")),
        zero("safe_names", "unsafe", "unsafe names"), zero("unique_names", "clash", "equal or case-colliding names"), zero("plain_entries", "dirs", "directories or encrypted entries"),
        zero("regular_files", "special", "links or special files"), zero("methods", "methods", "unsupported compression"), zero("member_bytes", "large", "members over budget"),
        zero("member_ratio", "ratio", "compression ratio over budget"), zero("manifest_entries", "differ", "entries that differ from the manifest"), zero("manifest_digests", "digests", "malformed digests"),
    )


def run_report(records: DataFrame, targets: DataFrame, claimed: str, id_col: str = "qa_id") -> DataFrame:
    """Checks of a finished run: one record per target, hashes that hold, no claim of PASS without all valid."""
    row = records.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids"), F.count_if(~F.col("record_sha256").eqNullSafe(F.col("expected_sha256"))).alias("tampered"), F.count_if(F.col("status") == "valid").alias("valid"))
    lone = records.join(targets.select(id_col), id_col, "left_anti").agg(F.count("*").alias("lone"))
    row = row.crossJoin(lone).crossJoin(targets.agg(F.count("*").alias("targets"))).withColumn("twice", F.col("n") - F.col("ids"))
    honest = F.lit(claimed) == F.when((F.col("valid") == F.col("targets")) & (F.col("targets") > 0), "PASS").otherwise("INCOMPLETE")
    return checks(row, zero("unique_records", "twice", "records of one target"), zero("known_records", "lone", "records without target"), zero("record_hashes", "tampered", "records whose hash differs"), check("claimed_status", honest, F.lit(claimed), F.lit("as counted"), F.lit("run status")))


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float, str]]) -> DataFrame:
    """Named metrics (code, value) against limits: code to (comparison, bound, severity ``critical``, ``minor`` or ``info``)."""
    rows = [(k, op, float(v), s) for k, (op, v, s) in limits.items()]
    bounds = metrics.sparkSession.createDataFrame(rows, "code string, op string, bound double, severity string")
    value, bound = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == "<", value < bound).when(F.col("op") == "<=", value <= bound).when(F.col("op") == ">", value > bound).when(F.col("op") == ">=", value >= bound).otherwise(value == bound)
    status = F.when(F.col("value").isNull(), "MISSING").when(F.col("severity") == "info", "INFO").when(ok, "PASS").when(F.col("severity") == "critical", "FAIL").otherwise("WARN")
    return bounds.join(metrics, "code", "left").select("code", status.alias("status"), "severity", value.cast("string").alias("observed"), F.concat_ws(" ", "op", bound.cast("string")).alias("expected"))
