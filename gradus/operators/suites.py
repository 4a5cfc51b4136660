"""Composed checks: cached inputs of an evaluation, and data prepared for training.

Both compare an index of cached clips (one row for each, its lists packed into cells) with the sidecar
of each clip, the questions, the images and the registered files. Every rule is a row of the report;
none stops the others, and nothing is silently left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import option_letters, with_assessment
from ..functions.arrays import ascending, close, midpoints, unpack
from ..functions.paths import clip_path, safe_relative
from ..functions.prompts import leakage, prompt
from ..functions.text import clean
from . import splits
from .validation import checks, file_report, link_report, zero

#: Fields that a clip's row and its sidecar both have.
SHARED = ("sample_id", "clip_key", "source", "split", "status", "modality", "config_hash", "protocol_version")
TIMELINES = ("normalized_positions", "target_timestamps_seconds", "actual_timestamps_seconds")
# The protocol of the cache, the version of the folds, the folds of each split.
FRAMES, IMAGE_SIZE, RESIZE = 8, 448, "letterbox"
#: Files of an adapter (fixed values).
ADAPTER_FILES = ("adapter_config.json", "adapter_model.safetensors")
FOLD_VERSION, N_FOLDS, PILOT_FOLD = "subject_grouped_v1", 5, 4


def with_sidecar(frames: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each clip's row with its lists unpacked and its sidecar's fields as ``m_`` columns (null where it has none)."""
    meta = sidecars.select(F.col("sample_id").alias("_id"), F.lit(True).alias("m_there"), *(F.col(c).alias(f"m_{c}") for c in sidecars.columns))
    lists = {c: unpack(c, "double") for c in TIMELINES} | {"source_frame_indices": unpack("source_frame_indices", "int"), "qa_ids": unpack("qa_ids"), "frame_paths": unpack("frame_paths")}
    return frames.withColumns(lists).join(meta, F.col("sample_id") == F.col("_id"), "left").drop("_id")


def clip_rules(fixed: dict[str, str], n: int = FRAMES, size: int = IMAGE_SIZE, resize: str = RESIZE) -> dict[str, Column]:
    """Code to rule of one clip with its sidecar; ``fixed`` are values that columns of the index must have."""
    in_folder = F.transform("m_frame_files", lambda f: F.when(F.col("m_folder") == "", f).otherwise(F.concat_ws("/", "m_folder", f)))
    rules = {f"cache_{c}": F.col(c) == v for c, v in fixed.items()}
    rules["sidecar"] = F.col("m_there")
    rules |= {f"sidecar_{c}": F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in SHARED if c != "sample_id"}
    rules["sidecar_questions"] = (F.col("m_qa_ids") == F.col("qa_ids")) & (F.size("qa_ids") == F.col("qa_count").cast("int")) & (F.col("m_qa_count") == F.size("qa_ids"))
    rules["frame_count"] = (F.col("m_num_frames") == n) & (F.col("m_requested_frames") == n) & (F.col("m_actual_frames") == n)
    rules["image_protocol"] = (F.col("m_image_size") == size) & (F.col("m_resize_mode") == resize)
    rules |= {f"timeline_{c}": (F.size(c) == n) & close(c, f"m_{c}") for c in TIMELINES}
    rules["sampling"] = close("m_normalized_positions", midpoints(n))
    rules["timestamps_sorted"] = ascending("m_actual_timestamps_seconds")
    rules["frame_indices"] = F.col("source_frame_indices") == F.col("m_source_frame_indices")
    rules["frame_list"] = (F.size("frame_paths") == n) & (F.size(F.array_distinct("frame_paths")) == n) & F.forall("frame_paths", safe_relative)
    rules["frame_files"] = F.col("frame_paths") == in_folder
    return rules


def _counted(rows: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    """A check for each rule that no row breaks it; a rule that cannot be told is broken."""
    row = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in rules.items()))
    return checks(row, *(zero(k, k, f"{what} that break {k}") for k in rules))


def _none(rows: DataFrame, code: str, what: str) -> DataFrame:
    return checks(rows.agg(F.count("*").alias("n")), zero(code, "n", what))


def _image_report(clips: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Checks of the clips' images (path, width, height, channels, is_jpeg): each there, whole, of the right kind, and of one clip."""
    used = clips.select("sample_id", F.explode("frame_paths").alias("path"))
    again = used.distinct().groupBy("path").count().where("count > 1")
    rows = used.select("path").distinct().join(images, "path", "left")
    right = F.col("is_jpeg") & (F.col("channels") == 3) & (F.col("width") == size) & (F.col("height") == size)
    return _none(again, "frames_of_one_clip", "images of several clips").union(_counted(rows, {"images": right}, "images"))


def _asset_report(paths: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Checks that the files (path, bytes, sha256) at ``paths`` are registered and as registered."""
    needed = paths.distinct()
    twice = manifest.groupBy("path").count().where("count > 1")
    own = file_report(manifest.join(needed, "path", "left_semi"), files.join(needed, "path", "left_semi")).where("problem <> 'duplicate'")
    lone = needed.join(manifest, "path", "left_anti")
    return _none(twice, "manifest_paths", "paths registered twice").union(_none(lone, "assets_registered", "files that are not registered")).union(_none(own, "assets", "files that differ from the manifest"))


def cached_input_report(
    qa: DataFrame, frames: DataFrame, sidecars: DataFrame, images: DataFrame, manifest: DataFrame, files: DataFrame, fixed: dict[str, str],
    template: DataFrame | None = None, n: int = FRAMES, size: int = IMAGE_SIZE, resize: str = RESIZE,
) -> DataFrame:
    """All checks of cached inputs: questions, the clips that they are linked to, sidecars, images, files, and the template's ids.

    Only clips of a question in ``qa`` are held against their sidecars, images and files.
    """
    ids = frames.groupBy(F.coalesce("sample_id", F.lit("")).alias("id")).count().where("count > 1 or id = ''")
    clips = with_sidecar(frames, sidecars)
    asked = clips.select("sample_id", F.explode("qa_ids").alias("qa_id")).join(qa.select("qa_id"), "qa_id", "left_semi").select("sample_id").distinct()
    clips = clips.join(asked, "sample_id", "left_semi")
    paths = clips.select(F.explode(F.concat("frame_paths", F.array("metadata_path"))).alias("path"))
    parts = [_none(ids, "sample_ids", "blank or repeated clip ids"), link_report(qa, frames), _counted(clips, clip_rules(fixed, n, size, resize), "clips"), _image_report(clips, images, size), _asset_report(paths, manifest, files)]
    if template is not None:
        a, b = template.select("qa_id"), qa.select("qa_id")
        parts.append(_none(a.join(b, "qa_id", "left_anti").union(b.join(a, "qa_id", "left_anti")), "template_ids", "ids that template and questions do not share"))
        parts.append(_none(a.groupBy("qa_id").count().where("count > 1"), "template_unique", "ids that the template has twice"))
    return reduce(DataFrame.unionByName, parts)


def fold_report(qa: DataFrame, folds: DataFrame, pilot: DataFrame) -> DataFrame:
    """Checks of the questions' folds: ids, versions, groups that leak, fields, clips, answers, prompts and the pilot."""
    twice = {name: d.groupBy("qa_id").count().where("count > 1") for name, d in (("qa", qa), ("fold", folds), ("pilot", pilot))}
    a, b = qa.select("qa_id"), folds.select("qa_id")
    apart = a.join(b, "qa_id", "left_anti").union(b.join(a, "qa_id", "left_anti"))
    own = folds.select("qa_id", *(F.col(c).alias(f"f_{c}") for c in ("source", "category", "fold_version", "fold", "subject_id", "clip_key")))
    rows = with_assessment(qa.withColumn("_options", option_letters()), "answer", "category", "_options", "own").join(own, "qa_id")
    fold = F.col("f_fold").cast("int")
    rules = {
        "plain_ids": (F.col("qa_id") != "") & (clean("qa_id") == F.col("qa_id")),
        "fold_version": F.col("f_fold_version") == FOLD_VERSION,
        "fold_number": fold.between(0, N_FOLDS - 1),
        "fold_groups": (clean("f_subject_id") != "") & F.startswith("f_clip_key", F.lit("train:")),
        "fold_fields": (F.col("f_source") == F.col("source")) & (F.col("f_category") == F.col("category")),
        "fold_clip": F.col("f_clip_key") == F.concat(F.lit("train:"), clip_path("path")),
        "answers": F.col("own.error").isNull(),
        "prompts": F.size(leakage(prompt(), ("path",))) == 0,
    }
    parts = [_none(d, f"unique_{name}_ids", f"{name} ids that occur twice") for name, d in twice.items()]
    parts += [_none(apart, "fold_ids", "ids without question or without fold"), _none(pilot.join(a, "qa_id", "left_anti"), "pilot_ids", "pilot ids without question"), _counted(rows, rules, "questions")]
    parts += [_none(splits.leaking_groups(folds, c), f"leaks_{c}", f"{c} in several folds") for c in ("subject_id", "clip_key")]
    parts.append(_none(splits.misplaced_pilot(pilot, folds, fold=PILOT_FOLD).join(b, "qa_id", "left_semi"), "pilot_fold", "pilot ids of another fold"))
    return reduce(DataFrame.unionByName, parts)


def prepared(qa: DataFrame, folds: DataFrame, pilot: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples for training: question, canonical answer, fold, split and the clip's frames (null where none is cached); the pilot left out."""
    rows = splits.without_pilot(qa.drop("fold", "subject_id", "clip_key"), pilot).join(folds.select("qa_id", F.col("fold").cast("int").alias("fold"), "subject_id", "clip_key"), "qa_id")
    rows = with_assessment(rows.withColumn("_options", option_letters()), "answer", "category", "_options", "_own")
    linked = frames.select(F.explode(unpack("qa_ids")).alias("qa_id"), unpack("frame_paths").alias("frames"))
    return rows.withColumn("answer", F.col("_own.canonical")).withColumn("split", splits.split_of("fold")).drop("_options", "_own").join(linked, "qa_id", "left")


def training_report(
    qa: DataFrame, folds: DataFrame, pilot: DataFrame, frames: DataFrame, sidecars: DataFrame, images: DataFrame, fixed: dict[str, str], n: int = FRAMES, size: int = IMAGE_SIZE, resize: str = RESIZE
) -> DataFrame:
    """All checks of training data: the folds, each cached clip, and that questions are joined to their own clip."""
    clips = with_sidecar(frames, sidecars)
    again = frames.groupBy("clip_key").count().where("count > 1")
    links = clips.select("clip_key", "source", F.explode("qa_ids").alias("qa_id"))
    twice = links.groupBy("qa_id").count().where("count > 1")
    whose = folds.select("qa_id", F.col("clip_key").alias("_clip")).join(qa.select("qa_id", F.col("source").alias("_source")), "qa_id")
    joined = links.join(whose, "qa_id", "left")
    rules = {"cache_questions": F.col("_clip").isNotNull(), "cache_clip": F.col("_clip").isNull() | (F.col("_clip") == F.col("clip_key")), "cache_source": F.col("_source").isNull() | (F.col("_source") == F.col("source"))}
    parts = [fold_report(qa, folds, pilot), _none(again, "cache_clips", "clips cached twice"), _none(twice, "cache_links", "questions linked twice"), _counted(joined, rules, "links"), _counted(clips, clip_rules(fixed, n, size, resize), "clips"), _image_report(clips, images, size)]
    return reduce(DataFrame.unionByName, parts)


def training_coverage(qa: DataFrame, folds: DataFrame, pilot: DataFrame, frames: DataFrame) -> DataFrame:
    """Expected, available and missing questions of each split, and PASS or INCOMPLETE."""
    rows = prepared(qa, folds, pilot, frames)
    return splits.coverage(rows, rows.where("frames is not null"), "qa_id")


def receipt_report(receipts: DataFrame, configs: DataFrame, files: DataFrame, base: dict[str, str]) -> DataFrame:
    """Checks of adapters' receipts against the base model (model_id, revision, receipt_sha256), their configs and the files that are there.

    ``receipts`` have root, schema_version, purpose, base_model_id, base_revision, base_receipt_sha256, lora (r, alpha, dropout),
    target_modules and files (path, bytes, sha256); ``configs`` have root and the adapter's own settings; ``files`` root, path, bytes, sha256.
    """
    listed = receipts.select("root", F.inline("files")).join(files.select("root", "path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")), ["root", "path"], "left")
    same = F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha")), F.lit(False))
    disk = listed.groupBy("root").agg(F.count_if(~same).alias("_differ"))
    own = configs.select(F.col("root").alias("_root"), F.struct(*configs.columns).alias("c"))
    rows = receipts.join(own, F.col("root") == F.col("_root"), "left").join(disk, "root", "left")
    suffix = lambda x: F.regexp_extract(x, r"([^.]*)$", 1)
    saved, wanted = F.array_sort("c.target_modules"), F.array_sort("target_modules")
    short = F.forall("c.target_modules", lambda x: F.array_contains(F.transform("target_modules", suffix), x)) & (F.size("c.target_modules") > 0)
    rules = {
        "receipt_schema": F.col("schema_version") == 1,
        "receipt_purpose": F.col("purpose").isin("sft", "smoke"),
        "base_model": F.col("base_model_id") == base["model_id"],
        "base_revision": F.col("base_revision") == base["revision"],
        "base_receipt": F.col("base_receipt_sha256") == base["receipt_sha256"],
        "file_set": F.array_sort(F.transform("files", lambda f: f["path"])) == F.array(*map(F.lit, sorted(ADAPTER_FILES))),
        "files": F.col("_differ") == 0,
        "adapter_type": (F.col("c.peft_type") == "LORA") & (F.col("c.task_type") == "CAUSAL_LM") & (F.coalesce("c.bias", F.lit("none")) == "none"),
        "other_modules": F.col("_root").isNotNull() & (F.coalesce(F.size("c.modules_to_save"), F.lit(0)) <= 0) & ~F.coalesce("c.use_dora", F.lit(False)),
        "target_modules": (saved == wanted) | short,
        "adapter_sizes": (F.col("c.r") == F.col("lora.r")) & (F.col("c.lora_alpha") == F.col("lora.alpha")) & (F.col("c.lora_dropout") == F.col("lora.dropout")),
        "config_base": (F.col("c.base_model_name_or_path") == base["model_id"]) & (F.col("c.revision") == base["revision"]),
    }
    return _counted(rows, rules, "adapters").union(_none(receipts.groupBy("root").count().where("count > 1"), "receipts", "adapters with several receipts"))
