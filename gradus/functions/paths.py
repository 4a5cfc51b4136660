"""Path, run and module names as predicates and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean, col

# The form of run names, and of module names that adapters train.
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"
FROZEN = ("visual", "vision_model", "vision_tower", "merger")


def safe_relative(c: Column | str) -> Column:
    """A normal POSIX path below its root: nothing absolute, no ``..``, ``\\``, ``:`` or control characters."""
    c = F.coalesce(col(c), F.lit(""))
    parts = F.split(c, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (c != "") & ~odd & ~F.contains(c, F.lit("\\")) & ~F.contains(c, F.lit(":")) & ~c.rlike(r"[\x00-\x1f]")


def is_run_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(RUN_ID), F.lit(False))


def clip_path(c: Column | str) -> Column:
    """Slashes forward, no slash at the end; a video file stands for the folder two levels up."""
    p = F.regexp_replace(F.replace(clean(c), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.lower(p).endswith(".mp4"), F.regexp_replace(p, "/[^/]*/[^/]*$", "")).otherwise(p)


def trainable_module(name: Column | str, suffixes: tuple[str, ...] = ("q_proj", "v_proj")) -> Column:
    """A decoder projection outside the frozen parts of the model."""
    name = col(name)
    parts = F.split(name, r"\.")
    return F.element_at(parts, -1).isin(*suffixes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, FROZEN)))


def incomplete_layers(modules: DataFrame, name: str = "name", suffixes: tuple[str, ...] = ("q_proj", "v_proj")) -> DataFrame:
    """layer, missing of decoder layers that have some of the trained projections, but not all."""
    own = modules.where(trainable_module(name, suffixes)).select(layer_of(name).alias("layer"), F.element_at(F.split(col(name), r"\."), -1).alias("part"))
    gone = F.array_except(F.array(*map(F.lit, suffixes)), F.collect_set("part"))
    return own.groupBy("layer").agg(gone.alias("missing")).where(F.size("missing") > 0)


def layer_of(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", "")
