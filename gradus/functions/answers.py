"""Answers to multiple-choice questions: canonical form, answer space and parsing of model output."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import clean, col, strip

# Option letters and the category taxonomy, in its order.
LETTERS = "ABCD"
CATEGORIES = ("single", "multi", "combination", "sequence", "object_interaction", "emotion")
#: Categories with exactly one answer letter.
ONE_LETTER = ("single", "combination", "object_interaction", "emotion")


def category_of(c: Column | str) -> Column:
    return F.lower(clean(c))


def category_rank(c: Column | str) -> Column:
    """Position in the taxonomy, null for unknown categories."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), category_of(c)), F.lit(0)) - 1


def option_letters(prefix: str = "") -> Column:
    """Letters of the options that are not blank, in order."""
    return F.concat(*(F.when(clean(f"{prefix}{x}") != "", F.lit(x)).otherwise("") for x in LETTERS))


def _only(c: Column) -> Column:
    """The option letters that occur in ``c``, in order."""
    return F.concat(*(F.when(F.contains(c, F.lit(x)), F.lit(x)).otherwise("") for x in LETTERS))


def with_assessment(rows: DataFrame, value: Column | str, category: Column | str, options: Column | str, name: str) -> DataFrame:
    """Adds ``name``: struct(canonical, error) of an answer; exactly one of the two is null.

    The first rule that fails names the error: unknown category, no options, empty, letters other
    than A to D, a letter twice, a letter that is not an option, wrong number of letters. ``multi``
    is a set and gets sorted, ``sequence`` a permutation of all options whose order stays.
    What several rules look at is a column of its own, so it is computed once a row.
    """
    kind, have, answer, foreign = (F.col(f"_{x}") for x in ("kind", "have", "answer", "foreign"))
    rows = rows.withColumns({"_kind": category_of(category), "_have": _only(F.upper(F.coalesce(col(options), F.lit("")))), "_answer": F.upper(clean(value)), "_shown": F.coalesce(col(category), F.lit(""))})
    rows = rows.withColumn("_foreign", F.concat(*(F.when(F.contains(answer, F.lit(x)) & ~F.contains(have, F.lit(x)), F.lit(x)).otherwise("") for x in LETTERS)))
    twice = F.lit(False)
    for x in LETTERS:
        twice = twice | (F.length(answer) - F.length(F.replace(answer, F.lit(x), F.lit(""))) > 1)
    error = (
        F.when(~kind.isin(*CATEGORIES), F.concat(F.lit("unknown category: "), F.col("_shown")))
        .when(have == "", F.lit("question has no available options"))
        .when(answer == "", F.lit("prediction is empty"))
        .when(F.translate(answer, LETTERS, "") != "", F.lit("prediction must contain only letters A-D"))
        .when(twice, F.lit("prediction contains duplicate option letters"))
        .when(foreign != "", F.concat(F.lit("prediction selects unavailable option(s): "), foreign))
        .when(kind.isin(*ONE_LETTER) & (F.length(answer) != 1), F.concat(kind, F.lit(" requires exactly one option")))
        .when((kind == "sequence") & (F.length(answer) != F.length(have)), F.concat(F.lit("sequence requires a permutation of all options: "), have))
    )
    rows = rows.withColumn("_error", error)
    canonical = F.when(F.col("_error").isNull(), F.when(kind == "multi", _only(answer)).otherwise(answer))
    return rows.withColumn(name, F.struct(canonical.alias("canonical"), F.col("_error").alias("error"))).drop("_kind", "_have", "_answer", "_shown", "_foreign", "_error")


def answer_space(spark: SparkSession) -> DataFrame:
    """category, options, ord, output of every legal answer: a small table of fixed size."""
    rows = []
    for n in range(1, len(LETTERS) + 1):
        for have in itertools.combinations(LETTERS, n):
            for kind in CATEGORIES:
                if kind == "multi":
                    outs = [c for k in range(1, n + 1) for c in itertools.combinations(have, k)]
                elif kind == "sequence":
                    outs = list(itertools.permutations(have))
                else:
                    outs = [(x,) for x in have]
                rows += [(kind, "".join(have), i, "".join(o)) for i, o in enumerate(outs)]
    return spark.createDataFrame(rows, "category string, options string, ord int, output string")


def next_tokens(prefixes: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each prefix (id, prefix: array) the tokens that can follow it in some output (output: array).

    ``end`` tells whether an output ends there. A prefix that no output has gets no row. The join is
    by prefix equality, made an equi-join by listing each output's own prefixes.
    """
    cut = outputs.select(F.explode(F.expr("transform(sequence(0, size(output)), k -> struct(slice(output, 1, k) AS prefix, get(output, k) AS token))")).alias("x")).select("x.*")
    follow = cut.groupBy("prefix").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.bool_or(F.col("token").isNull()).alias("end"))
    return prefixes.join(follow, "prefix").select("id", "tokens", "end")


def compact(c: Column | str) -> Column:
    """Answer letters without separators, or null if anything else is in the text."""
    x = F.regexp_replace(F.upper(strip(c)), r"(?U)[\s\x{1c}-\x{1f},;/|]+", "")
    return F.when(x.rlike("^[A-D]+$"), x)


# The two accepted forms of an answer inside other text.
BOXED = r"(?iU)\\boxed\s*\{\s*([A-D\s,;/|]+?)\s*\}"
LABELLED = r"(?iU)(?:final\s+answer|answer|答案)\s*(?:is\s*)?[:：]?\s*([A-D](?:[\s,;/|]*[A-D])*)\b"


def with_parsed(rows: DataFrame, raw: Column | str, category: Column | str, options: Column | str, name: str) -> DataFrame:
    """Adds ``name``: struct(candidate, prediction, is_valid, method, error) of a model's raw output.

    The whole text may be the answer; else all boxed and labelled answers must agree.
    """
    text, every, exact, candidate = (F.col(f"_{x}") for x in ("text", "every", "exact", "candidate"))
    rows = rows.withColumns({"_text": clean(raw), "_category": col(category), "_options": col(options)})
    found = {f"_in_{k}": F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), compact)) for k, p in (("boxed", BOXED), ("labelled", LABELLED))}
    rows = rows.withColumn("_exact", compact("_text")).withColumns({k: F.when(exact.isNull(), v).otherwise(F.array().cast("array<string>")) for k, v in found.items()})
    rows = rows.withColumn("_every", F.array_distinct(F.concat(*found)))
    rows = rows.withColumn("_candidate", F.coalesce(exact, F.when(F.size(every) == 1, F.element_at(every, 1))))
    method = F.when(exact.isNotNull(), "exact").when(F.size(every) > 1, "ambiguous").when((F.size(every) == 1) & (F.size("_in_boxed") > 0), "boxed").when(F.size(every) == 1, "labeled")
    rows = with_assessment(rows, candidate, "_category", "_options", "_own")
    error = (
        F.when(text == "", F.lit("model output is empty"))
        .when(candidate.isNull() & (F.size(every) > 1), F.concat(F.lit("model output contains conflicting answer candidates: ['"), F.array_join(F.array_sort(every), "', '"), F.lit("']")))
        .when(candidate.isNull(), F.lit("model output does not match an accepted answer-only format"))
        .otherwise(F.col("_own.error"))
    )
    rows = rows.withColumns({"_prediction": F.when(candidate.isNotNull() & (text != ""), F.col("_own.canonical")), "_method": method, "_error": error})
    out = F.struct(
        F.when(text != "", candidate).alias("candidate"), F.col("_prediction").alias("prediction"), F.col("_prediction").isNotNull().alias("is_valid"), F.when(text != "", F.col("_method")).alias("method"), F.col("_error").alias("error")
    )
    return rows.withColumn(name, out).drop("_text", "_category", "_options", "_exact", *found, "_every", "_candidate", "_own", "_prediction", "_method", "_error")


def option_layout_ok(source: str = "source", category: str = "category") -> Column:
    """A to C are there; D may be missing only for the one source and category that allow it."""
    optional = (clean(source) == "HARn") & (category_of(category) == "single")
    return (clean("A") != "") & (clean("B") != "") & (clean("C") != "") & ((clean("D") != "") | optional)


def options_unique() -> Column:
    from .text import squeeze

    have = F.filter(F.array(*(squeeze(x) for x in LETTERS)), lambda x: x != "")
    return F.size(F.array_distinct(have)) == F.size(have)


def unpermuted(answer: Column | str, order: Column | str, category: Column | str) -> Column:
    """Letters of options as shown to the letters of their original places; null if one is shown nowhere.

    ``order`` has the 0-based original place of each option shown. Where a category's letters are a set, they are sorted again.
    """
    answer, order = (F.col(c) if isinstance(c, str) else c for c in (answer, order))
    at = F.transform(F.filter(F.split(answer, ""), lambda x: x != ""), lambda x: F.get(order, F.call_function("instr", F.lit(LETTERS), x) - 1))
    back = F.transform(at, lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1)))
    back = F.when(category_of(category) == "multi", F.array_sort(back)).otherwise(back)
    return F.when(~F.exists(at, lambda i: i.isNull()), F.array_join(back, ""))
