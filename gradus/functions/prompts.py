"""Prompt text of a question and its check for private fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import LETTERS, ONE_LETTER, category_of, option_letters
from .text import clean, col

# The lines of the prompt; hashes of prompts depend on every byte.
LINE_PROTOCOL = "Prompt protocol: "
LINE_FRAMES = ("The following ", " frames are in chronological order, earliest first.")
LINE_TASK = "Answer the multiple-choice question using only visual evidence from these frames."
LINE_ONE = "Output exactly one available option letter."
LINE_MULTI = "Output all selected option letters once, in alphabetical order, with no separators."
LINE_SEQUENCE = (
    "This is a temporal ordering task, not a single-choice task. Output a complete permutation of ",
    " in the observed temporal order. Your answer must contain every available option letter exactly once, with no separators. Even if some actions are uncertain, provide the full best-estimate permutation.",
)
LINE_PLAIN = "Do not provide an explanation or punctuation."
LINE_ANSWER = "Final answer:"
# Fields whose values must not show in a prompt, and patterns of such values.
SENSITIVE = ("path", "clip_key", "action_name", "subject_id", "trial_id", "source_relative_path")
MARKERS = {
    "raw_video_extension": r"\.mp4\b",
    "windows_path": r"[a-zA-Z]:\\",
    "dataset_directory": r"\b(?:Training|Testing)[/\\]",
    "test_clip_id": r"\bLM_test_\d+\b",
    "subject_path_id": r"\buser\d+[/\\]",
}


def prompt(modality: str = "infrared", protocol: str = "mcq_v2") -> Column:
    """Prompt of columns question, A to D and category; null if question or options are missing."""
    kind, letters = category_of("category"), option_letters()
    rule = F.when(kind.isin(*ONE_LETTER), F.lit(LINE_ONE)).when(kind == "multi", F.lit(LINE_MULTI)).when(kind == "sequence", F.concat(F.lit(LINE_SEQUENCE[0]), letters, F.lit(LINE_SEQUENCE[1])))
    options = F.array_join(F.array_compact(F.array(*(F.when(clean(x) != "", F.concat(F.lit(f"{x}. "), clean(x))) for x in LETTERS))), "\n")
    text = F.concat_ws(
        "\n", F.lit(LINE_PROTOCOL + protocol), F.lit(LINE_FRAMES[0] + modality + LINE_FRAMES[1]), F.lit(LINE_TASK), F.lit(""), F.concat(F.lit("Question: "), clean("question")),
        F.lit("Options:"), options, F.lit(""), F.concat(F.lit("Category: "), kind), rule, F.lit(LINE_PLAIN), F.lit(LINE_ANSWER),
    )
    return F.when((clean("question") != "") & (letters != "") & rule.isNotNull(), text)


def leakage(text: Column | str, fields: list[str] | tuple[str, ...] = SENSITIVE) -> Column:
    """Sorted labels of the fields whose values, or marks of whose kind, show in a text."""
    text = col(text)
    low = F.lower(text)
    by_field = [F.when((F.length(clean(f)) >= 3) & F.contains(low, F.lower(clean(f))), F.lit(f)) for f in fields]
    by_mark = [F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in MARKERS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*by_field, *by_mark))))
