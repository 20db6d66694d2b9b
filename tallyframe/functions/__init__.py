from tallyframe.functions.answers import (
    answer_candidate,
    answer_label,
    closed_box,
    is_match,
    last_boxed,
    normalize_answer,
    numeric_answer,
    single_label,
)
from tallyframe.functions.text import (
    clock_time,
    file_slug,
    fixed,
    iso_seconds,
    math_prompt,
    normalize_type,
    percent,
    ratio,
    run_stamp,
    slug,
    strip,
    token_count,
    word_count,
)

__all__ = [
    "answer_candidate", "answer_label", "clock_time", "closed_box", "file_slug", "fixed", "is_match",
    "iso_seconds", "last_boxed", "math_prompt", "normalize_answer", "normalize_type",
    "numeric_answer", "percent", "ratio", "run_stamp", "single_label", "slug", "strip",
    "token_count", "word_count",
]
