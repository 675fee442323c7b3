"""Column functions; all are built from Spark's own, so they stay inside its generated code."""

from .arrays import cosine, dot, is_subset, jaccard, l2_norm, sorted_distinct, string_array
from .stats import f_measure, ratio_or, wilson
from .text import blank_to_null, contains_non_ascii, content_hash, fingerprint, has_mojibake, human_bytes, normalize_text, qualified_name, strip_fences, surrogate_key
from .time import day_diff, month_start

__all__ = [
    "blank_to_null", "contains_non_ascii", "content_hash", "cosine", "day_diff", "dot", "f_measure", "fingerprint", "has_mojibake", "human_bytes", "is_subset", "jaccard",
    "l2_norm", "month_start", "normalize_text", "qualified_name", "ratio_or", "sorted_distinct", "string_array", "strip_fences", "surrogate_key", "wilson",
]
