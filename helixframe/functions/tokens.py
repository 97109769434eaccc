"""Column functions on token arrays and word strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: our vocabulary layout (special ids first) ---
PAD_ID = 0
UNK_ID = 1
CLS_ID = 2
SEP_ID = 3
MASK_ID = 4
N_SPECIAL = 5
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
MAX_LENGTH = 100          # token width including CLS and SEP
CONTINUATION_PREFIX = "##"
# --- end of fixed values ---


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_words(text: Column | str) -> Column:
    """split on whitespace runs, dropping empty words (Spark keeps edge empties)."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def trim_special(tokens: Column | str) -> Column:
    """Drop the first and the last element."""
    t = _c(tokens)
    return F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))


def add_special(tokens: Column | str, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """[CLS] + tokens + [SEP]."""
    return F.concat(F.array(F.lit(cls_id)), _c(tokens), F.array(F.lit(sep_id)))


def add_special_mask(mask: Column | str) -> Column:
    """P8 for the attention mask: 1 in front, 0 behind (as in the reference)."""
    return F.concat(F.array(F.lit(1)), _c(mask), F.array(F.lit(0)))


def truncate_tokens(tokens: Column | str, max_length: int = MAX_LENGTH) -> Column:
    """Keep room for the two specials."""
    return F.slice(_c(tokens), 1, max_length - 2)


def pad_right(tokens: Column | str, width: Column | int, pad_id: int = PAD_ID) -> Column:
    t = _c(tokens)
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(t, F.array_repeat(F.lit(pad_id), F.greatest(w - F.size(t), F.lit(0))))


def attention_mask(tokens: Column | str, width: Column | int) -> Column:
    """1 for each real token, 0 for padding, to ``width``."""
    t = _c(tokens)
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.array_repeat(F.lit(1), F.size(t)),
                    F.array_repeat(F.lit(0), F.greatest(w - F.size(t), F.lit(0))))


def token_diversity(tokens: Column | str) -> Column:
    """Per sequence: distinct tokens / length (A24 averages it)."""
    t = _c(tokens)
    return F.try_divide(F.size(F.array_distinct(t)), F.size(t))


def ngrams(words: Column | str, n: int) -> Column:
    """Contiguous n-grams joined by a blank."""
    w = _c(words)
    m = F.size(w) - n + 1
    return F.when(m >= 1, F.transform(
        F.sequence(F.lit(1), m), lambda i: F.array_join(F.slice(w, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def uniform_draw(*parts: Column | str) -> Column:
    """Reproducible U[0,1) from md5 of the parts joined by ':'.

    Partition independent and identical in any SQL engine with md5.
    """
    s = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_key(*parts: Column | str) -> Column:
    """A 32-bit non-negative ordering key from md5 (used for seeded shuffles)."""
    s = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
