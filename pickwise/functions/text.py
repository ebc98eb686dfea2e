"""Tokenizers, set measures and small string features, all as built-in column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .stopwords import SCORING

# Token shapes. WORD equals Unicode "\w+" of the usual scripting dialects.
WORD = r"[\p{L}\p{N}_]+"
ALPHA = r"[A-Za-z][A-Za-z0-9_-]+"

# White space as Unicode text stripping knows it.
WHITE = " \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnLike) -> Column:
    """Null-safe text."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: ColumnLike) -> Column:
    """Text without white space at both ends, tabs, line ends and non-breaking blanks among it."""
    return F.btrim(col(c), F.lit(WHITE))


def rstrip(c: ColumnLike) -> Column:
    return F.rtrim(col(c), F.lit(WHITE))


def word_list(c: ColumnLike) -> Column:
    """All words, lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(WORD), F.lit(0))


def word_set(c: ColumnLike) -> Column:
    return F.array_distinct(word_list(c))


def alpha_list(c: ColumnLike) -> Column:
    """Letter-initial tokens of two or more characters, lower case, repeats and stop words kept.

    Case is folded after matching, on one joined string, so the pipeline stays in generated code.
    """
    return F.split(F.lower(F.array_join(F.regexp_extract_all(text(c), F.lit(ALPHA), F.lit(0)), " ")), " ")


def tokenize(c: ColumnLike, stop: Sequence[str] = SCORING) -> Column:
    """Letter-initial tokens without stop words, repeats kept."""
    return F.filter(alpha_list(c), lambda t: ~t.isin("", *stop))


def token_set(c: ColumnLike, stop: Sequence[str] = SCORING) -> Column:
    """Distinct `tokenize` tokens. The stop words are a constant set; `array_except` would build one of them in every row."""
    return F.array_distinct(tokenize(c, stop))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def coverage(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Share of a's tokens found in b."""
    return ratio(common(a, b), F.size(a), empty)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of b's tokens found in a; 0 when either side is empty."""
    return ratio(common(a, b), F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    i = common(a, b)
    return ratio(i, F.size(a) + F.size(b) - i)


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * common(a, b), F.size(a) + F.size(b))


def overlap_min(a: Column, b: Column) -> Column:
    return ratio(common(a, b), F.least(F.size(a), F.size(b)))


def remaining(t: Column, h: Column) -> Column:
    return F.array_except(t, h)


def remaining_overlap(t: Column, h: Column, e: Column) -> Column:
    """Share of e's tokens that the task still has open."""
    return overlap_ratio(remaining(t, h), e)


def count_of(c: ColumnLike, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    s = F.lower(text(c))
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


# Verb lists behind the keyword counts.
KEYWORDS = {
    "type": ("type", "enter", "input", "fill", "write", "name", "email", "address", "search for", "phone", "message"),
    "select": ("select", "choose", "pick", "set the", "option", "dropdown"),
    "click": ("click", "go to", "open", "navigate", "button", "view"),
}


def keyword_hits(c: ColumnLike, group: str) -> Column:
    s = F.lower(text(c))
    hits = F.lit(0)
    for k in KEYWORDS[group]:
        hits = hits + s.contains(k).cast("int")
    return hits


def text_stats(task: ColumnLike = "task", history: ColumnLike = "history") -> dict[str, Column]:
    """Length, keyword, quote and digit features of one decision."""
    t, h = text(task), text(history)
    out = {
        "task_len": F.length(t),
        "task_words": F.size(word_list(t)),
        "hist_len": F.length(h),
        "hist_words": F.size(word_list(h)),
        "task_has_dquote": t.contains('"').cast("int"),
        "task_has_squote": t.contains("'").cast("int"),
        "task_has_digit": t.rlike(r"\p{Nd}").cast("int"),
    }
    out |= {f"task_kw_{g}": keyword_hits(t, g) for g in KEYWORDS}
    out |= {f"hist_n_{g}": count_of(h, g) for g in KEYWORDS}
    return out


def truncate(c: ColumnLike, n: int) -> Column:
    """First n characters, right-trimmed and marked with dots, when the text is longer."""
    s = col(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(rstrip(F.substring(s, 1, n)), F.lit("...")))


# Category vocabularies; everything else falls into the last bucket.
TAG_VOCAB = ("input", "textarea", "select", "button", "a", "link", "span", "div", "li", "section")
INPUT_TYPE_VOCAB = ("text", "date", "email", "number", "checkbox", "radio", "password", "tel", "url", "time", "search")


def vocab_index(c: ColumnLike, vocab: Sequence[str]) -> Column:
    at = F.array_position(F.split(F.lit(",".join(vocab)), ","), F.lower(text(c)))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(vocab))).cast("int")


def md5_unit(*parts: ColumnLike | int | float) -> Column:
    """Reproducible uniform number in [0, 1) from the parts."""
    return md5_int(*parts) / F.lit(4294967296.0)


def md5_int(*parts) -> Column:
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("long")


def md5_key(*parts) -> Column:
    cols = [F.lit(str(p)) if isinstance(p, (int, float)) else col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))
