"""Quality rules: counts per text and a learned decision list over them.

Learning is sequential covering. A rule is a conjunction of thresholds that is grown on two thirds of the
labelled rows to hold few good texts, pruned on the rest, and kept while it is precise; the rows it covers are
taken out and the next rule is grown. The list becomes one ordered Spark conditional expression.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pickwise.llm.common import free_name, text_map
from pickwise.llm.textbytes import covered, window_hashes, word_hashes, words_of

SYMBOLS = b"#*$%&|<>"
_CHAR_START = np.array([b & 0xC0 != 0x80 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_distinct bigint, n_upper bigint, n_digits bigint, longest bigint"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(text: str | None) -> tuple[int, ...]:
    """Counts of one text; null counts as empty. Order as in ``STATS``."""
    words = words_of(text)
    if not words:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return (0, 0, int(_SYMBOL[raw].sum()), 0, 0, 0, 0, 0, 0, 0)
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.frombuffer(b"".join(words), np.uint8)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            lines += 1
            dup += line in seen
            seen.add(line)
    n = len(words)
    h = word_hashes(words)
    w = window_hashes(h, 8)
    repeat = 0
    if len(w):
        _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
        hits = np.flatnonzero(count[inverse] > 1)
        repeat = int(covered(hits, 8, n).sum()) if len(hits) else 0
    upper = int(((chars >= 65) & (chars <= 90)).sum())
    digits = int(((chars >= 48) & (chars <= 57)).sum())
    return (n, int(_CHAR_START[chars].sum()), int(_SYMBOL[raw].sum()), dup, repeat, lines, len(np.unique(h)), upper, digits, max(map(len, words)))


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) for every row; null text counts as empty, repeated rows stay repeated."""
    return text_map(docs, STATS, lambda t: [text_stats(t)], id_col, text_col)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that the thresholds are put on, from the counts. Never null."""
    def per(a: str, b: str) -> Column:
        return F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return {
        "mean_chars": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"), "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"), "longest_word": F.col("longest").cast("double"), "log_words": F.log1p(F.col("n_words").cast("double")),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, '<=' or '>', threshold) hold -> drop."""
    tests: tuple[tuple[str, str, float], ...]

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, t in self.tests:
            v = x[:, names.index(name)]
            out &= v <= t if op == "<=" else v > t
        return out

    def column(self) -> Column:
        exprs, out = features(), F.lit(True)
        for name, op, t in self.tests:
            out = out & ((exprs[name] <= t) if op == "<=" else (exprs[name] > t))
        return out


def _best_test(x, bad, weight_good, names):
    """The threshold with the largest information gain for the covered rows, or None."""
    p0, n0 = bad.sum(), (~bad).sum() * weight_good
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut].astype(float), np.cumsum(~b)[cut] * weight_good
        for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best[1]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.98, min_rows: int = 8, max_tests: int = 4, max_rules: int = 20) -> list[Rule]:
    """Ordered rules from labelled rows. ``precision``: share of bad rows that a rule needs among those it covers, on growing and pruning rows together."""
    part = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (bad & left).sum() >= min_rows:
        grow, prune = left & ~part, left & part
        cover, tests = grow.copy(), []
        while len(tests) < max_tests and bad[cover].any() and (~bad[cover]).any():
            t = _best_test(x[cover], bad[cover], 1.0, names)
            if t is None:
                break
            tests.append(t)
            cover &= Rule((t,)).mask(x, names)
        if not tests:
            break

        def worth(k):
            m = Rule(tuple(tests[:k])).mask(x, names) & prune
            p, n = (bad & m).sum(), (~bad & m).sum()
            return (p - 2 * n) / (p + n + 1), p

        rule = Rule(tuple(tests[: max(range(1, len(tests) + 1), key=worth)]))
        m = rule.mask(x, names) & left
        if m.sum() < min_rows or bad[m].mean() < precision:
            rule = Rule(tuple(tests))
            m = rule.mask(x, names) & left
            if m.sum() < min_rows or bad[m].mean() < precision:
                break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Index of the first rule that fires, from 1; 0 if none does. One ordered conditional."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows, those with the smallest hash of their id.

    Rows without a label are left out; an id whose labels differ counts as good. Of texts that share an id the one with the
    smallest counts teaches, so no id enters twice. An empty table or one kind of label gives no rule.
    """
    want = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("k")).agg(F.max(F.col(label_col)).alias("label")).where("label is not null")
    want = want.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(max_labelled)
    exprs = features()
    base = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")).join(F.broadcast(want.select("k")), "k", "left_semi")
    names = list(exprs)
    rows = with_stats(base, "k", "t").join(F.broadcast(want), "k").where(~base_failed()).select("h", "k", "label", *[e.alias(n) for n, e in exprs.items()])
    rows = rows.groupBy("h", "k", "label").agg(F.min(F.struct(*names)).alias("x")).select("h", "k", "label", "x.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(["h", "k", *names], kind="stable")
    return learn(rows[names].to_numpy(float), rows["label"].to_numpy() == 0, names)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts with base_failed, the number of the rule that fired, and kept."""
    name = free_name("rule", stats.columns)
    return (stats.withColumn("base_failed", base_failed()).withColumn(name, verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col(name) == 0)))
