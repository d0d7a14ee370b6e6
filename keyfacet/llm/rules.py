"""Quality rules: learned decision lists over text statistics.

Statistics are taken from whole texts in one Arrow pass. Sequential covering learns a
decision list from labelled rows: each rule is a conjunction of thresholds, grown by
information gain on one part of the labelled rows and pruned on the other. The list is emitted
as one Spark conditional expression, so judging a row is plain column arithmetic.

Defined results: null or empty text has no words and fails the base rule; conflicting labels of a
document drop it from training; without labelled rows of both classes the list is empty and
only the base rule rejects; repeated rows get equal verdicts; a word is all that stands between white space, however
long; an empty table gives no rows; other columns, whatever their names, stay as they are and don't count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import column, sliced, spare, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct")
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS, UPPER, DIGITS, MARKS, STOPS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:"


def repeat_words(ids: np.ndarray, n: int = 3) -> int:
    """Words covered by windows of ``n`` words that occur twice or more, by exact comparison."""
    m = len(ids) - n + 1
    if m < 2:
        return 0
    key, base = ids[:m].astype(np.int64), int(ids.max()) + 1
    for j in range(1, n):
        key = np.unique(key, return_inverse=True)[1] if int(key.max()) * base >= 1 << 62 else key
        key = key * base + ids[j : j + m]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    cover = np.zeros(len(ids) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS`` of a whole text."""
    words = words_of(text)
    if not words:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    bare = raw.translate(None, WHITE)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.encode("utf-8", "surrogatepass").strip(WHITE))
        else:
            seen.add(line)
    without = lambda chars: len(bare) - len(bare.translate(None, chars))
    return (
        len(words), len(text) - (len(raw) - len(bare)), without(SYMBOLS), dup, repeat_words(ids), len(lines),
        without(UPPER), without(DIGITS), without(MARKS), without(STOPS), len(number),
    )


def add_counts(docs: DataFrame, text_col: str, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` columns and the counts of every row; one Arrow pass, no shuffle."""
    names = [prefix + c for c in COUNTS]
    schema = ", ".join(
        [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` long" for c in names)]
    )
    inner = docs.select(*map(column, keep), column(text_col).alias(spare(keep, "text")[0]))

    def run(batches):
        for b in sliced(batches):
            rows = np.array([text_counts(t) for t in b.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            counts = [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *counts], [*keep, *names])

    return inner.mapInArrow(run, schema)


#: Learning features: name, numerator, denominator.
FEATURES = (
    ("words", "n_words", None),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("stops_per_word", "n_stops", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("mean_word", "word_chars", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
)


def feature(name: str, prefix: str = "") -> Column:
    num, den = next((n, d) for f, n, d in FEATURES if f == name)
    top = F.col(prefix + num).cast("double")
    return top if den is None else F.coalesce(top / F.nullif(F.col(prefix + den).cast("double"), F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    """One threshold: ``feature <= cut`` or ``feature > cut``."""

    feature: str
    above: bool
    cut: float

    def column(self, prefix: str = "") -> Column:
        f = feature(self.feature, prefix)
        return f > self.cut if self.above else f <= self.cut

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


Rule = tuple[Test, ...]


def rule_mask(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for t in rule:
        hit &= t.mask(x)
    return hit


def _grow(x: dict, bad: np.ndarray, most: int) -> Rule:
    """Add the threshold of the highest FOIL gain until no good row is covered."""
    hit, rule = np.ones(len(bad), bool), []
    while len(rule) < most:
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p0 or not n0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v = values[hit]
            cuts = np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50)))
            order = np.argsort(v, kind="stable")
            p_cum = np.concatenate([[0], np.cumsum(bad[hit][order])])
            upto = np.searchsorted(v[order], cuts, side="right")
            for above in (False, True):
                p = p0 - p_cum[upto] if above else p_cum[upto]
                total = len(v) - upto if above else upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(total, 1)) - before), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].mask(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule that separates the pruning rows best, its precision and hits."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule) + 1):
        hit = rule_mask(rule[:k], x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + n and (worth := (p - n) / (p + n)) > best[0]:
            best = (worth, rule[:k], p / (p + n), p)
    return best[1], best[2], best[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, min_precision: float = 0.9, max_rules: int = 24, max_tests: int = 4) -> list[Rule]:
    """Sequential covering. ``part``: 0 to 2 for each row; part 2 prunes, the others grow.

    A rule whose precision on the pruning rows is under ``min_precision``, or that catches none of
    them, ends the list: a rejected good document costs more than a kept bad one.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        g, p = left & (part < 2), left & (part == 2)
        if (bad & g).sum() < 3 or not (bad & p).sum():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], max_tests)
        if not rule:
            break
        rule, precision, hits = _prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        if precision < min_precision or not hits:
            break
        rules.append(rule)
        left &= ~rule_mask(rule, x, len(bad))
    return rules


def rejects(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as a conditional: the number of the first rule that holds, else null."""
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column(prefix)
        for t in rule[1:]:
            cond = cond & t.column(prefix)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * n)


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, **how) -> list[Rule]:
    """Learn a list from at most ``sample`` labelled documents, those of the lowest hash of the id.

    ``sample`` bounds what is broadcast and what reaches the driver (some numbers a row).
    """
    agreed = (
        labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .filter("lo = hi")
        .select("_id", F.col("lo").alias("_quality"), F.xxhash64("_id").alias("_h"))
        .orderBy("_h", "_id")
        .limit(sample)
    )
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(agreed), "_id")
    pdf = add_counts(picked, "_text", ["_id", "_quality", "_h"]).dropDuplicates(["_id"]).select(
        "_id", "_quality", "_h", *[feature(f[0]).alias(f[0]) for f in FEATURES], base_failed().alias("_base")
    ).toPandas().sort_values("_id")
    pdf = pdf[~pdf["_base"]]
    x = {f[0]: pdf[f[0]].to_numpy(float) for f in FEATURES}
    return learn(x, (pdf["_quality"] == 0).to_numpy(), (pdf["_h"] % 3).to_numpy(), **how)


def judge(docs: DataFrame, rules: list[Rule], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols``, the counts, ``base_failed``, ``rule`` (first that rejects) and ``kept`` of every row."""
    return (
        add_counts(docs, text_col, id_cols)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", rejects(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor the list rejects, with their columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    counted = add_counts(docs, text_col, docs.columns, prefix)
    return counted.filter(~base_failed(prefix) & rejects(rules, prefix).isNull()).select(*map(column, docs.columns))
