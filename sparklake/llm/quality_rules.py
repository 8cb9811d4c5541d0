"""Quality rules as a learned decision list; DataFrame operations only on the rows.

Statistics of each text are Spark expressions. Sequential covering learns from the statistics of a bounded sample of labelled
rows: a rule is a conjunction of thresholds, grown one condition at a time by information gain on two thirds
of the sample and pruned on the other third; rows that it covers are taken out and the next rule is grown.
The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a decision list is learned from, at most.
SAMPLE_ROWS = 6000
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION, CUTS = 12, 4, 5, 0.75, 48
_SEP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

#: Rates that rules may test, as SQL over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words * 1.0D",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Windows are sorted by hash and position; those whose hash a neighbour has give their positions, and sorted positions cover up to
    three words each.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(marks: Column) -> Column:
        each = F.transform(marks, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(marks, j + 1) - p), F.lit(3)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)

    count = _let(F.sort_array(windows), lambda s: _let(repeated(s), covered))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(count)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other statistics that rules test; ``text_col`` goes."""
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_words = _let(
        F.filter(F.split(text, _SEP), lambda w: w != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = _let(
        F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(_WORD))),
        lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")),
    )
    counts = {"n_symbols": r"[#*$%&|<>]", "n_upper": "[A-Z]", "n_digits": "[0-9]", "n_marks": "[!?:=/]"}
    found = docs.select(*rest, of_words.alias("_w"), of_lines.alias("_l"), *[F.regexp_count(text, F.lit(pattern)).cast("long").alias(name) for name, pattern in counts.items()])
    return found.select(*rest, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_upper", "n_digits", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[tuple[dict, bool]]) -> list[tuple[dict, bool]]:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _counts(rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    bad = sum(b for _, b in rows)
    return bad, len(rows) - bad


def _cuts(rows: list[tuple[dict, bool]], feature: str) -> list[float]:
    values = sorted({r[feature] for r, _ in rows})
    step = max(1, len(values) // CUTS)
    return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)][:: step]


def _grow(rows: list[tuple[dict, bool]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        p, n = _counts(rows)
        if not p or not n:
            break
        best, gain = None, 0.0
        for feature in FEATURES:
            ordered = sorted((r[feature], bad) for r, bad in rows)
            total, at, low_p = len(ordered), 0, 0
            for cut in _cuts(rows, feature):
                while at < total and ordered[at][0] <= cut:
                    low_p += ordered[at][1]
                    at += 1
                for above, q, size in ((False, low_p, at), (True, p - low_p, total - at)):
                    if q >= MIN_COVER and size:
                        now = q * (math.log2(q / size) - math.log2(p / (p + n)))
                        if now > gain:
                            best, gain = Condition(feature, above, cut), now
        if best is None:
            break
        rule += (best,)
        rows = _covered((best,), rows)
    return rule


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    def worth(r: Rule) -> float:
        p, n = _counts(_covered(r, rows))
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Rules for low quality, in order; rows: (features, is low quality). Deterministic in the order of rows."""
    grow, prune = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(grow)
        if not rule:
            break
        rule = _prune(rule, prune)
        p, n = _counts(_covered(rule, grow + prune))
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True if no rule fires: the decision list as one conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> list[tuple[dict, bool]]:
    """(features, is low quality) of at most ``rows`` labelled documents: those whose hashed id comes first, so reruns agree.

    Null ids and labels count nothing. Of several labels of an id the lowest counts, of several documents each, up to ``rows`` in all.
    """
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    picked = picked.orderBy(F.xxhash64(F.lit(7), id_col), id_col).limit(rows)
    found = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(picked), id_col)  # bounded by ``rows``
    stats = with_statistics(found, text_col)
    out = stats.select(id_col, "_y", base_failed().alias("_failed"), *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]).orderBy(F.xxhash64(F.lit(8), id_col), id_col, "n_words").limit(rows).collect()
    return [({name: float(r[name]) for name in FEATURES}, r["_y"] == 0) for r in out if not r["_failed"]]


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, the statistics, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Every row is judged by its own text, repeated rows alike;
    texts may have any length. Without labelled rows there are no rules and the base rules decide; of rules that fire the first
    decides. Null ids are kept as they are. Other columns are left out, so none can clash. An empty table gives no rows.
    """
    stats = with_statistics(docs.select(id_col, text_col), text_col).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))
