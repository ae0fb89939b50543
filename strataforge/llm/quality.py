"""Quality rules: text statistics and a learned decision list that reads like SQL.

Statistics come from whole texts in one pass.  Sequential covering learns an
ordered list of threshold conjunctions for the bad class from a bounded sample
of labelled rows; the list becomes one Spark conditional expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table, text_key, without_rows
from .textvec import Words, slices

#: Labelled rows that the learner may see at most; it runs on the driver.
TRAIN_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct")
_SCHEMA = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _flags(b"0123456789")
_MARK = _flags(b"!?.,;:")


def _totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def repeat_words(words: Words, k: int = 3) -> np.ndarray:
    """For each document its words inside ``k``-word windows that occur twice or more in it."""
    h, where = words.windows(k)
    n = len(words.first) - 1
    if not len(h):
        return np.zeros(n, np.int64)
    doc = words.doc[where]
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s, d = key[order], doc[order]
    equal = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(words.start), dtype=bool)
    for j in range(k):
        covered[where[again] + j] = True
    return _totals(covered, words.first)


def distinct_words(words: Words) -> np.ndarray:
    """Distinct words of each document."""
    if not len(words.start):
        return np.zeros(len(words.first) - 1, np.int64)
    return np.array([len(set(words.hash[a:b].tolist())) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], np.int64)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines, and lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return len(lines), 0
    return len(lines), sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line and not line.isspace())


def _statistics(batches):
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        data, at = words.data, words.at
        raw = data.tobytes()
        lines = [duplicate_lines(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = {
            "n_words": np.diff(words.first),
            "word_chars": _totals(words.live & ((data & 0xC0) != 0x80), at),
            "n_symbols": _totals(_SYMBOL[data], at),
            "n_dup_lines": [x[1] for x in lines],
            "n_repeat_words": repeat_words(words),
            "n_lines": [x[0] for x in lines],
            "n_upper": _totals(_UPPER[data], at),
            "n_letters": _totals(_LETTER[data], at),
            "n_digits": _totals(_DIGIT[data], at),
            "n_marks": _totals(_MARK[data], at),
            "n_distinct": distinct_words(words),
        }
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(columns[c], pa.int64()) for c in COUNTS)], names=["doc_id", "text_key", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, with its ``text_key``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(_statistics, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that the learned conditions may test; all are defined for empty texts."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "symbol_share": over("n_symbols", "word_chars"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "duplicate_line_share": over("n_dup_lines", "n_lines"),
        "upper_share": over("n_upper", "n_letters"),
        "digit_share": over("n_digits", "word_chars"),
        "mark_share": over("n_marks", "n_words"),
        "mean_word": over("word_chars", "n_words"),
        "distinct_share": over("n_distinct", "n_words"),
    }


@dataclass
class Rule:
    """A conjunction of ``(feature, at_least, threshold)``; texts that meet all of them are rejected."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, up, t in self.tests:
            out &= x[name] >= t if up else x[name] <= t
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, up, t in self.tests:
            out = out & (columns[name] >= F.lit(t) if up else columns[name] <= F.lit(t))
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9) -> list[Rule]:
    """Sequential covering.  A rule grows on two thirds of the rows by FOIL gain,
    is pruned from its end on the other third, and is accepted if its smoothed
    precision over all rows still to be covered reaches ``precision``."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    cuts = {n: np.unique(np.quantile(v[np.isfinite(v)], np.linspace(0, 1, 65))) if len(v) else np.zeros(0) for n, v in x.items()}
    trust = lambda m: (m & bad).sum() + 1
    while len(rules) < most_rules and (left & bad).any():
        grow, prune = left & (fold != 0), left & (fold == 0)
        rule, inside = Rule(), grow.copy()
        while len(rule.tests) < most_tests and (inside & ~bad).any():
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if not p:
                break
            best, at = 0.0, None
            for name, ts in cuts.items():
                v = x[name]
                for t in ts:
                    for up in (True, False):
                        m = inside & (v >= t if up else v <= t)
                        a = (m & bad).sum()
                        b = m.sum() - a
                        if a and (gain := a * (np.log2(a / (a + b)) - np.log2(p / (p + n)))) > best + 1e-9:
                            best, at = gain, (name, up, float(t))
            if at is None:
                break
            rule.tests.append(at)
            inside = grow & rule.mask(x)
        worth = lambda r: ((m := prune & r.mask(x)) & bad).sum() * 1.0 - (m & ~bad).sum() * 3.0
        while len(rule.tests) > 1 and worth(Rule(rule.tests[:-1])) > worth(rule):
            rule.tests.pop()
        covered = left & rule.mask(x)
        if not rule.tests or trust(covered) / (covered.sum() + 2) < precision or (covered & bad).sum() < 3:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for texts labelled ``quality`` 0, learned from at most ``rows`` labelled texts that pass the base test."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    names = list(features())
    found = materialize(stats.where(~base_failed()).join(known, "doc_id").select("doc_id", "quality", *(c.alias(n) for n, c in features().items())), "labelled")
    total = found.count()
    if not total:
        return []
    share = min(1.0, rows / total)
    # about ``rows`` of them pass the hash; those with the smallest hashes are the same ones in every run
    place = F.pmod(F.xxhash64("doc_id", "quality", *names), F.lit(1 << 30))
    sample = found.withColumn("place", place).where(F.col("place") <= int(min(1.0, 1.1 * share) * (1 << 30))).orderBy("place", "doc_id", *names).limit(rows).toPandas().sort_values(["doc_id", "place"], ignore_index=True)
    x = {n: sample[n].to_numpy(float) for n in names}
    bad = sample["quality"].to_numpy() == 0
    fold = (sample["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % 3
    return learn(x, bad, fold)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The decision list as Spark conditional expressions: kept or not, and the number of the rule that fired (null: none)."""
    columns = features()
    kept = fired = None
    for i, rule in enumerate(rules):
        test = rule.column(columns)
        kept = F.when(test, False) if kept is None else kept.when(test, False)
        fired = F.when(test, i) if fired is None else fired.when(test, i)
    if kept is None:
        return F.lit(True), F.lit(None).cast("int")
    return kept.otherwise(True), fired


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``rule`` for every row of ``docs``.

    Null and empty texts have zero counts and fail the base test; repeated rows
    are judged alike; without labels only the base test decides.
    """
    stats = materialize(statistics(docs), "statistics")
    kept, fired = verdict(fit(stats, labels))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", fired).withColumn("kept", ~F.col("base_failed") & kept)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base test or the decision list rejects go, each row by its own text."""
    verdicts = judge(docs, table(spark, sf_dir, "labels"))
    return without_rows(docs, verdicts.where("not kept")).select(docs.columns)
