"""Quality rules as learned decision lists.

Statistics of every whole text are computed in tasks. From the labelled documents' statistics sequential covering
learns an ordered list of rules: each grows, condition by condition, into a conjunction of thresholds that covers
bad documents, is pruned on documents held back, and takes the documents that it covers out of the rest. The
list is then one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*BASE, "n_lines", "n_punctuation", "n_upper"]
#: Ratios that rules may test, as expressions over the statistics.
RATIOS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_a_line": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words_a_word": "n_repeat_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "punctuation_a_word": "n_punctuation / greatest(n_words, 1)",
    "upper_a_word": "n_upper / greatest(n_words, 1)",
}
#: Labelled documents that a list is learned from: about so many, chosen by the hashes of their ids, or all.
MOST_LABELLED = 20_000
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (hashed[k : k + n] ^ (hashed[k : k + n] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    codes = np.frombuffer(text, np.uint8)
    points = len(text) - int(((codes & 0xC0) == 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    return (
        len(words), points - spaces, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), sum(text.count(c) for c in (b".", b",", b";", b"!", b"?")), upper,
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the STATISTICS of each row's whole text, long ones too.

    A null text counts as empty: all are 0. Null and repeated ids pass through, a row each; no rows give none; further
    columns are ignored, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            columns = list(zip(*rows)) or [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *STATISTICS])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *STATISTICS])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary")).mapInArrow(work, schema)


@dataclass(frozen=True)
class Test:
    name: str
    at_least: bool
    limit: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.limit if self.at_least else x[self.name] < self.limit

    def column(self) -> Column:
        value = F.expr(RATIOS.get(self.name, self.name)).cast("double")
        return value >= F.lit(self.limit) if self.at_least else value < F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.limit:g}"


def covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for test in rule:
        held &= test.of(x)
    return held


def grow(x: dict[str, np.ndarray], bad: np.ndarray, limits: dict[str, np.ndarray], most: int = 6) -> list[Test]:
    """Conditions are added by information gain until none adds any, or there are `most`; of equal gains the first
    statistic, bound and limit."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while bad[inside].sum() < inside.sum() and len(rule) < most:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for name, cuts in limits.items():
            values, flags = x[name][inside], bad[inside]
            order = np.argsort(values, kind="stable")
            ranked, p_below = values[order], np.concatenate([[0], np.cumsum(flags[order])])
            at = np.searchsorted(ranked, cuts, side="left")
            for at_least, p, size in ((False, p_below[at], at), (True, p0 - p_below[at], len(values) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / size) - np.log2(p0 / (p0 + n0))), 0)
                if len(g) and g.max() > gain:
                    k = int(np.argmax(g))
                    best, gain = Test(name, at_least, float(cuts[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.of(x)
    return rule


def prune(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """The leading conditions with the best (p - n) / (p + n) on documents held back; the shortest of equals."""
    def worth(k: int) -> float:
        held = covered(rule[:k], x, len(bad))
        p, n = bad[held].sum(), (~bad[held]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 9), -k))]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.85, least_covered: int = 5, cuts: int = 128, seed: int = 7, most_rules: int = 30, most_conditions: int = 6) -> list[tuple[list[Test], float]]:
    """The ordered rules, each with its precision over the documents that reach it.

    x holds the statistics by name, bad the labels, a place a document. A rule needs least_precision where it was grown
    and on documents held back, and least_covered documents; thresholds are taken from so many quantiles (cuts). Rows
    in the same order give the same rules; repeated rows count each. Empty labels, or no bad ones: no rules.
    """
    rules: list[tuple[list[Test], float]] = []
    left = np.arange(len(bad))
    dice = np.random.default_rng(seed)
    while bad[left].sum() >= least_covered and len(rules) < most_rules:
        dealt = dice.permutation(left)
        growing, held_back = dealt[: 2 * len(dealt) // 3], dealt[2 * len(dealt) // 3 :]
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        gx, gy = part(growing)
        limits = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) for k, v in gx.items() if len(v)}
        rule = grow(gx, gy, limits, most_conditions)
        if not rule:
            break
        rule = prune(rule, *part(held_back))
        hit_held = covered(rule, part(held_back)[0], len(held_back))
        hit = covered(rule, part(left)[0], len(left))
        precision = float(bad[left][hit].mean()) if hit.any() else 0.0
        checked = float(bad[held_back][hit_held].mean()) if hit_held.any() else precision
        if min(precision, checked) < least_precision or hit.sum() < least_covered:
            break
        rules.append((rule, precision))
        left = left[~hit]
    return rules


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics and labels of about `most` labelled documents, or of all if there are no more.

    Null labels and ids tell nothing; of repeated labels of an id the lowest counts; repeated rows count each. They come
    ordered by id and statistics, so that the same tables give the same arrays.
    """
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    rows = bounded_sample(stats.join(told, "doc_id"), "doc_id", most)
    names = [*STATISTICS, *RATIOS]
    frame = rows.select(*STATISTICS, *(F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()), "_label", "doc_id").orderBy("doc_id", *STATISTICS).toPandas()
    return {n: frame[n].to_numpy(float) for n in names}, frame["_label"].to_numpy() == 0


def verdict(rules: list[tuple[list[Test], float]]) -> tuple[Column, Column]:
    """The first rule that holds, counted from 1 and 0 for none, and whether its document is kept."""
    if not rules:
        return F.lit(0), F.lit(True)
    case = None
    for k, (rule, _) in enumerate(rules, 1):
        held = F.lit(True)
        for test in rule:
            held = held & test.column()
        case = F.when(held, F.lit(k)) if case is None else case.when(held, F.lit(k))
    number = case.otherwise(F.lit(0))
    return number, number == 0


def apply_rules(stats: DataFrame, rules: list[tuple[list[Test], float]]) -> DataFrame:
    """stats with rule (the first that holds, from 1; 0 for none), base_failed and kept; columns of these names are
    replaced. Null statistics satisfy no rule; rows pass through one by one, so repeats, ties and no rows are no matter."""
    number, good = verdict(rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumns({"rule": number, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & good)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the rules that the labelled ones give."""
    stats = written(text_statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = learn(*labelled_sample(stats, table(spark, sf_dir, "labels")))
    return apply_rules(stats, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
