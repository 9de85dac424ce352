"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled from them: over the labelled documents, the documents of either
class that hold a word (or a word with a given beginning) are counted, and tokens of toxic documents whose
evidence stands clear of chance count as toxic. A chain is a line, or each CHAIN tokens of a longer one. The
field's potentials depend on the evidence of a token and its neighbours and on the previous tag; they maximise the
likelihood of all chains of the labelled documents, equal ones counted once with their number. Forward-backward
marginals give the offending spans and, summed up over a document, the features of a logistic score fitted to the
document labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table, written

#: Letters and digits, with single signs inside.
TOKEN = re.compile(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*")
#: Tokens in a chain at most.
CHAIN = 64
BEGINNINGS = (4, 5, 6, 7, 8)
#: What `fit` is given by default: about how many labelled documents, chosen by hash; how many marks (those with the most
#: evidence) the model holds; from how many toxic documents on a mark counts; how many different chains the driver takes.
MOST_LABELLED, MOST_EVIDENCE, LEAST_TOXIC, MOST_CHAINS = 20_000, 50_000, 3, 10_000_000
#: Labelled documents are dealt to so many folds; in fitting, a document's evidence comes from the other folds.
FOLDS = 4
#: Evidence is the lower bound of a log odds ratio; these limits cut it into levels, and below the first is none.
LEVELS = np.array([2.5, 3.5, 4.5, 5.5])
N_LEVELS = len(LEVELS) + 1
#: Words whose evidence a task remembers; documents tagged at once.
WORDS_KEPT, SLICE = 1 << 18, 256


def marks(word: str) -> list[str]:
    """What counts as evidence in a word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


class Evidence(dict):
    """Level of each word, worked out when first met; forgets all words when there are too many."""

    def __init__(self, level: dict[str, int]):
        super().__init__()
        self.level = level

    def __missing__(self, token: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[token] = found = max(self.level.get(m, 0) for m in marks(token.lower()))
        return found


@dataclass
class Field:
    """Potentials: of the evidence at a token (levels x tags), of its neighbours' highest, of tag pairs."""

    own: np.ndarray
    near: np.ndarray
    step: np.ndarray

    @staticmethod
    def zero() -> Field:
        return Field(np.zeros((N_LEVELS, 2)), np.zeros((N_LEVELS, 2)), np.zeros((2, 2)))


def neighbours(levels: np.ndarray) -> np.ndarray:
    near = np.zeros_like(levels)
    near[:, 1:] = levels[:, :-1]
    near[:, :-1] = np.maximum(near[:, :-1], levels[:, 1:])
    return near


def marginals(field: Field, levels: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag) at each token (chains x places x 2), P(tag pair) summed over places (2 x 2) by the chains' weights, and
    log Z of each chain."""
    n, places = levels.shape
    score = np.exp(field.own[levels] + field.near[neighbours(levels)])
    inside = np.arange(places)[None, :] < sizes[:, None]
    score[~inside] = 1.0
    step = np.exp(field.step)
    forward, scale = np.empty((n, places, 2)), np.ones((n, places))
    at = score[:, 0]
    for t in range(places):
        if t:
            at = np.where(inside[:, t, None], (forward[:, t - 1] @ step) * score[:, t], forward[:, t - 1])
        scale[:, t] = np.where(inside[:, t] | (t == 0), at.sum(1), 1.0)
        forward[:, t] = at / scale[:, t, None]
    backward, pairs = np.ones((n, places, 2)), np.zeros((2, 2))
    heavy = np.ones(n) if weights is None else weights
    for t in range(places - 2, -1, -1):
        on = inside[:, t + 1, None]
        ahead = score[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]
        backward[:, t] = np.where(on, ahead @ step.T, 1.0)
        pairs += ((forward[:, t] * on * heavy[:, None]).T @ (ahead * on)) * step
    both = forward * backward
    return both / both.sum(2, keepdims=True), pairs, np.log(scale).sum(1)


@dataclass
class Chains:
    """Chains of like length with their tags, and how often each stands."""

    levels: np.ndarray
    sizes: np.ndarray
    tags: np.ndarray
    weights: np.ndarray

    def counts(self, by: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(by[self.inside], weights=(p[:, :, k] * self.weights[:, None])[self.inside], minlength=N_LEVELS) for k in (0, 1)], axis=1)

    def __post_init__(self):
        self.inside = np.arange(self.levels.shape[1])[None, :] < self.sizes[:, None]
        self.near = neighbours(self.levels)

    def seen(self) -> np.ndarray:
        """How often each feature stands, in the order of a field's parameters."""
        hot = np.stack([1.0 - self.tags, self.tags], axis=2)
        later = self.inside[:, 1:]
        pair = (self.tags[:, :-1] * 2 + self.tags[:, 1:])[later].astype(int)
        steps = np.bincount(pair, weights=np.broadcast_to(self.weights[:, None], later.shape)[later], minlength=4)
        return np.concatenate([self.counts(self.levels, hot).ravel(), self.counts(self.near, hot).ravel(), steps])

    def expected(self, field: Field) -> tuple[float, np.ndarray]:
        """log Z over all chains, and how often each feature is expected."""
        p, pairs, log_z = marginals(field, self.levels, self.sizes, self.weights)
        return float(log_z @ self.weights), np.concatenate([self.counts(self.levels, p).ravel(), self.counts(self.near, p).ravel(), pairs.ravel()])


def as_field(values: np.ndarray) -> Field:
    n = 2 * N_LEVELS
    return Field(values[:n].reshape(-1, 2), values[n : 2 * n].reshape(-1, 2), values[2 * n :].reshape(2, 2))


def fit_field(groups: list[Chains], rounds: int = 60, ridge: float = 1e-4) -> Field:
    """Maximum likelihood with a ridge, by BFGS with halved steps; ends when no slope is over 1e-5."""
    seen = sum(g.seen() for g in groups)
    n = max(1.0, sum(float(g.sizes @ g.weights) for g in groups))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        told = [g.expected(as_field(at)) for g in groups]
        return (sum(z for z, _ in told) - at @ seen) / n + ridge / 2 * at @ at, (sum(e for _, e in told) - seen) / n + ridge * at

    at, bend = np.zeros(len(seen)), np.eye(len(seen))
    value, slope = loss(at)
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-5:
            break
        way, pace = -bend @ slope, 1.0
        while True:
            after, new_slope = loss(at + pace * way)
            if after <= value + 1e-4 * pace * (slope @ way) or pace < 1e-6:
                break
            pace /= 2
        step, turn = pace * way, new_slope - slope
        at, value, slope = at + step, after, new_slope
        if (along := step @ turn) > 1e-12:
            left = np.eye(len(at)) - np.outer(step, turn) / along
            bend = left @ bend @ left.T + np.outer(step, step) / along
    return as_field(at)


def level_chains(text: str, evidence: Evidence) -> list[list[int]]:
    """The evidence levels of each chain of the text, in order."""
    found = []
    for line in text.split("\n"):
        levels = list(map(evidence.__getitem__, TOKEN.findall(line)))
        found += [levels[i : i + CHAIN] for i in range(0, len(levels), CHAIN)]
    return found


class Tagger:
    """Marginals of chains in groups of like length. Chains without any evidence differ by their length alone."""

    def __init__(self, field: Field):
        self.field = field
        self.plain = {k: marginals(field, np.zeros((1, k), np.int64), np.array([k]))[0][0, :, 1] for k in range(1, CHAIN + 1)}

    def __call__(self, chains: list[list[int]]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None if any(c) else self.plain[len(c)] for c in chains]
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(chains):
            if out[i] is None:
                groups.setdefault(1 << (len(c) - 1).bit_length(), []).append(i)
        for wide, members in groups.items():
            for begin in range(0, len(members), 4096):
                some = members[begin : begin + 4096]
                levels = np.array([chains[i] + [0] * (wide - len(chains[i])) for i in some], np.int64)
                sizes = np.array([len(chains[i]) for i in some])
                p = marginals(self.field, levels, sizes)[0][:, :, 1]
                for k, i in enumerate(some):
                    out[i] = p[k, : sizes[k]]
        return out


def tagged(texts: list[str | None], evidence: Evidence, tagger: Tagger) -> list[np.ndarray]:
    """The marginals of each text's tokens."""
    chains = [level_chains(t or "", evidence) for t in texts]
    done = iter(tagger([c for own in chains for c in own]))
    return [np.concatenate([next(done) for _ in own]) if own else np.zeros(0) for own in chains]


def offending(text: str, p: np.ndarray, limit: float) -> list[dict]:
    """Spans of neighbouring tokens of at least limit, in code points."""
    spans: list[dict] = []
    last, hot = -2, p >= limit
    for i, token in enumerate(m for line in re.finditer(r"[^\n]+", text) for m in TOKEN.finditer(text, line.start(), line.end())):
        if hot[i]:
            if last == i - 1:
                spans[-1] = {"begin": spans[-1]["begin"], "end": token.end(), "p": max(spans[-1]["p"], float(p[i]))}
            else:
                spans.append({"begin": token.start(), "end": token.end(), "p": float(p[i])})
            last = i
    return spans


SCORED = "doc_id long, n_tokens long, most double, expected double, hot long, spans array<struct<begin: long, end: long, p: double>>"


def totals(p: np.ndarray) -> tuple[int, float, float, int]:
    """A document's tokens, highest marginal, sum of marginals, and tokens that are rather toxic than not."""
    return len(p), float(p.max(initial=0.0)), float(p.sum()), int((p >= 0.5).sum())


def tag_documents(docs: DataFrame, level: dict[str, int], field: Field, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, told: str | None = None) -> DataFrame:
    """Per row: doc_id, tokens, the highest marginal, the marginals' sum, tokens over one half, and spans of at least
    limit in code points; told: a column (long) to pass through under this name.

    A null or empty text has no tokens and gives zeros and no spans; a long one is tagged whole, chain by chain. Null
    and repeated ids pass through; no rows give none; further columns are ignored.
    """
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    types, names = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), kind], ["n_tokens", "most", "expected", "hot", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, tagger = Evidence(level), Tagger(field)
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                texts, rows = batch.column(1).to_pylist(), []
                for text, p in zip(texts, tagged(texts, evidence, tagger)):
                    found = totals(p)
                    rows.append((*found, offending(text, p, limit) if found[1] >= limit else []))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["doc_id", *names, "told"])

    more = F.lit(None) if told is None else F.col(told)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), more.cast("long").alias("told"))
    tagged_rows = rows.mapInArrow(work, SCORED + ", told long")
    return tagged_rows.drop("told") if told is None else tagged_rows.withColumnRenamed("told", told)


def fold_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(FOLDS)).cast("int")


def evidence_levels(sample: DataFrame, most: int = MOST_EVIDENCE, least_toxic: int = LEAST_TOXIC) -> tuple[dict[str, int], list[dict[str, int]]]:
    """Levels of the marks with the most evidence in sample(text, toxic, fold): `most` at most, each in
    `least_toxic` toxic documents at least; and the like from the documents outside each fold, for those in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                counts[toxic].update({(m, fold) for w in {w.lower() for w in TOKEN.findall(text or "")} for m in marks(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int32()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["mark", "fold", "clean", "toxic"])

    docs = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    one = lambda kind, k: F.sum(F.when(F.col("fold") == k, F.col(kind)).otherwise(0)).alias(f"{kind}{k}")
    counted = sample.select("text", "toxic", "fold").mapInArrow(work, "mark string, fold int, clean long, toxic long").groupBy("mark")
    counted = counted.agg(*(one(kind, k) for kind in ("clean", "toxic") for k in range(FOLDS)))

    def odds(folds: list[int]) -> Column:
        """The lower bound of a mark's log odds ratio from the documents of the folds; null where toxic ones are few."""
        n = {y: sum(docs.get((k, y), 0) for k in folds) for y in (0, 1)}
        clean, toxic = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in ("clean", "toxic"))
        c, a = clean + 0.5, toxic + 0.5
        return F.when(toxic >= least_toxic, F.log(a / F.lit(n[1] + 1.0)) - F.log(c / F.lit(n[0] + 1.0)) - F.sqrt(1 / a + 1 / c))

    every = list(range(FOLDS))
    named = [odds(every).alias("all"), *(odds([j for j in every if j != k]).alias(f"without{k}") for k in every)]
    told = counted.select("mark", *named).withColumn("most", F.greatest("all", *(f"without{k}" for k in every)))
    best = told.where(F.col("most") >= float(LEVELS[0])).orderBy(F.desc("most"), "mark").limit(most).collect()
    level = lambda name: {r["mark"]: int(np.searchsorted(LEVELS, r[name], side="right")) for r in best if r[name] is not None and r[name] >= LEVELS[0]}
    return level("all"), [level(f"without{k}") for k in every]


def labelled_chains(sample: DataFrame, levels: list[dict[str, int]], most: int = MOST_CHAINS) -> list[Chains]:
    """All chains of the sample with their labelled tokens, by length; equal ones of a class stand once, with their
    number. Evidence is that from outside a document's fold, so that a document doesn't tell about itself. More than
    `most` different ones are an error, as the driver takes them all; a smaller sample has fewer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(level) for level in levels]
        for batch in batches:
            found: Counter = Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found.update((toxic, bytes(chain)) for chain in level_chains(text or "", evidence[fold]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["toxic", "levels", "n"])

    counted = sample.select("text", "toxic", "fold").mapInArrow(work, "toxic long, levels binary, n long").groupBy("toxic", "levels").agg(F.sum("n").alias("n"))
    groups: dict[int, list] = {}
    counted = written(counted, "chains")
    if (found := counted.count()) > most:
        raise ValueError(f"{found} different chains of labelled documents, more than {most}: give fewer documents or a higher bound")
    for r in counted.orderBy("toxic", "levels").collect():
        groups.setdefault((len(r["levels"]) - 1).bit_length(), []).append(r)
    done = []
    for power, rows in sorted(groups.items()):
        levels, sizes = np.zeros((len(rows), 1 << power), np.int64), np.array([len(r["levels"]) for r in rows])
        for i, r in enumerate(rows):
            levels[i, : sizes[i]] = np.frombuffer(bytes(r["levels"]), np.uint8)
        toxic = np.array([r["toxic"] for r in rows], float)
        done.append(Chains(levels, sizes, ((levels >= 2) & (toxic[:, None] == 1)).astype(float), np.array([r["n"] for r in rows], float)))
    return done


#: Features of the document score, from the tagged rows.
FEATURES = ["most", "log1p(expected)", "expected / greatest(n_tokens, 1)", "log1p(hot)"]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / max(1, len(y)) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / max(1, len(y)) + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score_of(weights: np.ndarray) -> Column:
    total = F.lit(float(weights[-1]))
    for w, f in zip(weights, FEATURES):
        total = total + F.lit(float(w)) * F.expr(f)
    return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text, toxic, fold of about `most` labelled documents, or of all if there are no more."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(told, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # about `most` ids of 16 bytes
    return written(texts.join(F.broadcast(bounded_sample(ids, "doc_id", most)), "doc_id").withColumn("fold", fold_of("doc_id")), "labelled")


@dataclass
class Model:
    """Evidence levels of marks, the field, and the score's weights; weights of None: every score is the share."""

    level: dict[str, int]
    field: Field
    weights: np.ndarray | None
    share: float = 0.0

    def score(self) -> Column:
        return F.lit(self.share) if self.weights is None else score_of(self.weights)

    def score_row(self, n_tokens: int, most: float, expected: float, hot: int) -> float:
        """The same for one tagged document in a task."""
        if self.weights is None:
            return self.share
        x = np.array([most, np.log1p(expected), expected / max(n_tokens, 1), np.log1p(hot), 1.0])
        return float(1 / (1 + np.exp(-(x @ self.weights))))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_evidence: int = MOST_EVIDENCE, least_toxic: int = LEAST_TOXIC, most_chains: int = MOST_CHAINS) -> Model:
    """A model from the labelled documents among docs, from about most_labelled of them. Without labels, or with one
    class only, it knows a share.

    The model holds the most_evidence marks with the most evidence, each from least_toxic toxic documents at least.
    Different chains of those documents come to the driver; more than most_chains of them raise a ValueError.

    Null labels and null ids tell nothing. Of repeated labels of an id the highest counts; rows that repeat an id
    each count with its label. Null, empty and very long texts count whole, with what tokens they have.
    """
    sample = labelled_sample(docs, labels, most_labelled)
    level, without = evidence_levels(sample, most_evidence, least_toxic)
    groups = labelled_chains(sample, without, most_chains)
    field = fit_field(groups) if groups else Field.zero()
    parts = [tag_documents(sample.where(F.col("fold") == k), without[k], field, told="toxic") for k in range(FOLDS)]
    fitted = reduce(DataFrame.unionByName, parts).selectExpr(*(f"{f} AS f{k}" for k, f in enumerate(FEATURES)), "toxic").toPandas()
    y = fitted["toxic"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(level, field, None, float(y[0]) if len(y) else 0.0)
    return Model(level, field, fit_logistic(fitted[[f"f{k}" for k in range(len(FEATURES))]].to_numpy(float), y))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, score, and its tokens, marginals and spans, from a model of the labels given.

    The score is from 0 to 1 for every row: a null or empty text has no tokens and the score that comes with none; a long
    one counts whole. Without labels every score is 0, with one class only its share. Null and repeated ids pass
    through, a row each; equal texts have equal scores; no rows give none; further columns are ignored, whatever their names.
    """
    model = fit(docs, labels)
    return tag_documents(docs, model.level, model.field).withColumn("score", model.score())


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under limit. Null and empty texts have a score like
    others; repeated rows stay or go together; without labels all rows stay; no rows give none; long texts are scored whole.
    Labels are found by the column doc_id."""
    model, at = fit(docs, labels), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, tagger = Evidence(model.level), Tagger(model.field)
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                found = tagged(batch.column(at).to_pylist(), evidence, tagger)
                yield batch.filter(pa.array([model.score_row(*totals(p)) < limit for p in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: str) -> Column:
    """Whether a document's labels are kept from learning; those without an id are not asked for any."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, by a field that is fitted on the labelled ones that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = score_documents(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "spans")
