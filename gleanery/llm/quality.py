"""Quality classifier: document evidence and hierarchical empirical Bayes over hosts and paths.

Two logistic models, good quality and toxicity, are fitted on at most MAX_LABELLED labelled rows (chosen by a hash of the
id).  Their inputs are shape figures of the whole text (case, marks, symbols, digits, bars, repeated words and lines,
word lengths) and word evidence: words and word beginnings whose label counts stand out, each with its log odds.  Then
all documents are scored, once, into a table in the shared folder.  Sums of the scores by path and host, over all
documents, give posteriors: a host's mean is shrunk to the global mean, a path's to its host's, each by a strength fitted
to the spread of the means (method of moments), so sparse sites stay near the prior.  A document's log odds move by PULL times the log odds of its path over the global ones.  A document
is kept when its quality is at least one half and its toxicity less.

The aggregates are partial sums before they are shuffled; the site table joins by Spark's own choice of join, and a site
with a third of all rows is split by it.

Results in special cases: a null or empty text has no evidence and gets the prior of its site and is kept unless that
speaks against it; null hosts and paths form sites of their own; labels that are null, or of unknown documents, are not
used; a labelled id of several rows counts once; without labels of both kinds a model falls back to its share; repeated rows are scored each; other columns pass, as
they travel in a struct of their own, and only ``classify`` puts results in place of columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED, MAX_WORDS, LEAST_COUNT, PULL = 20_000, 1_000, 4, 0.3
TARGETS = ("quality", "toxic")
_TABLE = bytes(32 if common.NON_WORD[i] else i for i in range(256))
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 10, 13]] = 4
for _c in b".,;:'\"()-":
    _CLASS[_c] = 5
_CLASS[128:] = 6
_CLASS[ord("|")], _CLASS[ord("!")], _CLASS[ord("?")] = 7, 8, 8
SHAPES, CLUES = 14, 12


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TABLE).split()


def clues(words: list[bytes]) -> set[bytes]:
    """Distinct words and their beginnings (four and five bytes, marked), so that a word's family counts too."""
    own = set(words)
    own |= {w[:4] + b"*" for w in own if len(w) > 4} | {w[:5] + b"*" for w in own if len(w) > 5}
    return own


def shape(text: str, words: list[bytes]) -> list[float]:
    """Figures between about 0 and 1 that don't depend on the length of a text, but for the last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    c = np.bincount(_CLASS[raw], minlength=9) / n
    letters = max(1e-9, c[1] + c[2] + c[6])
    lines = [x for x in text.split("\n") if x.strip()]
    count = max(1, len(words))
    return [
        c[1] / letters, c[3], c[5], c[7], c[8], c[0], c[6], 1 - len(set(words)) / count, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(map(len, words)) / count / 20), min(1.0, (text.count(".") + text.count("!") + text.count("?")) / count),
        float(bool(re.search(r"[#$%&*]{3}", text))), sum(len(w) > 14 for w in words) / count, min(1.0, np.log1p(len(words)) / 10),
    ]


class Model:
    """Word log odds and logistic weights of both targets."""

    def __init__(self) -> None:
        self.words: dict[str, dict[bytes, float]] = {t: {} for t in TARGETS}
        self.weights: dict[str, np.ndarray] = {}
        self.mean, self.scale = np.zeros(0), np.ones(0)
        self.share = {t: 0.5 for t in TARGETS}

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        out = shape(text, words)
        own = clues(words)
        for t in TARGETS:
            odds = {w: self.words[t][w] for w in own & self.words[t].keys()}
            up = sorted((v for w, v in odds.items() if v > 0 and w[-1:] != b"*"), reverse=True)[:3] + [0.0] * 3
            n_up, n_down = sum(v > 0 for v in odds.values()), sum(v < 0 for v in odds.values())
            # one clue may be chance, several aren't; many words have more chances
            out += [*up[:3], float(np.log1p(n_up)), float(np.log1p(n_down)), min(1.0, 10 * n_up / max(1, len(words)))]
        return out

    def fit(self, x: np.ndarray, y: dict[str, np.ndarray]) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        for t in TARGETS:
            w, target = np.zeros(z.shape[1]), y[t].astype(float)
            if 0 < target.sum() < len(target):
                ridge = np.eye(len(w)) * (0.02 * len(x) ** 0.5 + 0.1)
                for _ in range(25):  # Newton steps
                    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                    step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (target - p) - ridge @ w)
                    w += step
                    if np.abs(step).max() < 1e-6:
                        break
            else:
                w[-1] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
            self.weights[t] = w

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Rows of (quality, toxic); an empty text has the shares of the labels."""
        out = np.tile([self.share[t] for t in TARGETS], (len(texts), 1))
        some = [i for i, t in enumerate(texts) if t and words_of(t)]
        if some:
            z = np.hstack([(np.array([self.features(texts[i]) for i in some]) - self.mean) / self.scale, np.ones((len(some), 1))])
            for k, t in enumerate(TARGETS):
                out[some, k] = 1 / (1 + np.exp(-np.clip(z @ self.weights[t], -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    common.prepare(spark)
    known = labels.where(" and ".join(f"{t} is not null" for t in TARGETS)).where(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id_")).agg(*(F.max(F.col(t).cast("int")).alias(f"y_{t}") for t in TARGETS))
    chosen = known.orderBy(F.xxhash64("id_")).limit(limit)  # ``limit`` rows of three numbers: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id_").where("text is not null")
    # an id that many rows have is one labelled document, by its smallest text
    rows = rows.groupBy("id_", *(f"y_{t}" for t in TARGETS)).agg(F.min("text").alias("text")).drop("id_")
    rows = common.table(rows, "quality-labelled")
    model = Model()
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"y_{t}").alias(t) for t in TARGETS)).first()
    if not total.n:
        model.fit(np.zeros((1, SHAPES + CLUES)), {t: np.zeros(1) for t in TARGETS})
        model.share = {"quality": 1.0, "toxic": 0.0}
        for t in TARGETS:
            model.weights[t] = np.append(np.zeros(SHAPES + CLUES), np.log((0.99 if t == "quality" else 0.01) / (0.01 if t == "quality" else 0.99)))
        return model
    model.share = {t: total[t] / total.n for t in TARGETS}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {t: Counter() for t in ("n", *TARGETS)}
            for text, *y in zip(b.column("text").to_pylist(), *(b.column(f"y_{t}").to_pylist() for t in TARGETS), strict=True):
                own = clues(words_of(text))
                seen["n"].update(own)
                for t, v in zip(TARGETS, y, strict=True):
                    if v:
                        seen[t].update(own)
            keys = list(seen["n"])
            yield pa.RecordBatch.from_arrays(
                [common.binary_list(keys), *(pa.array([seen[t][k] for k in keys], pa.int64()) for t in seen)], names=["word", "n", *TARGETS]
            )

    counts = rows.mapInArrow(common.frugal(count), "word binary, n long, quality long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS)))
    for t in TARGETS:
        p = min(max(model.share[t], 1e-6), 1 - 1e-6)
        odds = F.log((F.col(t) + 0.5 * p) / (F.col("n") - F.col(t) + 0.5 * (1 - p))) - float(np.log(p / (1 - p)))
        z = (F.col(t) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
        whole = ~F.endswith("word", F.lit(b"*"))  # beginnings are many: they have to stand out more
        stands = ((F.col("n") >= LEAST_COUNT) & (F.col("z") >= 4.5) & whole) | ((F.col("n") >= 2 * LEAST_COUNT) & (F.col("z") >= 6))
        top = counts.withColumns({"odds": odds, "z": F.abs(z)}).where(stands).orderBy(F.desc("z"), "word").limit(MAX_WORDS)
        model.words[t] = {bytes(r.word): r.odds for r in top.select("word", "odds").collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.features(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [common.long_list(x.ravel().view(np.int64), np.full(len(x), x.shape[1])), *(b.column(f"y_{t}") for t in TARGETS)], names=["x", *(f"y_{t}" for t in TARGETS)]
            )

    table = rows.mapInArrow(common.frugal(features), "x array<long>, y_quality int, y_toxic int").toArrow()
    x = np.array(table["x"].to_pylist(), np.int64).view(np.float64)
    model.fit(x, {t: table[f"y_{t}"].to_numpy() for t in TARGETS})
    return model


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def with_evidence(docs: DataFrame, model: Model, text_col: str, host: Column, path: Column, keep_text: bool = True) -> DataFrame:
    """Columns row (struct of all columns of ``docs``; without the text, if that isn't wanted), host, path, and quality and
    toxic: each document's own evidence.  Every text is read once."""
    common.prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * MAX_WORDS words and two weight vectors
    names = [c for c in docs.columns if keep_text or c != text_col]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    text = [] if keep_text else [F.col(text_col).alias("text")]
    scored = docs.select(row, host.alias("host"), path.alias("path"), F.lit(None).cast("double").alias("quality"), F.lit(None).cast("double").alias("toxic"), *text)
    at = names.index(text_col) if keep_text else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(at) if keep_text else b.column(5)
            p = sent.value.predict(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p[:, 0]), pa.array(p[:, 1])], names=b.schema.names[:5])

    return scored.mapInArrow(common.frugal(run), scored.drop("text").schema)


def strength(n: float | None, ss: float | None, k: int, m: float) -> float:
    """Beta strength of k groups of n rows in all, whose spread of means matches the one observed (``ss``: squared gaps of
    the groups' means from m, by rows) beyond binomial noise."""
    if not n or k < 2:
        return 100.0
    return _clamped(m * (1 - m), ss / n - m * (1 - m) * k / n)


def strength_within(n: float | None, ss: float | None, noise: float | None, v: float | None) -> float:
    """The same for groups within groups, over those outer groups that have several: ``ss`` holds squared gaps of the inner means
    from their own outer group's mean, ``noise`` what binomial noise alone would make of them, ``v`` the variance within, by rows."""
    return _clamped(v / n, (ss - noise) / n) if n else 100.0


def _clamped(variance: float, spread: float) -> float:
    return float(min(max(variance / max(spread, 1e-6) - 1, 5.0), 1000.0))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """Posterior means by host and path of rows with host, path, quality, toxic: columns h, p, host_*, site_* and all_*."""
    paths = common.table(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(f"s_{t}") for t in TARGETS)), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(t) for t in TARGETS)).first()
    mean = {t: (total[t] or 0.0) / (total.n or 1) for t in TARGETS}
    inner = (F.sum(F.pow(f"s_{t}", 2) / F.col("n")).alias(f"q_{t}") for t in TARGETS)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS), *inner)
    hosts = common.table(hosts, "quality-host-sums")
    own = lambda t: F.col(f"s_{t}") / F.col("n")
    spread = (F.sum(F.col("n") * F.pow(own(t) - mean[t], 2)).alias(t) for t in TARGETS)
    r = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *spread).first()
    kh = {t: strength(r.n, r[t], r.k, mean[t]) for t in TARGETS}
    # a host's paths: gaps of their means from its own, by rows, are the sum of s^2 / n less that of the host
    within = [F.sum("n").alias("n")]
    for t in TARGETS:
        v = own(t) * (1 - own(t))
        within += [F.sum(F.col(f"q_{t}") - F.col("n") * F.pow(own(t), 2)).alias(f"ss_{t}"), F.sum(v * (F.col("k") - 1)).alias(f"noise_{t}"), F.sum(F.col("n") * v).alias(f"v_{t}")]
    r = hosts.where("k > 1").agg(*within).first()
    kp = {t: strength_within(r.n, r[f"ss_{t}"], r[f"noise_{t}"], r[f"v_{t}"]) for t in TARGETS}
    host = hosts.select(F.col("host").alias("h"), *(((F.lit(kh[t] * mean[t]) + F.col(f"s_{t}")) / (F.lit(kh[t]) + F.col("n"))).alias(f"host_{t}") for t in TARGETS))
    both = paths.join(common.table(host, "quality-hosts"), F.col("host").eqNullSafe(F.col("h")))
    return both.select(
        "h", F.col("path").alias("p"), *(F.col(f"host_{t}") for t in TARGETS),
        *(((F.lit(kp[t]) * F.col(f"host_{t}") + F.col(f"s_{t}")) / (F.lit(kp[t]) + F.col("n"))).alias(f"site_{t}") for t in TARGETS),
        *(F.lit(mean[t]).alias(f"all_{t}") for t in TARGETS),
    )


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep_text: bool = True) -> DataFrame:
    """Columns row (struct of the columns of ``docs``), host_*, site_*, all_*, p_quality, p_toxic and keep; by default hosts
    are sources, paths languages."""
    model = train(docs, labels, id_col, text_col)
    evidence = with_evidence(docs, model, text_col, F.col("source") if host is None else host, F.col("lang") if path is None else path, keep_text)
    scored = common.table(evidence, "quality-scored")
    sites = common.table(site_posteriors(scored), "quality-sites")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p", "host", "path")
    pulled = {t: 1 / (1 + F.exp(-(_logit(F.col(t)) + PULL * (_logit(F.col(f"site_{t}")) - _logit(F.col(f"all_{t}")))))) for t in TARGETS}
    out = joined.withColumns({f"p_{t}": pulled[t] for t in TARGETS})
    # rounded, so that the order in which sums are taken decides nothing
    return out.withColumn("keep", (F.round("p_quality", 9) >= 0.5) & (F.round("p_toxic", 9) < 0.5))


RESULTS = ("p_quality", "p_toxic", "host_quality", "site_quality", "host_toxic", "site_toxic", "keep")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` and the columns RESULTS; a column of ``docs`` of such a name gives way to the result."""
    out = judged(docs, labels, id_col, text_col, host, path, keep_text)
    return common.beside(out, [c for c in docs.columns if keep_text or c != text_col], {c: F.col(c) for c in RESULTS})


def kept(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns only, whatever these are called."""
    return judged(docs, labels, **columns).where("keep").select("row.*")
