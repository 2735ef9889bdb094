"""Operator 2, mixing sources to target weights: soft membership and projected-gradient least squares.

Everything here is DataFrame and SQL functions. The driver sees aggregates of a size that depends on the
number of domains and on VOCABULARY alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, read_documents, staged, words_column
from tessera.llm.quality_rules import SYMBOLS, count_of

TRAINING_ROWS = 6000
VOCABULARY = 96
#: Shares of tokens that op2 and the pipeline mix to; domains come from the labels table (domain_labels).
TARGETS = {"good": 0.92, "low": 0.03, "toxic": 0.05}
RIDGE = 1e-3
MOST_ROUNDS = 60
TOLERANCE = 1e-9


def domain_labels(labels: DataFrame) -> DataFrame:
    """(_q_id, _q_label) from the labels table: low quality, else toxic, else good."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select(F.col("doc_id").alias("_q_id"), domain.alias("_q_label"))


def _with_evidence(rows: DataFrame) -> DataFrame:
    """Add _m_words, _m_unique and _m_shapes (marks of a text's shape; no word holds a blank) to rows with text."""
    out = rows.withColumn("_m_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_m_words", words_column(F.col("_m_text")))
    out = out.withColumn("_m_unique", F.array_distinct("_m_words"))
    n = F.size("_m_words")
    flags = {
        " symbols": count_of(F.col("_m_text"), SYMBOLS) * 10 > n,
        " same": F.size("_m_unique") * 10 < n * 3,
        " short": n < 10,
    }
    return out.withColumn("_m_shapes", F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in flags.items())), lambda x: x.isNotNull()))


@dataclass(frozen=True)
class Classifier:
    """Softmax regression on evidence that is present: per domain a bias and a weight for each piece of evidence that is present."""

    domains: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]

    def scores(self, words: Column, shapes: Column) -> Column:
        """array<double> of the domains' log posteriors up to a constant, in the order of domains."""
        doubles = lambda xs: F.array(*map(F.lit, map(float, xs)))
        scores = doubles(self.bias)
        if self.weights:
            known = F.array(*map(F.lit, self.weights))
            table = F.create_map(*(x for w, v in self.weights.items() for x in (F.lit(w), doubles(v))))
            present = F.array_intersect(F.concat(words, shapes), known)
            scores = F.aggregate(present, scores, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
        return scores


def fit_classifier(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", training_rows: int = TRAINING_ROWS, vocabulary: int = VOCABULARY) -> Classifier:
    """Fit on a sample of about training_rows labelled documents; labels has _q_id and _q_label (the domain).

    Softmax regression with a small ridge, fitted on the driver to the sample's evidence (0 or 1 each). Evidence is the `vocabulary` words and shapes with the largest mutual information with the domain
    among those that at least 10 sampled documents hold. Without usable labels there is one domain, all.
    """
    rows = labelled_sample(docs, labels, training_rows, id_column, text_column)
    if rows is None:
        return Classifier(("all",), (0.0,), {})
    held = _with_evidence(rows).select("_q_id", "_q_label", F.concat("_m_unique", "_m_shapes").alias("e"))
    held = staged(held)
    sizes = {r["_q_label"]: r["n"] for r in held.groupBy("_q_label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier(("all",), (0.0,), {})
    domains = tuple(sorted(sizes))
    total = sum(sizes.values())
    counted = held.select("_q_label", F.explode("e").alias("w")).groupBy("w").agg(*(F.sum((F.col("_q_label") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(domains)))
    counted = counted.withColumn("n", reduce(add, (F.col(f"n{i}") for i in range(len(domains))))).where((F.col("n") >= 10) & (F.col("n") < total))

    def part(n: Column, of: Column, marginal: Column) -> Column:
        return F.when(n > 0, n / total * F.log(n * float(total) / (of * marginal))).otherwise(0.0)

    gains = []
    for i, d in enumerate(domains):
        size = F.lit(float(sizes[d]))
        gains += [part(F.col(f"n{i}"), size, F.col("n")), part(size - F.col(f"n{i}"), size, total - F.col("n"))]
    best = counted.withColumn("gain", F.round(reduce(add, gains), 9)).orderBy(F.desc("gain"), "w").limit(vocabulary).collect()
    words = [r["w"] for r in best]
    known = F.array(*map(F.lit, words)).cast("array<string>") if words else F.array().cast("array<string>")
    sample = held.select("_q_label", F.array_intersect("e", known).alias("e")).collect()
    place = {w: i for i, w in enumerate(words)}
    design = np.zeros((len(sample), len(words) + 1))
    design[:, -1] = 1
    truth = np.zeros((len(sample), len(domains)))
    for i, r in enumerate(sample):
        design[i, [place[w] for w in r["e"]]] = 1
        truth[i, domains.index(r["_q_label"])] = 1
    found = _softmax_regression(design, truth)
    return Classifier(domains, tuple(found[-1].tolist()), {w: tuple(found[i].tolist()) for w, i in place.items()})


def _softmax_regression(design: np.ndarray, truth: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights (one row a column of design) by accelerated gradient steps on the mean likelihood."""
    weights = ahead = np.zeros((design.shape[1], truth.shape[1]))
    bound = np.linalg.norm(design, 2) ** 2 / (2 * len(design)) + ridge
    for i in range(rounds):
        scores = design @ ahead
        scores = np.exp(scores - scores.max(1, keepdims=True))
        scores /= scores.sum(1, keepdims=True)
        stepped = ahead - (design.T @ (scores - truth) / len(design) + ridge * ahead) / bound
        ahead = stepped + i / (i + 3) * (stepped - weights)
        weights = stepped
    return weights


def _posteriors(rows: DataFrame, classifier: Classifier, *kept: str) -> DataFrame:
    """The kept columns of rows with text, n_tokens and the posteriors p_0, p_1, ..."""
    k = range(len(classifier.domains))
    scored = _with_evidence(rows).select(*kept, F.size("_m_words").cast("bigint").alias("n_tokens"), classifier.scores(F.col("_m_unique"), F.col("_m_shapes")).alias("_m_scores"))
    normal = scored.select(*kept, "n_tokens", F.array_max("_m_scores").alias("_m_top"), *(F.col("_m_scores")[i].alias(f"s_{i}") for i in k))
    raised = normal.select(*kept, "n_tokens", *(F.exp(F.col(f"s_{i}") - F.col("_m_top")).alias(f"e_{i}") for i in k))
    total = reduce(add, (F.col(f"e_{i}") for i in k))
    return raised.select(*kept, "n_tokens", *((F.col(f"e_{i}") / total).alias(f"p_{i}") for i in k))


def memberships(docs: DataFrame, classifier: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, p_0, p_1, ...): a text's words and its domain posteriors, one narrow pass."""
    rows = docs.select(docs[id_column].alias("_m_id"), docs[text_column].alias("text"))
    return _posteriors(rows, classifier, "_m_id").withColumnRenamed("_m_id", id_column)


@dataclass(frozen=True)
class Rates:
    """A document's rate is 1 less its posteriors' sum weighted by prices, 0 at least; shares are the totals it reaches."""

    prices: tuple[float, ...]
    shares: tuple[float, ...]
    rounds: int

    def column(self) -> Column:
        """The rate as an expression of p_0, p_1, ..."""
        return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(add, (F.col(f"p_{i}") * price for i, price in enumerate(self.prices))))

    @property
    def largest(self) -> float:
        """No document's rate is larger, as posteriors add up to 1."""
        return max(0.0, 1.0 - min(self.prices))


def wanted_totals(present: list[float], targets: list[float], anchor: int | None = None) -> list[float]:
    """Targets as totals, where present are the domains' shares of all tokens.

    They are shares of as many tokens as there are, or, with an anchor, of as many as leave that domain's
    total as it is. A domain without tokens can't be raised: its target goes to the others in proportion.
    """
    wanted = [t if a > 0 else 0.0 for t, a in zip(targets, present, strict=True)]
    whole = wanted[anchor] / present[anchor] if anchor is not None and wanted[anchor] > 0 else sum(wanted) or 1.0
    return [t / whole for t in wanted]


def fit_rates(members: DataFrame, targets: list[float], anchor: int | None = None, ridge: float = RIDGE, most_rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> Rates:
    """Nonnegative document rates whose expected domain totals match the targets (see wanted_totals).

    Minimises sum_c ((S_c - t_c)^2 / a_c) / 2 + ridge/2 * sum_d w_d (r_d - 1)^2 over r >= 0, where w_d is the
    document's share of tokens, S_c = sum_d w_d r_d p_dc and a_c is S_c at rate 1, by projected gradient with
    lazy projection: the steps add up before they are projected on r >= 0. In the metric of w a step is a
    combination of the document's posteriors, so all steps so far are one price a domain, and neither the plan nor
    what the driver holds grows with the rounds. Each round is one aggregation of one row: the totals, and
    the second moments of the documents with a positive rate, by which the step is scaled. Rounds end when no
    price moves by more than tolerance; from round 20 on steps are halved, which ends cycles.
    """
    k = len(targets)
    p = [F.col(f"p_{i}") for i in range(k)]
    n = F.col("n_tokens").cast("double")
    base = members.agg(F.sum(n).alias("n"), *(F.sum(n * p[i]).alias(f"t{i}") for i in range(k))).first()
    tokens = base["n"] or 0.0
    rates = Rates((0.0,) * k, (0.0,) * k, 0)
    if not tokens:
        return rates
    present = np.array([base[f"t{i}"] / tokens for i in range(k)])
    wanted = np.array(wanted_totals(present.tolist(), targets, anchor))
    scale = np.where(present > 0, 1 / np.maximum(present, 1e-300), 0.0)
    for done in range(1, most_rounds + 1):
        rate = rates.column()
        moments = [F.sum(F.when(rate > 0, n * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = members.agg(*(F.sum(n * rate * p[i]).alias(f"t{i}") for i in range(k)), *moments).first()
        shares = np.array([row[f"t{i}"] / tokens for i in range(k)])
        moment = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] / tokens for j in range(k)] for i in range(k)])
        prices = np.array(rates.prices)
        gradient = ridge * prices - scale * (shares - wanted)
        step = np.linalg.solve(ridge * np.eye(k) + scale[:, None] * moment, gradient)
        rates = Rates(tuple((prices - (0.5 if done >= 20 else 1.0) * step).tolist()), tuple(shares.tolist()), done)
        if np.abs(step).max() <= tolerance:
            break
    return rates


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_column: str = "doc_id", text_column: str = "text", training_rows: int = TRAINING_ROWS, anchor: str | None = None) -> DataFrame:
    """Per document: id, n_tokens, domain (most likely), p_<domain>..., rate, copies.

    copies is rate rounded down or up at random in proportion (by a hash of id), so that copies follow
    the rate in expectation. Null or empty texts have 0 tokens and the prior's posteriors; rows with a null
    or repeated id are each weighed (equal id and text give equal results); an empty table gives no rows;
    a domain that targets don't name gets 0. With an anchor, that domain's total stays (see wanted_totals).
    """
    classifier = fit_classifier(docs, labels, id_column, text_column, training_rows)
    members = staged(memberships(docs, classifier, id_column, text_column))
    rate = _fitted(members, classifier, targets, anchor).column()
    k = len(classifier.domains)
    top = F.greatest(*(F.col(f"p_{i}") for i in range(k))) if k > 1 else F.col("p_0")
    domain = reduce(lambda found, i: found.when(F.col(f"p_{i}") == top, classifier.domains[i]), range(1, k), F.when(F.col("p_0") == top, classifier.domains[0]))
    out = members.select(id_column, "n_tokens", domain.alias("domain"), *(F.round(f"p_{i}", 9).alias(f"p_{d}") for i, d in enumerate(classifier.domains)), F.round(rate, 6).alias("rate"))
    return out.withColumn("copies", F.floor(F.col("rate") + _chance(F.col(id_column))))


def _chance(id_: Column) -> Column:
    """A number from 0 to 1 by a hash of the id."""
    return F.pmod(F.xxhash64(id_, F.lit(2)), F.lit(1 << 30)) / float(1 << 30)


def _fitted(members: DataFrame, classifier: Classifier, targets: dict[str, float], anchor: str | None) -> Rates:
    wanted = [float(targets.get(d, 0.0)) for d in classifier.domains]
    if not sum(wanted):
        wanted = [1.0] * len(wanted)
    return fit_rates(members, wanted, classifier.domains.index(anchor) if anchor in classifier.domains else None)


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """docs thinned to the targets: the same columns, each row at most once.

    A row stays with its rate, as a share of the largest rate that there can be, as the chance (by a hash of
    doc_id). So nothing is repeated, and the domains' expected tokens stand in the targets' proportions exactly
    as after op2's copies; a document that is surely of the scarcest domain stays for certain. Rates are fitted with
    the anchor's total kept, so that its documents have rates near the largest.

    Null and empty texts have no tokens and the prior's posteriors, and are thinned by these; rows that share an id
    and text stay or go together, and rows with a null id are judged by their text; an empty table gives no rows; without
    usable labels, or targets for the labels' domains, all rows stay. Other columns pass through, whatever their
    names. Rates come from memberships, which are written once; the final pass weighs each row by its own
    text, so no join of texts is needed.
    """
    classifier = fit_classifier(docs, labels, training_rows=training_rows)
    if not any(targets.get(d) for d in classifier.domains):
        return docs
    rates = _fitted(staged(memberships(docs, classifier)), classifier, targets, anchor)
    whole = docs.select(F.struct("*").alias("_m_row"), F.col("doc_id").alias("_m_id"), F.col("text"))
    weighed = _posteriors(whole, classifier, "_m_row", "_m_id").withColumn("_m_at", F.monotonically_increasing_id()).withColumn("_m_rate", rates.column())
    # _m_at isn't deterministic to the optimizer, so the filter stays above the projection of the posteriors.
    return weighed.where((F.col("_m_at") >= 0) & (F.col("_m_rate") >= rates.largest * _chance(F.col("_m_id")))).select("_m_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_documents(spark, sf_dir), domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
