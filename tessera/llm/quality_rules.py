"""Operator 10, quality rules: learned decision lists as ordered Spark conditional expressions.

Everything here is DataFrame and SQL functions; the driver only sees the bounded table of training cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, read_documents, staged, words_column

#: Rows of the labelled table that the fit takes, about; the whole texts of these are read.
TRAINING_ROWS = 6000
THRESHOLDS = 12
WINDOW = 5
PLACE_BITS = 24
# Fixed value: the symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"


def _window_codes(words: Column) -> Column:
    """Sorted codes of a text's 5-word windows: the hash's low bits above, the window's place below."""
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    codes = F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.slice(words, i, WINDOW)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    return F.when(F.size(words) > WINDOW, F.sort_array(codes))


def _close(codes: Column) -> Column:
    """Places of the windows whose hash agrees with a neighbour's in sorted order; no repeated window is missed."""
    above = lambda x: F.shiftright(x, PLACE_BITS)
    close = F.filter(codes, lambda x, j: (above(x) == above(F.get(codes, j + 1))) | (above(x) == above(F.get(codes, j - 1))))
    return F.transform(close, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))


def _ranked(words: Column, close: Column) -> Column:
    """The windows at these places as strings (words hold no blank) with their places, sorted.

    Texts of more than 2^24 words take all their windows.
    """
    places = F.when(F.size(words) < 1 << PLACE_BITS, close).otherwise(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)))
    return F.when(F.size(close) > 0, F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))))


def _repeat_words(ranked: Column) -> Column:
    """Words that the windows found twice or more cover: neighbouring places tell how many words each adds."""
    none = F.array().cast("array<int>")
    same = F.zip_with(F.slice(ranked, 2, F.size(ranked)), ranked, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none))
    found = F.sort_array(F.array_distinct(F.flatten(same)))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).cast("int").alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )
    return F.when(ranked.isNull(), F.lit(0).cast("bigint")).otherwise(covered)


def count_of(text: Column, characters: str) -> Column:
    """How often these ASCII characters stand in a text (replace works on bytes; translate goes by character)."""
    return reduce(add, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters))


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else features use (named _q_*).

    Each intermediate array is a projection of its own, so that none is computed twice.
    """
    text, words = F.col("_q_text"), F.col("_q_words")
    out = docs.withColumn("_q_text", F.coalesce(docs[text_column], F.lit("")))
    out = out.withColumn("_q_words", words_column(text))
    out = out.withColumns({"_q_codes": _window_codes(words), "_q_unique": F.array_distinct(words), "_q_split": F.split(text, "\n")})
    out = out.withColumns({"_q_close": _close(F.col("_q_codes")), "_q_lines": F.when(F.size("_q_split") > 1, F.filter("_q_split", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))})
    out = out.withColumn("_q_ranked", _ranked(words, F.col("_q_close")))
    columns = {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": count_of(text, SYMBOLS).cast("bigint"),
        "n_dup_lines": F.coalesce(F.size("_q_lines") - F.size(F.array_distinct("_q_lines")), F.lit(0)).cast("bigint"),
        "n_repeat_words": _repeat_words(F.col("_q_ranked")),
        "_q_calls": count_of(text, "!?").cast("bigint"),
        "_q_n_unique": F.size("_q_unique").cast("bigint"),
        "_q_n_high": F.size(F.filter("_q_unique", lambda w: w < "a")).cast("bigint"),
        "_q_n_lines": F.size("_q_split").cast("bigint"),
        # Not deterministic to the optimizer: a filter on the verdict stays above this projection instead of
        # computing all the arrays again for each time that it names them.
        "_q_row": F.monotonically_increasing_id(),
    }
    return out.withColumns(columns)


def feature_columns() -> dict[str, Column]:
    """The features of the learned rules, from with_statistics' columns; all finite."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "symbol_share": F.col("n_symbols") / words,
        "call_share": F.col("_q_calls") / words,
        "high_word_share": F.col("_q_n_high") / F.greatest(F.col("_q_n_unique"), F.lit(1)).cast("double"),
        "word_length": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.col("_q_n_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("_q_n_unique") / words,
    }


def base_failed() -> Column:
    """The contract's base verdict, on with_statistics' columns."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature > threshold (above) or feature <= threshold."""

    feature: str
    threshold: float
    above: bool

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """If all conditions hold, the verdict (reject) stands; precision and support are the pruning set's."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def __str__(self) -> str:
        return f"IF {' AND '.join(map(str, self.conditions))} THEN reject (precision {self.precision:.3f}, {self.support} rows)"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that none covers is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def rejected_by(self, features: dict[str, Column]) -> Column:
        """Number of the first rule that covers a document, from 1; null where none does. One CASE expression."""
        found = None
        for i, rule in enumerate(self.rules, 1):
            covers = reduce(and_, (c.column(features) for c in rule.conditions))
            found = F.when(covers, F.lit(i)) if found is None else found.when(covers, F.lit(i))
        return F.lit(None).cast("int") if found is None else found

    def __str__(self) -> str:
        return "\n".join(map(str, self.rules)) + "\nELSE keep"


@dataclass
class Cells:
    """Counts of bad and good rows by combination of feature values; holds[i, j]: candidate j holds in cell i."""

    holds: np.ndarray
    bad: np.ndarray
    good: np.ndarray

    def where(self, kept: np.ndarray) -> Cells:
        return Cells(self.holds[kept], self.bad[kept], self.good[kept])

    def covered(self, rule: tuple[int, ...]) -> np.ndarray:
        return self.holds[:, list(rule)].all(1)

    def tally(self, rule: tuple[int, ...]) -> tuple[int, int]:
        inside = self.covered(rule)
        return int(self.bad[inside].sum()), int(self.good[inside].sum())


def _grow(cells: Cells, most: int = 4) -> tuple[int, ...]:
    """Add the candidate with the largest information gain until no good row is covered or nothing gains."""
    rule: tuple[int, ...] = ()
    while len(rule) < most:
        total_bad, total_good = cells.bad.sum(), cells.good.sum()
        if not total_bad or not total_good:
            break
        bad, good = cells.bad @ cells.holds, cells.good @ cells.holds
        some = bad > 0
        gain = np.zeros(len(bad))
        gain[some] = bad[some] * (np.log2(bad[some] / (bad[some] + good[some])) - np.log2(total_bad / (total_bad + total_good)))
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        rule = (*rule, best)
        cells = cells.where(cells.holds[:, best])
    return rule


def _prune(cells: Cells, rule: tuple[int, ...]) -> tuple[int, ...]:
    """Drop final conditions while (bad - good) / (bad + good) on the pruning rows doesn't fall."""

    def worth(r: tuple[int, ...]) -> float:
        bad, good = cells.tally(r)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def sequential_covering(grow: Cells, prune: Cells, candidates: list[Condition], least_precision: float = 0.98, least_rows: int = 10, most_rules: int = 12) -> DecisionList:
    """Learn reject rules one after another, each on the rows that the rules before it leave."""
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rule = _prune(prune, _grow(grow))
        if not rule:
            break
        bad, good = (x + y for x, y in zip(grow.tally(rule), prune.tally(rule), strict=True))
        if bad < least_rows or bad / (bad + good) < least_precision:
            break
        rules.append(Rule(tuple(candidates[i] for i in rule), bad / (bad + good), bad + good))
        grow, prune = grow.where(~grow.covered(rule)), prune.where(~prune.covered(rule))
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", training_rows: int = TRAINING_ROWS) -> DecisionList:
    """Learn a decision list from a sample of about training_rows labelled documents (chosen by a hash of the id).

    Thresholds are quantiles of each feature in the sample; the sample is reduced to cells (one for each
    combination of threshold intervals) by one aggregation, and covering works on the cells' counts. Labels
    other than 0 and 1, null ids and ids without a text are left out; of an id's contradictory labels the
    lowest counts. Without usable labels the list is empty and keeps everything.
    """
    usable = labels.where(labels[label_column].isin(0, 1)).select(labels[id_column].alias("_q_id"), labels[label_column].alias("_q_label"))
    rows = labelled_sample(docs, usable, training_rows, id_column, text_column)
    if rows is None:
        return DecisionList()
    features = feature_columns()
    measured = with_statistics(rows).select("_q_id", "_q_label", *(c.alias(n) for n, c in features.items()))
    quantiles = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)] + [0.95, 0.98, 0.99]
    measured = staged(measured)
    bad = measured.where("_q_label = 0")
    cuts = {n: set() for n in features}
    for part in (measured, bad):
        row = part.agg(*(F.percentile_approx(n, quantiles, 1000).alias(n) for n in features)).first()
        for n in features:
            cuts[n].update(row[n] or [])
    names = list(features)
    bins = {n: sorted(cuts[n]) for n in names}
    # Bin b means: above the first b thresholds. The cell's value stands for its interval.
    binned = [reduce(lambda a, t: a + t, [(F.col(n) > t).cast("int") for t in bins[n]], F.lit(0)).alias(n) for n in names]
    half = F.pmod(F.xxhash64("_q_id", F.lit(1)), F.lit(3)) == 0
    cells = measured.select(half.alias("prune"), "_q_label", *binned).groupBy("prune", *names).agg(F.sum((F.col("_q_label") == 0).cast("int")).alias("bad"), F.sum((F.col("_q_label") == 1).cast("int")).alias("good"))
    candidates = [(n, i, above) for n in names for i in range(len(bins[n])) for above in (True, False)]
    found = cells.orderBy("prune", *names).collect()
    place = np.array([[r[n] for n in names] for r in found], np.int64).reshape(len(found), len(names))
    # Above threshold i of a feature: in a bin beyond i.
    holds = np.stack([(place[:, names.index(n)] > i) == above for n, i, above in candidates], 1) if candidates else np.zeros((len(found), 0), bool)
    counts = np.array([[r["bad"], r["good"]] for r in found], np.int64).reshape(len(found), 2)
    every = Cells(holds, counts[:, 0], counts[:, 1])
    pruning = np.array([r["prune"] for r in found], bool)
    return sequential_covering(every.where(~pruning), every.where(pruning), [Condition(n, bins[n][i], above) for n, i, above in candidates])


def judged(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (which learned rule rejects) and kept.

    Null texts count as empty and fail the base rule. Every row is judged for itself, in one narrow pass.
    """
    found = with_statistics(docs, text_column)
    found = found.withColumn("base_failed", base_failed())
    found = found.withColumn("rule", F.when(~F.col("base_failed"), rules.rejected_by(feature_columns())))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """The rows that neither the base rules nor the learned ones reject, with their own columns.

    Null and empty texts fail the base rule and go; repeated rows and rows that share an id are each judged, and stay
    or go together; an empty table gives no rows. Other columns pass through unread, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("_q_whole"), docs[text_column].alias("text"))
    return judged(rows, rules, "text").where(F.col("kept") & (F.col("_q_row") >= 0)).select("_q_whole.*")


def quality(docs: DataFrame, rules: DecisionList, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    rows = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text"))
    return judged(rows, rules, "text").select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
