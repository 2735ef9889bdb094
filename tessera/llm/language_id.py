"""Operator 7, language ID: a linear-chain conditional random field that labels words of code-switched text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, read_documents, slices

FEATURE_BITS = 17
#: Labelled texts of each language that the fit takes, about (twice as many at most), and runs of words that it sees,
#: about, counting repeats in later rounds; every run is seen MOST_ROUNDS times at most and LEAST_ROUNDS at least.
TRAINING_ROWS, TRAINING_RUNS, LEAST_ROUNDS, MOST_ROUNDS = 400, 150_000, 3, 12
#: Words of a chain that are stepped through one by one; longer chains are solved by pieces, with the same result.
PIECE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words and the word that each belongs to.

    Features: character n-grams of 1 to 3 (with marks for the word's ends, so those at an end are affixes),
    affixes of 4, and the whole word as its lexicon entry. Empty words have none.
    """
    marked = [f"\x02{w}\x03" for w in words if w]
    index = np.array([i for i, w in enumerate(words) if w], np.int64)
    if not marked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(marked)), sizes)
    end_of = ends[word]
    place = np.arange(len(letters))
    codes, owners = [], []
    with np.errstate(over="ignore"):
        grown = np.zeros(len(letters), np.uint64)
        for n in (1, 2, 3, 4):
            usable = place[place + n <= end_of]
            grown[usable] = grown[usable] * np.uint64(1_000_003) + letters[usable + n - 1] + np.uint64(n)
            if n == 4:  # only affixes
                usable = usable[(usable == starts[word[usable]]) | (usable + n == end_of[usable])]
            codes.append(_mix(grown[usable]))
            owners.append(word[usable])
        power = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
        whole = np.add.reduceat(letters * power[place - starts[word]], starts)
        codes.append(_mix(whole ^ np.uint64(0x5851F42D4C957F2D)))
        owners.append(np.arange(len(marked)))
    return (np.concatenate(codes) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), index[np.concatenate(owners)]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Label scores of each word: the sum of its features' weights."""
    features, owner = word_features(words)
    return np.stack([np.bincount(owner, weights[features, k], len(words)) for k in range(weights.shape[1])], 1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of each word, expected transitions and each sequence's log partition.

    scores holds the words of all sequences one after another. All sequences advance together, longest
    first, so that step t touches only those that have a word t.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    labels = scores.shape[1]
    peak = scores.max(1, keepdims=True) if len(scores) else scores
    local = np.exp(scores - peak)
    step = np.exp(transitions)
    alpha, scale = np.zeros_like(local), np.ones(len(local))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    before = None
    for t in range(longest):
        at = first[: alive[t]] + t
        now = local[at] if t == 0 else (before[: alive[t]] @ step) * local[at]
        total = now.sum(1)
        now /= total[:, None]
        alpha[at], scale[at] = now, total
        before = now
    beta = np.ones_like(local)
    expected = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ step.T
        expected += alpha[at].T @ ahead
    posterior = alpha * beta
    posterior /= np.maximum(posterior.sum(1, keepdims=True), 1e-300)
    sums = np.add.reduceat(np.log(scale) + peak[:, 0], np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
    return posterior, expected * step, sums


def chain_posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Posteriors of each word, as of forward_backward, of chains of any length.

    Chains are cut into pieces. Each piece's transfer matrix tells what it makes of the state before it;
    the matrices give the exact messages into each piece from both sides, and all pieces then advance together.
    """
    labels = scores.shape[1]
    if not len(scores):
        return scores
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    pieces = -(-lengths // piece)
    chain = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(lengths) - lengths, pieces) + place * piece
    size = np.minimum(piece, np.repeat(lengths, pieces) - place * piece)
    before, after = np.ones((len(chain), labels)), np.ones((len(chain), labels))
    cut = np.flatnonzero(pieces[chain] > 1)
    if len(cut):
        transfer = np.broadcast_to(np.eye(labels), (len(cut), labels, labels)).copy()
        for t in range(int(size[cut].max())):
            live = np.flatnonzero(size[cut] > t)
            now = transfer[live] if t == 0 else transfer[live] @ step
            if t == 0:  # a chain's first word has no transition into it
                inner = place[cut[live]] > 0
                now[inner] = now[inner] @ step
            now = now * local[first[cut[live]] + t][:, None, :]
            transfer[live] = now / now.sum((1, 2), keepdims=True)
        of = np.full(len(chain), -1)
        of[cut] = np.arange(len(cut))
        for t in range(1, int(place.max()) + 1):
            at = np.flatnonzero(place == t) if t < 64 else cut[place[cut] == t]
            state = (before[at - 1][:, None, :] @ transfer[of[at - 1]])[:, 0]
            before[at] = state / state.sum(1, keepdims=True)
        for t in range(int(place.max()), 0, -1):
            at = np.flatnonzero(place == t) if t < 64 else cut[place[cut] == t]
            state = (transfer[of[at]] @ after[at][:, :, None])[:, :, 0]
            after[at - 1] = state / state.sum(1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    sizes, starts = size[order], first[order]
    inner, before, after = place[order] > 0, before[order], after[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # pieces longer than t
    alpha, beta = np.zeros_like(local), np.ones_like(local)
    for t in range(int(sizes[0])):
        n = alive[t]
        at = starts[:n] + t
        now = before[:n] @ step
        if t == 0:
            now[~inner] = 1.0
        now *= local[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = before[:n] = now
    last = starts + sizes - 1
    beta[last] = after
    for t in range(int(sizes[0]) - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        now = (local[at + 1] * beta[at + 1]) @ step.T
        beta[at] = now / now.sum(1, keepdims=True)
    posterior = alpha * beta
    return posterior / np.maximum(posterior.sum(1, keepdims=True), 1e-300)


def clean_words(words: list[str]) -> list[str]:
    """Lower-case letters of each word; empty where it has none."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in map(str.lower, words)]


def sequences(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Different words, each running word's index among them, sequence lengths and each sequence's text.

    A sequence is a line's words with a letter, however many.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    text_of_line = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    split = pc.utf8_split_whitespace(lines.flatten())
    coded = split.flatten().dictionary_encode()
    line_of_word = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = clean_words(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy(zero_copy_only=False)
    kept = np.array([bool(w) for w in words], bool)[index] if len(words) else np.zeros(0, bool)
    index, line_of_word = index[kept], line_of_word[kept]
    if not len(index):
        return words, index, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, line_of_word[1:] != line_of_word[:-1]])
    return words, index, np.diff(np.r_[starts, len(index)]), text_of_line[line_of_word[starts]]


class Model:
    """Feature weights, transitions and the labels they stand for."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: summed posteriors, words, and changes of the most likely label between words."""
        words, index, lengths, text = sequences(texts)
        sums, counts, changes = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if len(index):
            posterior = chain_posteriors(emissions(words, self.weights)[index], lengths, self.transitions)
            owner = np.repeat(text, lengths)
            counts = np.bincount(owner, minlength=len(texts)).astype(float)
            for k in range(len(self.labels)):
                sums[:, k] = np.bincount(owner, posterior[:, k], len(texts))
            best = posterior.argmax(1)
            moved = (best[1:] != best[:-1]) & (owner[1:] == owner[:-1])
            changes = np.bincount(owner[1:][moved], minlength=len(texts))
        return sums, counts, changes


def train(texts: list[str], langs: list[str], runs: int = TRAINING_RUNS, seed: int = 7) -> Model:
    """Fit the field on all runs of the labelled texts, in as many rounds as make about `runs` (see TRAINING_RUNS).

    Sequences are runs of 4 to 24 words of two or more texts put together, so that the labels change
    within them and transitions are learned. Weights start at smoothed log ratios of the features'
    counts; then Adagrad follows the likelihood's gradient (labels minus forward-backward expectations).
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    if not labels:
        return Model(["und"], np.zeros((1 << FEATURE_BITS, 1)), np.zeros((1, 1)))
    words, index, lengths, owner = sequences(pa.array(texts, pa.string()))
    of_text = np.array([labels.index(x) for x in langs], np.int64)
    weights = np.zeros((1 << FEATURE_BITS, len(labels)))
    transitions = np.zeros((len(labels), len(labels)))
    if len(labels) == 1 or not len(index):
        return Model(labels, weights, transitions)
    features, feature_word = word_features(words)
    truth = of_text[np.repeat(owner, lengths)]
    uses = np.zeros((len(words), len(labels)))
    np.add.at(uses, (index, truth), 1)
    for k in range(len(labels)):
        weights[:, k] = np.bincount(features, uses[feature_word, k], len(weights))
    totals = weights.sum(0)
    seen = weights.sum(1) > 0
    weights = np.where(seen[:, None], np.log((weights + 0.5) / (totals + 0.5 * seen.sum())), 0)
    weights = 0.3 * (weights - weights.mean(1, keepdims=True))

    # Runs of words, shuffled over the texts and joined by threes.
    cuts = np.cumsum(rng.integers(4, 25, len(index)))
    starts = np.unique(np.r_[0, cuts[cuts < len(index)], (np.cumsum(lengths) - lengths)])
    run_lengths = np.diff(np.r_[starts, len(index)])
    shuffled = np.arange(len(starts))
    rounds = max(LEAST_ROUNDS, min(MOST_ROUNDS, runs // len(starts)))
    squares, moves = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for round_ in range(rounds):
        groups = np.array_split(shuffled[rng.permutation(len(shuffled))], max(1, len(shuffled) // 1500))
        for group in groups:
            places = np.concatenate([np.arange(starts[g], starts[g] + run_lengths[g]) for g in group])
            three = np.add.reduceat(run_lengths[group], np.arange(0, len(group), 3))
            some, local_word = np.unique(index[places], return_inverse=True)
            picked = [words[i] for i in some]
            f, owner_word = word_features(picked)
            scores = np.stack([np.bincount(owner_word, weights[f, k], len(picked)) for k in range(len(labels))], 1)
            posterior, expected, _ = forward_backward(scores[local_word], three, transitions)
            wanted = truth[places]
            difference = -posterior
            difference[np.arange(len(places)), wanted] += 1
            per_word = np.stack([np.bincount(local_word, difference[:, k], len(picked)) for k in range(len(labels))], 1)
            touched, back = np.unique(f, return_inverse=True)
            gradient = np.stack([np.bincount(back, per_word[owner_word, k], len(touched)) for k in range(len(labels))], 1) / len(three)
            gradient -= 1e-4 * weights[touched]
            squares[touched] += gradient**2
            weights[touched] += 0.1 * gradient / np.sqrt(squares[touched])
            inside = np.ones(len(places), bool)
            inside[np.cumsum(three) - three] = False
            seen_moves = np.zeros_like(transitions)
            np.add.at(seen_moves, (wanted[np.flatnonzero(inside) - 1], wanted[inside]), 1)
            gradient = (seen_moves - expected) / len(three) - 1e-4 * transitions
            moves += gradient**2
            transitions += 0.1 * gradient / np.sqrt(moves)
    return Model(labels, weights.astype(np.float32), transitions)


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(id_.cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str, rows: int = TRAINING_ROWS) -> tuple[list[str], list[str]]:
    """About `rows` labelled texts of each language outside the held-out fold (2 * rows at most), chosen by a hash of text and id."""
    usable = docs.where((fold(docs[id_column]) != 2) & docs[lang_column].isNotNull() & docs[text_column].isNotNull())
    usable = usable.select(docs[text_column].alias("text"), docs[lang_column].alias("lang"), F.pmod(F.xxhash64(docs[text_column], docs[id_column]), F.lit(1 << 30)).alias("place"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("place") < int((1 << 30) * min(1.0, rows / n))))
    if not sizes:
        return [], []
    # Of each language its first rows by place; only the chosen ones go through the window.
    ranked = usable.where(chosen).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))
    found = ranked.where(F.col("rank") <= 2 * rows).orderBy("lang", "rank").collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Predict each whole text's language: id, held_out, lang_pred, score, n_words, n_switches.

    lang_pred has the largest sum of word posteriors, score is their mean; ties go to the label that sorts
    first. Texts that are null or have no letter get und, 0. Only text and lang outside the held-out fold
    (crc32 of the id modulo 4 is 2) train; a null id is never held out nor trained on. Repeated rows are
    each predicted; an empty table, or one without labels, predicts und. Other columns are not read.
    """
    model = train(*training_sample(docs, id_column, text_column, lang_column, training_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            sums, counts, changes = model.label(part.column("text"))
            best = sums.argmax(1)
            some = counts > 0
            score = np.where(some, sums[np.arange(len(best)), best] / np.maximum(counts, 1), 0.0)
            predicted = [model.labels[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(predicted, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(counts.astype(np.int64)), pa.array(changes.astype(np.int64))],
                names=[id_column, "held_out", "lang_pred", "score", "n_words", "n_switches"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), F.coalesce(fold(docs[id_column]) == 2, F.lit(False)).alias("held_out"), docs[text_column].alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double, n_words bigint, n_switches bigint")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_documents(spark, sf_dir))
