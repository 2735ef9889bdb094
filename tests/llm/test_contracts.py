"""Operators against brute force where the contract names a rule: peaks and pairs, chains, licences, signatures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, jaccard_join, language_id, license_scans, media, partenum, secret_scans, shingles

FOLDER = "/root/testdata/sf0.01"


# ---- media
def brute_peaks(samples):
    size, hop = media.FRAME, media.HOP
    n = 1 + max(0, -(-(len(samples) - size) // hop))
    wave = np.zeros((n - 1) * hop + size)
    wave[: len(samples)] = (samples.astype(float) - 128) / 128
    window = np.hanning(size)
    turns = np.exp(-2j * np.pi * np.outer(np.arange(size // 2), np.arange(size)) / size)
    energy = [np.abs(turns @ (wave[f * hop : f * hop + size] * window)) ** 2 for f in range(n)]
    means = [np.mean([e[low:high].mean() for e in energy]) for low, high in media.BANDS]
    return [(f, low + int(e[low:high].argmax())) for f, e in enumerate(energy) for (low, high), mean in zip(media.BANDS, means, strict=True) if e[low:high].max() > mean]


@pytest.mark.parametrize("size", [64, 256, 257, 2000, 5003])
def test_peaks_and_pairs_are_those_of_plain_sums(size):
    samples = np.random.default_rng(size).integers(32, 122, size).astype(np.uint8)
    frame, peak = media.spectral_peaks(samples)
    want = brute_peaks(samples)
    assert list(zip(frame.tolist(), peak.tolist(), strict=True)) == want
    pairs = []
    for i, (f, p) in enumerate(want):
        later = [(g, q) for g, q in want[i + 1 :] if g > f][: media.FAN_OUT]
        pairs += [(f << 32) | (p << 24) | (q << 16) | (g - f) for g, q in later if g - f <= media.ZONE]
    found = media.peak_pairs(frame, peak)
    assert found.tolist() == sorted(pairs) and ((found & 0xFFFF) > 0).all()


def test_a_shifted_passage_keeps_pairs():
    rng = np.random.default_rng(3)
    passage = rng.integers(32, 122, 6000).astype(np.uint8)
    plain = media.peak_pairs(*media.spectral_peaks(passage))
    moved = media.peak_pairs(*media.spectral_peaks(np.r_[rng.integers(32, 122, 5 * media.HOP).astype(np.uint8), passage]))
    assert len(set((plain & 0xFFFFFFFF).tolist()) & set((moved & 0xFFFFFFFF).tolist())) > 0.5 * len(set((plain & 0xFFFFFFFF).tolist()))


def test_media_query_returns_media_and_fingerprints(spark):
    for r in media.op1_media_columns(spark, "/root/testdata/sf0.001").limit(20).collect():
        payload = media.wav_samples(bytes(r.media))
        assert r.fingerprint == media.peak_pairs(*media.spectral_peaks(np.frombuffer(payload, np.uint8))).tolist()


# ---- language
@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_chains_in_pieces_are_exact(piece):
    rng = np.random.default_rng(piece)
    lengths = np.array([1, 2, 5, 64, 65, 300])
    scores, transitions = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3))
    assert np.allclose(language_id.chain_posteriors(scores, lengths, transitions, piece), language_id.forward_backward(scores, lengths, transitions)[0])


def test_texts_without_a_letter_are_undetermined(spark):
    texts = ["²½ ③", "١٢٣ 456", "_ - !", "½a", "ⅷ", "日本語"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "the river and the people", "en") for i in range(8)] + [(200 + i, "der fluss und die leute", "de") for i in range(8)]
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [found[i].lang_pred == "und" for i in range(6)] == [not any(map(str.isalpha, t)) for t in texts] and found[0].score == 0


def test_training_sample_is_bounded_by_language(spark):
    rows = [(i, "copy of one text", "aa") for i in range(500)] + [(1000 + i, f"text {i}", "zz") for i in range(500)]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", 40)
    assert 20 < langs.count("aa") <= 80 and 20 < langs.count("zz") <= 80 and len(texts) == len(langs)


# ---- licences
@pytest.fixture(scope="module")
def licences(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return license_scans.Model(license_scans.other_paragraphs(docs)), [r.text or "" for r in docs.collect()]


def test_held_out_notices_are_found_and_calibrated(licences):
    model, texts = licences
    rng = random.Random(9)
    prose = [w for t in texts[500:600] for w in t.split()[:50]]
    rows, truth = [], []
    for family, templates in license_scans.TEMPLATES.items():
        for template in templates:
            for k in range(8):
                words = template.split()
                if len(words) > 8:  # edited
                    for _ in range(rng.randrange(3)):
                        words[rng.randrange(len(words))] = rng.choice(prose)
                if k % 2 and len(words) > 5:  # wrapped
                    words.insert(rng.randrange(3, len(words) - 1), "\n#")
                around = " ".join(rng.choice(prose) for _ in range(rng.randrange(20)))
                rows.append(f"{around}\n\n{' '.join(words)}\n\n{around}")
                truth.append(family)
    found = [set() for _ in rows]
    judged = []
    for at, _, family, chance, cover in model.scan(pa.array(rows)):
        judged.append((chance, family == truth[at]))
        if chance >= 0.5 and cover >= license_scans.LEAST_COVER:
            found[at].add(family)
    right = sum(t in f for t, f in zip(truth, found, strict=True))
    assert right > 0.95 * len(rows) and sum(len(f) for f in found) - right < 0.02 * len(rows)
    assert abs(np.mean([c for c, _ in judged]) - np.mean([r for _, r in judged])) < 0.1


def test_prose_names_no_licence(licences):
    model, texts = licences
    for at, paragraph, family, chance, cover in model.scan(pa.array(texts)):
        if chance >= 0.5 and cover >= license_scans.LEAST_COVER:
            line = texts[at].split("\n")[paragraph].lower()
            assert any(mark in line for mark in ("licen", "rights reserved", "copyright", "cc by")), (family, line)


# ---- secrets
def test_battery_leaves_prose_alone(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    words = [t[a:b] for t in texts for a, b, k in secret_scans.find_secrets(t)[1] if k == "random"]
    assert not any(w.isalpha() and w.islower() for w in words) and len(words) < 0.05 * len(texts)


# ---- Jaccard join
def near_sets(seed, size, percent, share):
    rng = np.random.default_rng(seed)
    a = np.unique(shingles.mix(rng.integers(0, 2**63, size).astype(np.uint64)))
    drop = int(share * partenum.most_distance(len(a), percent))
    lost = int(rng.integers(0, drop + 1))
    b = np.sort(np.r_[rng.permutation(a)[: len(a) - lost], shingles.mix(rng.integers(0, 2**63, drop - lost).astype(np.uint64))])
    return a, b


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([70, 80, 90]), st.sampled_from([0.5, 0.9, 1.0]))
def test_no_similar_pair_is_lost(seed, size, percent, share):
    a, b = near_sets(seed, size, percent, share)
    if partenum.similar(a, b, percent):
        codes, owner = partenum.signatures_of([a, b], percent)
        assert np.intersect1d(codes[owner == 0], codes[owner == 1]).size
        assert all(partenum.sketches_allow(partenum.sketch(a, percent, f), len(a), partenum.sketch(b, percent, f), len(b), percent) for f in (1, 2, 4))


def test_sets_with_too_many_empty_pieces_still_meet():
    # Features in a small part of the domain leave nearly all pieces empty, on the first level.
    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(2**40, 300, replace=False).astype(np.uint64))
    b = np.sort(np.r_[a[:-20], rng.choice(2**40, 20).astype(np.uint64) + np.uint64(2**41)])
    codes, owner = partenum.signatures_of([a, b], 80)
    assert partenum.similar(a, b, 80) and np.intersect1d(codes[owner == 0], codes[owner == 1]).size


def test_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    base = [np.unique(shingles.mix(rng.integers(0, 2**63, 120).astype(np.uint64))) for _ in range(6)]
    sets = [np.sort(rng.permutation(base[i % 6])[: 120 - int(rng.integers(0, 12))]) for i in range(60)]
    sketches = partenum.Sketches([partenum.sketch(s, 80) for s in sets], np.array([len(s) for s in sets]), 80)
    group, side = np.arange(60), np.zeros(60, np.int64)
    every, few = partenum.block_pairs(sketches, group, side), partenum.block_pairs(sketches, group, side, 1)

    def classes(pairs):
        low = list(range(60))
        for _ in range(60):
            for i, j in zip(*pairs, strict=True):
                low[i] = low[j] = min(low[i], low[j])
        return low

    assert classes(every) == classes(few) and len(few[0]) < 60 < len(every[0])


def test_packed_entries_come_back():
    rng = np.random.default_rng(2)
    code = np.sort(rng.integers(0, 2**48, 1000).astype(np.uint64))
    doc = rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, 1000)]
    item = np.where(rng.random(1000) < 0.1, rng.integers(0, 2**63, 1000), doc).astype(np.int64).view(np.uint64)
    for got, want in zip(jaccard_join.unpack_entries(jaccard_join.pack_entries(code, doc, item)), (code, doc, item), strict=True):
        assert (got == want).all()


def test_partition_keys_reach_every_partition(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2**40, -(2**62), 12345]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(F.hash("v")).collect()] == common.spark_hash(np.array(values)).tolist()
    keys = common.partition_keys(37).tolist()
    rows = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(37, "key").select("key", F.spark_partition_id().alias("p")).collect()
    assert {r.key: r.p for r in rows} == {k: p for p, k in enumerate(keys)}


def test_lists_and_large_groups_of_near_copies(spark):
    # More near copies in each task than travel one by one, in two clusters that one common passage joins to others' buckets.
    rng = random.Random(4)
    base = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    rows = []
    for i in range(400):
        w = list(base[i % 2])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), 3, 80).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if low[i] != low[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    assert found == low
