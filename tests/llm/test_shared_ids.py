"""Different texts under one id."""

from tessera.llm import substring_dedup

SHARED = " ".join(f"s{i}" for i in range(30))
LONG = " ".join(f"l{i}" for i in range(100))


def test_different_texts_under_one_id_are_judged_each_on_its_own(spark):
    rows = [(1, f"{LONG} {SHARED}"), (2, f"{LONG} tail"), (2, "a short text of its own"), (2, " ".join(f"o{i}" for i in range(120))), (2, f"x {SHARED} y"), (2, f"x {SHARED} y")]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), keep_text=True).collect()
    want = [(1, rows[0][1]), (2, "tail"), (2, rows[2][1]), (2, rows[3][1]), (2, "x y"), (2, "x y")]
    assert sorted((r.doc_id, r.kept) for r in found) == sorted(want)


def test_a_passage_of_two_texts_under_one_id_stays_once(spark):
    rows = [(7, f"{SHARED} first"), (7, f"{SHARED} second and more")]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_text=True).collect()
    assert sorted(r.n_removed for r in found) == [0, 30]
