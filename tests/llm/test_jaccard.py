from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
import pytest

from panelstats.llm import jaccard


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_firsts(rows):
    """Ids of the first of each class; ids are unique."""
    sets = {i: plain_set(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and Fraction(both, max(1, len(sets[i] | sets[j]))) >= Fraction(4, 5) or sets[i] == sets[j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def near_copies(seed, groups, copies, changes=5, words=160):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        rows.append(" ".join(base))
        for _ in range(copies):
            some = list(base)
            for at in rng.sample(range(words), rng.randint(1, changes)):
                some[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(some))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("partners", [1024, 1])
def test_stage_links_at_four_fifths_of_five_word_shingles(spark, written, partners):
    """Copies with one to three changed words of 160, many of them far apart as fingerprints; few partners take rounds."""
    rows = near_copies(1, 8, 5, 3)
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"))
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "") if partners > 1 else jaccard.first_of_each(docs, partners=partners)
    kept = {r.doc_id for r in left.collect()}
    assert kept == plain_firsts(rows) and len(kept) < len(rows) // 2


def test_recall_at_the_threshold(spark, written):
    """Pairs of a similarity from 0.8 to 0.83: at least nine tenths are found; no pair under 0.8 is linked."""
    rng, rows, want = random.Random(3), [], 0
    for g in range(400):
        base = [f"w{rng.randrange(20000)}" for _ in range(200)]
        copy, at = list(base), rng.sample(range(4, 196, 9), 4 if g % 4 else 6)
        for i in at:
            copy[i] = f"x{rng.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        a, b = plain_set(rows[-2][1]), plain_set(rows[-1][1])
        share = Fraction(len(a & b), len(a | b))
        assert share < Fraction(4, 5) or Fraction(4, 5) <= share <= Fraction(83, 100)
        want += share >= Fraction(4, 5)
    kept = {r.doc_id for r in jaccard.first_of_each(written(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    gone = {i for i, _ in rows} - kept
    assert all(i % 2 and (i // 2) % 4 for i in gone)
    assert 0.9 * want <= len(gone) <= want == 300


def test_a_large_group_of_near_copies(spark, written):
    """Every copy differs from all others: one class, without a check of all pairs."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(1500)] + [(9000 + i, f"other text {i} " * 9 + str(i)) for i in range(50)]
    kept = {r.doc_id for r in jaccard.first_of_each(written(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert kept & set(range(1500)) == {0}


def test_expected_recall_and_masks():
    assert jaccard.expected_recall(12, 8) < jaccard.expected_recall(12, 40) < jaccard.expected_recall(12, 40, least=Fraction(9, 10))
    for n in (10, 10**6, 10**9):
        on = jaccard.candidate_masks(n)
        assert len({m.bit_count() for m in on}) == 1 and jaccard.expected_recall(on[0].bit_count(), len(on)) >= jaccard.RECALL


def test_odd_rows(odd_docs, written):
    docs = written(odd_docs.selectExpr("*", "doc_id as key", "text as data", "1 as mins", "2 as n", "3 as a"), 1)
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(str(i) for i, _ in texts) == ["1", "3", "6", "6", "7", "8", "None"]
    assert jaccard.first_of_each(written(odd_docs.limit(0), 1)).collect() == []


def test_fewer_than_five_words_are_one_shingle(spark, written):
    docs = written(spark.createDataFrame([(1, "a b c"), (2, "A  b\nc"), (3, "a b"), (4, "a b c d")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in jaccard.first_of_each(docs).collect()) == [1, 3, 4]


def test_copies_unlike_each_other_meet_at_their_original(spark, written):
    """Copies at 0.81 to the original are under 0.8 to each other; the original is their hub."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(20000)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(4, 196, 9), 4):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    kept = {r.doc_id for r in jaccard.first_of_each(written(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert 0 in kept and len(kept) <= 0.1 * len(rows)


def test_unlike_texts_with_near_fingerprints_are_no_candidates(spark, written):
    """Sketches of unlike texts differ in about half of their bits: only the pair with near sketches is left."""
    sketch = [sum(((i & j).bit_count() & 1) << j for j in range(63)) for i in range(60)]
    rows = [(i, 7, sketch[i], i, -1, 0) for i in range(60)]
    rows.append((60, 7, sketch[0] ^ 0b1011, 60, -1, 0))
    keys = written(spark.createDataFrame(rows, "key long, fp long, sketch long, root long, d long, last long"))
    on = jaccard.candidate_masks(len(rows))
    assert [(r.a, r.b) for r in jaccard.next_candidates(keys, on).collect()] == [(60, 0)]
    assert {r.key for r in jaccard.nearest_candidates(keys, on).collect()} == {0, 60}


def test_sketches_keep_pairs_at_the_threshold():
    assert jaccard.bits_apart() == 17 and jaccard.bits_apart(Fraction(1, 2)) > 24 and jaccard.bits_apart(Fraction(1)) == 0
