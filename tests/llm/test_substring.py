from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelstats.llm import substring
from panelstats.llm.text import WordHashes


def plain(rows, min_words=substring.MIN_WORDS):
    """(place, text) in order of rank -> text, offsets, words gone, one document after the other."""
    hashes, seen, out = WordHashes(), set(), {}
    for place, text in rows:
        first, n, digest = substring.units_of(text, hashes)
        repeated = []
        for d in digest.tolist():
            repeated.append(d in seen)
            seen.add(d)
        spans = [{"first": int(f), "n": int(k)} for f, k, r in zip(first, n, repeated, strict=True) if r]
        out[place] = substring.without(text, spans, min_words) if spans else (text, [], 0)
    return out


def check(docs, df, ids):
    rows = docs.rdd.zipWithIndex().map(lambda p: (p[0]["doc_id"], p[1], p[0]["text"])).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = plain([(place, text) for _, place, text in rows])
    shown = sorted((str(i), str(want[p][0]), want[p][1], want[p][2]) for i, p, _ in rows)
    got = sorted((str(r.doc_id), str(r.text), [(s.begin, s.end) for s in r.removed], r.n_removed_words) for r in df.collect())
    assert got == shown


def test_documents_against_one_pass(documents):
    check(documents, substring.deduplicate(documents), "doc_id")


def test_odd_rows(odd_docs, written):
    docs = written(odd_docs, 1)
    check(docs, substring.deduplicate(docs), "doc_id")
    kept = substring.deduplicate_rows(docs)
    assert kept.columns == [*docs.columns, "_llm_removed", "_llm_gone"]
    assert kept.select("fp", "spans", "row").distinct().count() == docs.select("fp", "spans", "row").distinct().count()


def test_empty_table(odd_docs):
    assert substring.deduplicate(odd_docs.limit(0)).collect() == []


def test_small_lots_give_the_same(documents, monkeypatch):
    want = sorted(substring.deduplicate(documents).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(substring, "LOT", 50)
    assert sorted(substring.deduplicate(documents).collect(), key=lambda r: r.doc_id) == want


def test_passage_in_the_middle_of_lines(spark, written):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(55))
    rows = [(i, f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}\nlast {i} {word()}") for i in range(8)]
    clean = [(100 + i, " ".join(word() for _ in range(200))) for i in range(5)]
    docs = written(spark.createDataFrame(rows + clean, "doc_id long, text string"))
    got = {r.doc_id: r for r in substring.deduplicate(docs).collect()}
    assert got[0].text == rows[0][1]
    for i, text in rows[1:]:
        assert 35 <= got[i].n_removed_words <= 55 and passage not in got[i].text
        (span,) = got[i].removed
        assert text[span.begin : span.end] in passage
        assert got[i].text == text[: span.begin] + text[span.end :].lstrip()
    assert all(got[i].text == t and not got[i].removed for i, t in clean)


def test_copies_keep_one_text(spark, written):
    text = " ".join(f"w{i}" for i in range(100))
    docs = written(spark.createDataFrame([(i, text if i % 2 else text.upper() + "\n") for i in range(40)], "doc_id long, text string"), 5)
    got = {r.doc_id: r.text for r in substring.deduplicate(docs).collect()}
    assert got.pop(0) and set(got.values()) == {""}


def test_spans_are_code_points():
    text = "é🙂 b c d e  f"
    cut, offsets, n = substring.without(text, [{"first": 1, "n": 2}], 2)
    assert (cut, offsets, n) == ("é🙂 e  f", [(3, 8)], 2)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=80), st.integers(0, 40))
def test_units_cover_all_words(values, at):
    h = np.array(values, np.uint64)
    ends = substring.unit_ends(h, np.array(sorted({min(at + 1, len(h)), len(h)})))
    assert ends[-1] == len(h) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= substring.MOST_WORDS


def plain_lines(rows):
    """Ids to texts without all but the first occurrence of each line, lines compared by their words."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            key = tuple(line.lower().split())
            if not key or key not in seen:
                kept.append(line.split())
            seen.add(key)
        out[i] = [line for line in kept if line]
    return out


def repeated_lines(lengths, seed):
    """Documents that share lines of given lengths between lines of their own; ids to texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in lengths]
    rows = []
    for i in range(6):
        some = rng.sample(shared, len(shared))
        rows.append((i, "\n".join(x for s in some for x in (line(rng.randint(5, 25)), s.upper() if i % 2 else f"  {s} "))))
    return rows


def test_repeated_lines_go_as_wholes(spark, written):
    """Lines of 30 words and more, their rims included, whatever lines are around them."""
    rows = repeated_lines(range(30, 61), 3)
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [x.split() for x in r.text.split("\n") if x.split()] for r in substring.deduplicate(docs).collect()}
    assert got == plain_lines(rows)


def test_neighbourhoods_end_with_the_line():
    rng = random.Random(4)
    h = np.array([rng.randrange(2**63) for _ in range(3000)], np.uint64)
    ends = np.cumsum([rng.randint(1, 40) for _ in range(70)])
    whole = substring.unit_ends(h[: ends[-1]], ends)
    alone = [a + substring.unit_ends(h[a:b], np.array([b - a])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert whole.tolist() == np.concatenate(alone).tolist()


def test_repeated_lines_go_however_short(spark, written):
    rows = repeated_lines([*range(1, 30)] * 2, 5) + [(10, "some\n\n \nSOME\nmore of some\nmore\nmore  of some"), (11, "more of some more")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [x.split() for x in r.text.split("\n") if x.split()] for r in substring.deduplicate(docs).collect()}
    assert got == plain_lines(rows)


def test_only_separators_go_with_a_run():
    """U+3000 and U+00A0 belong to words; white space after kept words stays."""
    words = [f"w{i}" for i in range(40)]
    span = {"first": 0, "n": 30}
    head, tail = " ".join(words[:30]), " ".join(words[30:])
    assert substring.without(f"{head} {tail}　", [span], 30)[0] == f"{tail}　"
    assert substring.without(f"{head} {tail}  \n", [span], 30)[0] == f"{tail}  \n"
    kept, offsets, gone = substring.without(f"x  \n {head}\n", [{"first": 1, "n": 30}], 30)
    assert kept == "x " and gone == 30 and offsets == [(5, 5 + len(head))]


def test_a_lot_is_handed_on_in_parts(spark, written, monkeypatch):
    """Units of a lot come in small batches, and repeats that meet at the end of one are known all the same."""
    rows = [(i % 5, f"same line of text\nline {i % 7} is here") for i in range(40)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    columns = ["doc_id", "first", "n", "digest", "known"]
    want = sorted(substring.find_units(substring.numbered(docs, substring.ROW)).select(*columns).collect())
    monkeypatch.setattr(substring, "PART", 3)
    assert sorted(substring.find_units(substring.numbered(docs, substring.ROW)).select(*columns).collect()) == want
    assert sum(not r.known for r in want) == len({r.digest for r in want})
