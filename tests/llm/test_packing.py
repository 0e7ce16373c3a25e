from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelstats.llm import packing
from panelstats.llm.queries import tokenizer_path


def places(counts, plan):
    """Every piece's place, checked to be gapless and within the capacity."""
    keys = plan.length << 40 | plan.rank
    found = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            assert plan.length[at] == length
            found[int(plan.sequence[at] + rank - plan.rank[at])].append((int(plan.offset[at]), length))
    for inside in found.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return found


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 60), max_size=40))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan_packing(counts)
    assert len(places(counts, plan)) == plan.sequences


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(5)
    counts = Counter(np.clip(rng.lognormal(6, 1, 20_000), 1, 2047).astype(int).tolist())
    plan = packing.plan_packing(counts)
    assert plan.sequences <= 1.01 * sum(n * c for n, c in counts.items()) / packing.CAPACITY + 1


def test_perfect_pairs_are_found():
    assert packing.plan_packing({1500: 100, 548: 100, 1024: 50}).sequences == 125


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_the_tokenizer(tokenizer):
    odd = ["İ Å x y don't DON'T z", "İstanbul ǅ ß ﬁ ̀a", "", "日本語 12345 🙂🙂", "'s 's't a's a.'s x!!'t ab,cd..ef", "a b c\x1cd", None]
    for text, ids in zip(odd, packing.WordIds(tokenizer_path()).of(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_forgotten_and_learnt_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    cache = packing.WordIds(tokenizer_path())
    for text in ("one two three four five", "one six seven", "five one eight", "nine", "one two"):
        assert np.frombuffer(cache.of([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(cache.known) <= 10


def check_rows(rows, texts, tokenizer):
    """Pieces against the tokenizer, places against each other; ``texts`` counts (doc_id, text)."""
    want = Counter()
    for (doc_id, text), n in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want[(doc_id, i // 2048, i, len(part), zlib.crc32(part.tobytes()))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for some in inside.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048


def test_odd_rows(odd_docs, written, tokenizer):
    docs = written(odd_docs)
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    check_rows(rows, Counter((r.doc_id, r.text) for r in odd_docs.collect()), tokenizer)


def test_empty_table(odd_docs, written):
    assert packing.pack_documents(odd_docs.limit(0), tokenizer_path()).collect() == []


def test_a_length_that_most_pieces_have(spark, written, tokenizer):
    docs = written(spark.createDataFrame([(i, "the same words again") for i in range(3000)] + [(-1, "other")], "doc_id long, text string"))
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    check_rows(rows, Counter((r.doc_id, r.text) for r in docs.collect()), tokenizer)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2045)


def test_documents_and_sequences(documents, tokenizer):
    packed = packing.pack_documents(documents, tokenizer_path(), with_ids=True).cache()
    rows = packed.collect()
    check_rows(rows, Counter((r.doc_id, r.text) for r in documents.collect()), tokenizer)
    for s in packing.sequences(packed).collect():
        own = sorted((r.offset, bytes(r.ids)) for r in rows if r.sequence_id == s.sequence_id)
        assert bytes(s.ids) == b"".join(ids for _, ids in own) and len(s.ids) == 4 * s.n_tokens


def test_tokenizers_of_other_kinds(tmp_path):
    """Case that counts, white space that counts, and a byte-level vocabulary: ids are those of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 1, "hello": 2, "World": 3, "\n": 4}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    lower = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "a b": 2, " ": 3}, unk_token="[UNK]"))
    lower.normalizer = normalizers.Lowercase()
    for i, made in enumerate((cased, lower)):
        made.save(str(tmp_path / f"{i}.json"))
    texts = ["Hello World", "hello  World\nHello", "A B", "a b", "", None, "don't DON'T", "x\n\n y"]
    for path in (str(tmp_path / "0.json"), str(tmp_path / "1.json"), public_tokenizers.path("byte_bpe_50k.json")):
        whole, made = Tokenizer.from_file(path), packing.WordIds(path)
        assert not made.apart
        for text, ids in zip(texts, made.of(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert packing.WordIds(tokenizer_path()).apart


def test_contents_of_added_tokens(tokenizer):
    texts = ["a<|endoftext|>b", "A <|ENDOFTEXT|> b", "x <|startoftext|><|endoftext|>", "< | endoftext"]
    for text, ids in zip(texts, packing.WordIds(tokenizer_path()).of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_of_words_are_learnt_without_offsets(tokenizer):
    """Runs of letters, digits and marks are learnt apart, so words with other marks or digits aren't encoded again."""
    cache = packing.WordIds(tokenizer_path())
    texts = ["Élan-vital (x1) x2, don't élan!", "vital élan 2x 12 ''s a\x1cb µm ²x don'tx"]
    for text, ids in zip(texts, cache.of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert {"élan", "-", "vital", "(", "x", "1", ")", "2", "don", "'t"} <= set(cache.known)
    assert not {"élan-vital", "x1", "(x1)", "don't"} & set(cache.known)
