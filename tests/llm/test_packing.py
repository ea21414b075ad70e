import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlog.llm import best_fit_packing as p
from tests.llm.helpers import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", None, "A<|endoftext|> b <|startoftext|>", "İstanbul ΣΑΣ é ''s it's 'sx", "a\x1cb\x85c", "x y　z 1234 ½", "​q", prose(1, 30), prose(2, 4000), prose(3, 9000), "!!.. a,b", "é"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, capacity=4096):
    """Every piece is right, and sequences are gapless and fit."""
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert sorted(of) == list(range(len(texts)))
    for d, own in of.items():
        full = np.array([*ids(texts[d]), 1], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(full), capacity))
        for r in own:
            part = full[r.start : r.start + capacity]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(spark):
    rows = p.pack(docs(spark, TEXTS).repartition(3), PATH).collect()
    n = check(rows, TEXTS)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    assert p.pack(docs(spark, []), PATH).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    texts = [prose(1, 150_000), "x" * 20_000, prose(2, 50)]
    d = docs(spark, texts).selectExpr("*", "1 AS piece", "2 AS length", "3 AS start", "4 AS sequence_id", "5 AS offset", "6 AS part")
    rows = p.pack(d, PATH).collect()
    assert check(rows, texts) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_repeated_rows_are_packed_each(spark):
    d = docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"]))
    rows = p.pack(d, PATH).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 500), max_size=40))
def test_plans_place_every_rank_once(histogram):
    plan = p.plan_packing(histogram)
    assert dict(plan.used) == histogram
    runs = defaultdict(list)
    for x, first, ranks, *_ in plan.runs:
        runs[x].append((first, ranks))
    for x, own in runs.items():
        at = 0
        for first, ranks in sorted(own):
            assert first == at
            at += ranks
        assert at == histogram[x]


def test_plans_are_close_to_the_bound():
    r = random.Random(3)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(4096, max(1, int(r.lognormvariate(6, 1))))] += 1
    plan = p.plan_packing(dict(histogram))
    bound = -(-sum(k * v for k, v in histogram.items()) // 4096)
    assert plan.sequences <= bound * 1.003 + 1


def test_nnls_solves_exact_systems():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [3, 0, 0]])
    x = np.array([2.0, 0, 1])
    assert np.allclose(p.nnls(a, a @ x), x, atol=1e-6)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 10)
    w = p.WordIds(PATH)
    texts = [prose(i, 12) for i in range(20)]
    for _ in range(2):
        assert w.ids(texts) == [np.array(ids(t), "<u4").tobytes() for t in texts]


def test_each_pre_token_is_asked_for_and_remembered_once(monkeypatch):
    w, asked, merged = p.WordIds(PATH), [], p.WordIds.merged
    monkeypatch.setattr(p.WordIds, "merged", lambda self, parts: asked.extend(parts) or merged(self, parts))
    monkeypatch.setattr(w, "encoded", None)  # whole texts, as only rare ones need it
    texts = ["abcde abcde, (abcde) abcde's", "Abcde. 12 (É) É!", prose(1, 500), prose(1, 500) + "."]
    for _ in range(2):
        assert w.ids(texts) == [np.array(ids(t), "<u4").tobytes() for t in texts]
    assert sorted(asked) == sorted(set(asked)) == sorted(w.known)
    assert {b"abcde", b",", b"(", b")", b"'s", b".", b"1", b"2", "é".encode(), b"!"} <= w.known.keys()
    assert b"abcde," not in w.known


def test_characters_are_classed_and_lowered_as_the_library_does():
    points = {*range(0x250), *range(0x250, 0x110000, 211), 0x558, 0x180E, 0x1C89, 0x200B, 0xA7CB, 0x1E6E3, 0x32000}
    texts = [f"a{chr(c)}b {chr(c)}'s\u0334{chr(c)}1" for c in sorted(points) if not 0xD800 <= c < 0xE000]
    w = p.WordIds(PATH)
    for i in range(0, len(texts), 500):
        assert w.ids(texts[i : i + 500]) == w.encoded(texts[i : i + 500])


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("abstmdrevl'''  \n\t.,!12\x00\x1c\x85éΣσİß½٣文\u00a0\u3000\u0301\u0345\u0334🙂\u200b\u0558"), max_size=40), max_size=8),
    st.sampled_from([1, 5, 1_000_000]),
    st.sampled_from([1, 3, 20_000]),
)
def test_texts_are_cut_as_the_library_cuts_them(texts, at_once, asked):
    w = p.word_ids(PATH)
    before = p.AT_ONCE, p.ASKED
    p.AT_ONCE, p.ASKED = at_once, asked
    try:
        assert w.ids(texts) == w.encoded(texts)
    finally:
        p.AT_ONCE, p.ASKED = before
