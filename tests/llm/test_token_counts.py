import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlog.llm import token_counts
from tests.llm.helpers import docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.Counter(PATH, public_tokenizers.PATTERN)
ODD = ["", " ", "\n", " \n", "  a  b ", "x   y\n \nz  \n", "a\x00b \x00c", "it's we'll 'x ''s", "<|endoftext|>", "a<|endoftext|> b", "日本語 ½ ²", "é x y", "\x1c \x85", "aaaa " * 50, "z" * 3000, "😀😀 a"]


def want(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_count_like_the_library():
    assert COUNTER.count(ODD) == want(ODD)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c\n\t'sé½1.日  ")), max_size=40))
def test_any_text_counts_like_the_library(t):
    assert COUNTER.count([t]) == want([t])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    c = token_counts.Counter(PATH, public_tokenizers.PATTERN)
    texts = [prose(i, 15) for i in range(20)]
    assert c.count(texts) == want(texts) and c.count(texts[:3]) == want(texts[:3])


def test_rows_and_limits(spark):
    texts = [None, "", "é", prose(1, 2000)]
    got = token_counts.token_counts(docs(spark, texts).selectExpr("*", "1 AS N_Tokens"), PATH).orderBy("doc_id").collect()
    assert [r.n_bytes for r in got] == [0, 0, 2, len(texts[3])]
    assert [r.n_tokens for r in got] == [0, 0, *want(texts[2:])] and [r.over_limit for r in got] == [False, False, False, True]
    assert token_counts.token_counts(docs(spark, []), PATH).count() == 0


def test_long_pre_tokens_count_like_the_library():
    import random
    import time

    r = random.Random(4)
    letters = lambda n, k="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(k) for _ in range(n))
    texts = [letters(n) for n in (256, 257, 300, 5000)] + ["a" * 3001, "ab" * 700, "tion" * 900 + " " + "é" * 400 + "\n" + "=" * 2000, letters(2000, "aab") + " " + letters(900, "日本語")]
    assert COUNTER.count(texts) == want(texts)
    start = time.perf_counter()
    assert COUNTER.count(["x" + letters(10**6)])[0] > 10**5 and time.perf_counter() - start < 10


def test_repeated_rows_are_counted_each(spark):
    d = docs(spark, [prose(1, 50), "x"])
    got = token_counts.token_counts(d.unionByName(d), PATH).collect()
    assert sorted(r.n_tokens for r in got) == sorted(want([prose(1, 50), "x"]) * 2)
