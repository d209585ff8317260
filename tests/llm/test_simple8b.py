import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import simple8b


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**32 - 1), st.sampled_from([simple8b.ESCAPE - 1, simple8b.ESCAPE, simple8b.ESCAPE + 1])), max_size=400))
def test_block_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, escapes = simple8b.encode_block(a)
    assert simple8b.decode_block(words, escapes, len(a)).tolist() == ids
    assert len(words) <= len(ids)


def test_words_are_dense():
    assert len(simple8b.encode_block(np.zeros(600, np.uint64))[0]) == 10
    assert len(simple8b.encode_block(np.full(600, 30000, np.uint64))[0]) == 150


def test_file_and_random_access(monkeypatch):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50000, 3 * simple8b.BLOCK + 17).astype(np.uint64)
    ids[::1000] = 2**31
    content = simple8b.to_bytes([5, None], [len(ids) - 3, 3], ids)
    r = simple8b.Reader(content)
    assert r.doc_ids == [5, None] and r.lengths.tolist() == [len(ids) - 3, 3]
    for start, n in ((0, len(ids)), (simple8b.BLOCK - 1, 2), (len(ids) - 3, 3), (70000, 0)):
        assert (r.ids(start, n) == ids[start : start + n]).all()
    with pytest.raises(ValueError):
        simple8b.Reader(b"x" * 100)


def test_documents(spark):
    texts = ["", None, "One two", "a b c " * 500, "Ünïcode 日本", "same", "same"]
    rows = [(i * 7 % 50, t, 1) for i, t in enumerate(texts * 9)] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    got = simple8b.read_ids(simple8b.write_ids(df, "word_bpe_49k.json", 1, ids_per_file=300)).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    key = lambda x: (x[0] is not None, x[0] or 0)
    want = sorted(((d, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, _ in rows), key=lambda x: (key(x), x[1]))
    mine = sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got), key=lambda x: (key(x), x[1]))
    assert mine == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [key((r.doc_id,)) for r in ordered] == sorted(key((r.doc_id,)) for r in got)
    assert [r.start for r in ordered] == list(np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1])
    assert zlib.crc32(b"") == 0
    assert simple8b.read_ids(simple8b.write_ids(df.limit(0), "word_bpe_49k.json", 1)).count() == 0
