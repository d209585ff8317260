import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import tokens

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
WHOLE = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def same(f, text):
    got = np.frombuffer(tokens.encoder(f).ids(text), "<u4").tolist()
    assert got == WHOLE[f].encode(text, add_special_tokens=False).ids, (f, text)


@pytest.mark.parametrize("f", FILES)
def test_documents(f, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts[:60]:
        same(f, t)


@pytest.mark.parametrize("f", FILES)
def test_odd_texts(f):
    for t in ("", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "\n a", "a \n b", "a\tb\r\nc", "it's we'll 'S", "ÉTÉ İstanbul ΣΑΣ ß ſ K", "é ́x", "日本 語", "a b  c", "x y", "\x1c a\x1fb", "🙂 🙂", "<|endoftext|> <|startoftext|>", "1234 12.5%", "a\x85b \x85 c", "  lead", "tail\n", "\nX\nY"):
        same(f, t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbé́Σ 1.,'s\n\t \x85\x1c日ǅ"), max_size=24))
def test_any_text(text):
    for f in FILES:
        same(f, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*SPECIAL, *(s.upper() for s in SPECIAL), SPECIAL[1][:-1], "<|", "|>", " ", "\n", "a", "Word", "1", "é", "日", ".", "'s"]), max_size=9))
def test_strings_of_added_tokens(parts):
    """At starts, ends, next to one another and across cuts they get their own ids, as in the library."""
    for f in FILES:
        same(f, "".join(parts))


def test_added_tokens_have_their_ids():
    assert np.frombuffer(tokens.encoder(FILES[0]).ids("hello <|startoftext|> world"), "<u4").tolist() == [3306, 49406, 1002]
    assert 50256 in np.frombuffer(tokens.encoder(FILES[1]).ids("a <|endoftext|> b"), "<u4")


def test_other_settings_take_the_whole_pipeline(tmp_path):
    from tokenizers import normalizers, pre_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    t.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(path := str(tmp_path / "other.json"))
    for text in ("Été à la plage", " A  b\nC", "x"):
        assert np.frombuffer(tokens.encoder(path).ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 50)
    e = tokens.Encoder(public_tokenizers.path(FILES[1]))
    rng = random.Random(1)
    for _ in range(40):
        t = " ".join(str(rng.random()) for _ in range(20))
        assert np.frombuffer(e.ids(t), "<u4").tolist() == WHOLE[FILES[1]].encode(t, add_special_tokens=False).ids
        assert len(e) <= 50 + 21
