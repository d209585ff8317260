import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import packing
from marlstone.llm.packing import Limits, Packer, Piece


def run(sizes, limits, cut):
    p = Packer(limits, cut=cut, most=20)
    out = []
    for i, (n, loss) in enumerate(sizes):
        out += [(q.row, q.start, q.tokens, q.loss, s, o) for q, s, o in p.add(Piece(i, 0, n, loss))]
    return out + [(q.row, q.start, q.tokens, q.loss, s, o) for q, s, o in p.finish()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 5), st.booleans())
def test_limits_and_cover(lengths, segments, cut):
    rng = random.Random(len(lengths))
    sizes = [(n, n - 1 if cut else rng.randrange(n + 1)) for n in lengths]
    limits = Limits(100, segments, 60)
    placed = run(sizes, limits, cut)
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for row, start, n, loss, s, o in placed:
        by_row[row].append((start, n))
        by_seq[s].append((o, n, loss))
    for i, (n, loss) in enumerate(sizes):
        at = 0
        for start, k in sorted(by_row[i]):
            assert start == at
            at += k
        assert at == n and (cut or len(by_row[i]) == 1)
    for own in by_seq.values():
        at = 0
        for o, n, _ in sorted(own):
            assert o == at
            at += n
        if len(own) > 1 or cut:
            assert at <= 100 and len(own) <= segments and sum(x[2] for x in own) <= 60


def test_little_padding_when_cut():
    rng = random.Random(4)
    placed = run([(n, n - 1) for n in (rng.randrange(1, 3000) for _ in range(500))], Limits(), True)
    used = defaultdict(int)
    for _, _, n, _, s, _ in placed:
        used[s] += n
    assert sum(v < 1024 for v in used.values()) <= 1


def test_documents_round_trip(spark):
    texts = ["", None, "one", "a b c " * 900, "Ünïcode text 日本", "x", "x"] * 9
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start long")
    rows = packing.pack_documents(df, "byte_bpe_50k.json", 0).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and all(r.doc_tokens == len(ids) for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) <= 1024
    assert packing.pack_documents(df.limit(0), "byte_bpe_50k.json", 0).count() == 0


def test_examples_keep_their_columns(spark):
    df = spark.createDataFrame([(i, 100 + i, 50, f"t{i}", -1) for i in range(40)] + [(99, 5000, 1, "big", -1), (98, None, None, None, -1)], "id long, n int, l int, offset_note string, offset long")
    rows = packing.pack_examples(df, "n", "l", Limits(1024, 8, 300)).collect()
    assert sorted(r.id for r in rows) == sorted([*range(40), 99, 98])
    for s in {r.sequence_id for r in rows}:
        own = [r for r in rows if r.sequence_id == s]
        assert len(own) <= 8 and (own[0].id == 99 or sum(r.n or 0 for r in own) <= 1024 and sum(r.l or 0 for r in own) <= 300)


def fill(sizes, limits=Limits(1024, 1024, 1024)):
    p = Packer(limits, cut=True)
    placed = [x for i, n in enumerate(sizes) for x in p.add(Piece(i, 0, n, n - 1))] + [*p.finish()]
    assert sum(q.tokens for q, _, _ in placed) == sum(sizes)
    return sum(sizes) / (1024 * len({s for _, s, _ in placed}))


def test_short_documents_fill_sequences():
    rng = random.Random(6)
    assert fill([rng.randint(1, 12) for _ in range(40_000)]) > 0.99
    assert fill([3] * 40_000) > 0.99 and fill([1] * 120_000) > 0.99
    assert fill([rng.choice([1, 1, 1, 700]) for _ in range(20_000)]) > 0.99


def test_short_texts_fill_sequences(spark):
    from marlstone.llm.queries import packed

    for text in (None, "", "one two"):
        df = spark.range(30_000).selectExpr("id AS doc_id", f"CAST({'NULL' if text is None else repr(text)} AS string) AS text").coalesce(1)
        rows = packed(df).select("sequence_id", "length").collect()
        assert sum(r.length for r in rows) > 0.95 * 1024 * len({r.sequence_id for r in rows})
        assert sum(r.length for r in rows) / 1024 > len({r.sequence_id for r in rows}) - 1
