"""The registered queries on the smallest tables, against brute force by the contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import decontaminate, pii, queries, sharding
from tests.llm.test_decontaminate import brute_passages, edit
from tests.llm.test_secrets import plain_base
from tests.llm.test_secrets_windows import plain_spans

SF = "/root/testdata/sf0.001"


def rows(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(t[c] for c in columns), strict=True))


@pytest.fixture(scope="module")
def docs():
    return rows("documents", "doc_id", "text")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, docs):
    texts = {d: (t or "").encode().split() for d, t in docs}
    seen = Counter(tuple(w[p : p + 35]) for w in texts.values() for p in range(len(w) - 34))
    want = set()
    for d, w in texts.items():
        gone = {p + k for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.add((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = queries.QUERIES["op1_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_op2(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = set(), 0
    for d, t in sorted(docs):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.add((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in queries.QUERIES["op2_simple8b_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op3(spark):
    pages = rows("pages", "page_id", "html")
    first = {}
    for p, h in sorted(pages):
        first.setdefault(h or "", p)
    want = set()
    for p, h in pages:
        body = (h or "").encode()
        own = first[h or ""] == p
        want.add((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""]))
    got = queries.QUERIES["op3_warc_dictionary"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(pages)


def plain_pseudonyms(text, p):
    """Every place from left to right, every kind in its order, every form of a candidate; no regions and no walks."""
    out, at, n = [], 0, Counter()
    while at < len(text):
        for kind in pii.KINDS if not text[at].isspace() else ():
            m = pii._ONE[kind].match(text, at)
            if m and (found := pii._valid(p, m, kind, False)):
                end, new = found
                out.append(new)
                n[kind] += 1
                at = end
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out), n


def test_op4(spark, docs):
    p = pii.Feistel(queries.DEMONSTRATION_KEY)
    got = {r.doc_id: r for r in queries.QUERIES["op4_pii_pseudonyms"](spark, SF).collect()}
    planted = re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    for d, t in docs:
        assert not set(planted.findall(t)) & set(planted.findall(got[d].text))
        assert pii.pseudonymise(got[d].text, p, back=True)[0] == t
        text, n = plain_pseudonyms(t, p)
        assert (got[d].text, [got[d][f"n_{k}"] for k in pii.KINDS]) == (text, [n[k] for k in pii.KINDS])


def test_op5(spark, docs):
    def fingerprint(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in sh], np.uint64)
        return sum(1 << b for b in range(64) if len(h) and 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))

    fp = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in fp}
    moved = True
    while moved:
        moved = False
        for a in fp:
            for b in fp:
                if root[b] < root[a] and (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a], moved = root[b], True
    got = queries.QUERIES["op5_simhash_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fp[d]:016x}", root[d]) for d in fp}


def test_op7(spark, docs):
    """All passages, edited ones too, against the full table of distances over whole folded texts."""
    items = [(i, f) for i, t in rows("benchmark", "item_id", "text") if (f := decontaminate.fold(t))]
    want = set()
    for d, t in docs:
        folded = decontaminate.fold(t)
        grams = {folded[k : k + 6] for k in range(len(folded))}
        for i, f in items:
            errors = int(0.08 * len(f))
            # an edit spoils at most six of an item's six-letter pieces: too few of them, no passage
            if len(f) < 36 or sum(f[k : k + 6] in grams for k in range(len(f) - 5)) >= len(f) - 5 - 6 * errors:
                found = brute_passages(f, errors, folded) if errors else []
                want |= {(d, i, n) for *_, n in found} if errors else {(d, i, 0)} if f" {f} " in f" {folded} " else set()
    got = queries.QUERIES["op7_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and want
    texts, folded = dict(docs), dict(items)
    for r in got:
        own = decontaminate.fold(texts[r.doc_id][r.start : r.end])
        assert edit(folded[r.item_id], own) == r.distance


def test_op8(spark, docs):
    held = sharding.table_of([f"shard-{i:03}" for i in range(128)])
    got = queries.QUERIES["op8_lookup_sharding"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        slot = np.uint64(xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42)).astype(np.int64) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, f"shard-{held[slot]:03}")


def test_op9(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op9_secret_scan"](spark, SF).collect()}
    for d, t in docs:
        base = plain_base(t or "")
        n = Counter(k for *_, k in base)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == (n["assign"], n["access"], n["hex"])
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        more = [x for x in plain_spans(t or "") if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
        order = ["assign", "access", "hex", "entropy"]
        every = sorted([*base, *more], key=lambda x: (x[0], order.index(x[2])))
        assert got[d].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in every)


def packs(whole, docs, got):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, t in docs:
        ids, at = [*whole.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    short = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        short += at < 1024
    return short


def test_op10(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = queries.QUERIES["op10_vector_packing"](spark, SF)
    assert packs(whole, docs, df.collect()) <= df.rdd.getNumPartitions()


def test_pack_conversations(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(lambda: [0, 0])
    for c, role, t in rows("conversations", "conv_id", "role", "text"):
        n = len(whole.encode(t or "", add_special_tokens=False).ids) + 1
        want[c][0] += n
        want[c][1] += n * (role == "assistant")
    got = queries.QUERIES["pack_conversations"](spark, SF).collect()
    assert {r.conv_id: [r.n_tokens, r.n_loss] for r in got} == want and len(got) == len(want)
    limits = queries.CONVERSATION_LIMITS
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
        assert len(own) == 1 or at <= limits.tokens and len(own) <= limits.segments and sum(r.n_loss for r in own) <= limits.loss


def test_pipeline(spark, docs):
    """Each stage against a plain version of its decision on what it got."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    steps = [table]
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, steps[-1], SF)
        path = corpus_pipeline.stash(df)
        steps.append(path)
    raw, cleaned, unique, clean, private, packed = (x.collect() for x in steps)
    assert all(x.columns == columns for x in steps[:-1])
    judged = {r.doc_id: r for r in queries.quality.quality(table).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in cleaned} == {d: (r.cleaned, len(r.cleaned)) for d, r in judged.items() if r.kept} and len(cleaned) < len(raw)
    least = {r.doc_id for r in queries.simhash.near_duplicates(steps[1]).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in unique} == least and len(unique) == len(least) < len(cleaned)
    leaks = {r.doc_id for r in decontaminate.matches(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique} - leaks and leaks
    p = pii.Feistel(queries.DEMONSTRATION_KEY)
    assert {r.doc_id: r.text for r in private} == {r.doc_id: pii.pseudonymise(r.text, p)[0] for r in clean}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packs(whole, [(r.doc_id, r.text) for r in private], packed)
    again = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in private}
