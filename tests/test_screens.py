"""Term screens against patterns, over all documents."""

import re

import pytest
from pyspark.sql import Row

from marlstone.operators import screens
from marlstone.plans.screens import benchmark_terms
from marlstone.storage import table

SF = "/root/testdata/sf0.001"


def plain_hit(value, clear, unclear, heading=False):
    """The rules by regular expressions."""
    words = lambda t: r"\s*".join(re.escape(x) for x in screens._TOKEN.findall(t)) if False else re.escape(t).replace(r"\ ", r"\s+")
    found = [(m.start(), -len(m.group()), t, m.group()) for t in clear for m in [re.search(rf"(?i)(?<!\w){words(t)}(?!\w)", value)] if m]
    if found:
        _, _, term, matched = min(found)
        return term, "clear", matched
    suffix = "|".join(screens.SUFFIXES)
    found = []
    for t in unclear:
        after = rf"(?i:{suffix})(?!\w)" if heading else rf"(?:(?i:{suffix})(?!\w)|[A-Z][A-Za-z0-9]+(?!\w))"
        if m := re.search(rf"(?<!\w)((?i:{words(t)}))\s+{after}", value):
            found.append((m.start(), t, m.group(1)))
    if found:
        _, term, matched = min(found)
        return term, "ambiguous", matched
    if not heading:
        for t in unclear:
            if value.strip() == t.title():
                return t, "ambiguous", value.strip()
    return None


def plain_document(text, clear, unclear, allowed, quoted):
    out, initialisms = [], set()
    own = re.findall(r"[a-z]+", text.lower())
    for number, line in enumerate(text.splitlines()):
        h = plain_hit(line.strip(), clear, unclear, line.lstrip().startswith("#"))
        if h is None or h[0] in allowed:
            continue
        b = h[2]
        if 2 <= len(b) <= 5 and b.isalpha() and b.isupper():
            n = len(b)
            if b in initialisms or any("".join(w[0] for w in own[i : i + n]) == b.lower() and sum(map(len, own[i : i + n])) >= 3 * n for i in range(len(own) - n + 1)):
                initialisms.add(b)
                continue
        out.append((number, h[0], h[1], "quoted" if quoted in line else "own"))
    return out


def test_all_documents_match_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    terms = benchmark_terms(spark, SF).distinct().collect()
    for r in docs.orderBy("doc_id").limit(120).collect():  # terms that the documents hold
        w = (r.text or "").split()[:6]
        if len(w) == 6:
            terms += [Row(term=" ".join(w[1:3]), tier="clear", allowed=r.doc_id % 5 == 0), Row(term=w[4], tier="ambiguous", allowed=False)]
    clear = {t.term.lower() for t in terms if t.tier == "clear" and t.term}
    unclear = {t.term.lower() for t in terms if t.tier == "ambiguous" and t.term} - clear
    allowed = {t.term.lower() for t in terms if t.allowed}
    # terms that end in a mark run on by their tokens; the pattern's word ends do not fit them
    simple = [t for t in terms if re.fullmatch(r"\w+(?: \w+)*", t.term or "")]
    keep = {t.term.lower() for t in simple}
    got = {}
    for r in screens.screen_documents(docs, spark.createDataFrame(simple, "term string, tier string, allowed boolean")).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.term, r.tier, r.lane))
    want = {d: w for d, t in docs.collect() if t and (w := plain_document(t, clear & keep, unclear & keep, allowed & keep, ">"))}
    assert {d: sorted(x) for d, x in got.items()} == want and len(want) > 20


def test_rules(spark):
    trie = screens.Trie()
    for term, tier in (("big blue", "clear"), ("apple", "ambiguous"), ("sap", "clear"), ("t-mobile", "clear")):
        trie.add(term, tier)
    assert screens.hit("the BIG  blue whale", trie) == ("big blue", "clear", "BIG  blue")
    assert screens.hit("a T-Mobile plan", trie) == ("t-mobile", "clear", "T-Mobile")
    assert screens.hit("an apple tree", trie) is None and screens.hit("sapling", trie) is None
    assert screens.hit("Apple Inc", trie)[1] == "ambiguous" and screens.hit(" Apple ", trie)[0] == "apple" and screens.hit("apple RenderKit", trie)[0] == "apple"
    assert screens.hit("Apple Region", trie, in_heading=True) is None and screens.hit("Apple labs", trie, in_heading=True)[0] == "apple"
    text = "satisfactory academic progress\nSAP is ours\n> sap here\nSAP again"
    assert screens.document_hits(text, trie, frozenset(), ">") == [(2, "sap", "clear", "quoted")]
    assert screens.document_hits("SAP alone", trie, frozenset(), ">") == [(0, "sap", "clear", "own")]
    assert screens.document_hits("SAP alone", trie, frozenset({"sap"}), ">") == []


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "big blue"), (3, "big blue"), (None, "x\nbig blue")], "doc_id long, text string").selectExpr("*", "'c' AS term", "1 AS line")
    terms = spark.createDataFrame([("big blue", "clear", False), ("", "clear", False), (None, "clear", True)], "term string, tier string, allowed boolean")
    got = sorted(map(tuple, screens.screen_documents(docs, terms).collect()), key=str)
    assert got == [(3, 0, "big blue", "clear", "own"), (3, 0, "big blue", "clear", "own"), (None, 1, "big blue", "clear", "own")]
    assert screens.screen_documents(docs, terms.limit(0)).count() == 0 and screens.screen_documents(docs.limit(0), terms).count() == 0
    with pytest.raises(ValueError):
        screens.screen_documents(docs, terms, most_bytes=3)
