import math
import random
import re
from collections import Counter

from marlstone.llm import secrets

LIMITS = secrets.Entropy()
ALLOWED = re.compile("|".join(f"(?:{x})" for x in secrets.ALLOWED))


def limit(w):
    if re.fullmatch("[0-9]+", w):
        return LIMITS.digits
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w):
        return LIMITS.hexadecimal
    return LIMITS.one_case if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", w) else LIMITS.mixed


def plain_words(s):
    """Whether letters may be words, by counting."""
    if not re.fullmatch("[A-Za-z]+([-_/.=+][A-Za-z]+)*", s):
        return False
    letters = re.sub("[^a-z]", "", s.lower())
    if len(re.sub("[^aeiouy]", "", letters)) / len(letters) < 0.3 or len(re.sub("[^jkqvwxz]", "", letters)) / len(letters) > 0.2:
        return False
    parts = re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+", s)
    if any(re.search("[^aeiouy]{5}", p.lower()) for p in parts):
        return False
    odd = [p for p in parts if len(p) < 3 or not set(p.lower()) & set("aeiouy")]
    return len(odd) <= 2 or 3 * len(odd) <= len(parts)


def plain_spans(text):
    """Entropy spans of a text, by the rules: candidates, what is allowed, every window."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        s = m.group()
        bare = s.strip("=-_/+")
        if not (ALLOWED.fullmatch(s) or ALLOWED.fullmatch(bare) or plain_words(bare)) and plain(s):
            out.append((m.start(), m.end(), "entropy"))
    return out


def plain(s):
    """Whether any window reaches the limit of its own class."""
    bits = lambda w: -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
    return any(bits(s[i : i + 20]) >= limit(s[i : i + 20]) - 1e-12 for i in range(len(s) - 19))


def test_every_window_is_held_against_its_own_class():
    rng = random.Random(4)
    found = 0
    for prefix in ("build/Release/", "Authorization=", "", "abc_", "x-"):
        for letters in ("0123456789ABCDEF", "0123456789abcdef", "0123456789", "abcdefghijklmnop0123", "ABCDEFxyz+/=012"):
            for _ in range(60):
                s = prefix + "".join(rng.choice(letters) for _ in range(rng.randrange(20, 40)))
                bare = s.strip("=-_/+")
                if s[-1] in "+/=" or ALLOWED.fullmatch(s) or ALLOWED.fullmatch(bare) or plain_words(bare):
                    assert secrets.entropy_spans(s, LIMITS, ALLOWED) == plain_spans(s)
                    continue
                assert secrets.entropy_spans(s, LIMITS, ALLOWED) == ([(0, len(s), "entropy")] if plain(s) else []), s
                found += plain(s)
    assert found > 500


def test_secrets_without_a_digit_are_candidates():
    assert secrets.entropy_spans("key qWe/+RtYuIoP/+AsDfGhJkL here", LIMITS, ALLOWED) == [(4, 27, "entropy")]
    assert secrets.entropy_spans("qWzXvBnMkLpOiUyTrEdFgHjKaSdQeRtY", LIMITS, ALLOWED) == [(0, 32, "entropy")]
    assert secrets.entropy_spans("wqxzvkjhtrbplmnoiuyegsdf", LIMITS, ALLOWED) == [(0, 24, "entropy")]
    assert secrets.entropy_spans("aVeryLongHttpServletRequestWrapperFactory thequickbrownfoxjumpsoverthelazydogs", LIMITS, ALLOWED) == []
    assert secrets.entropy_spans("some-long-identifier-of-words and Antidisestablishmentarianism", LIMITS, ALLOWED) == []


def test_most_random_letters_are_found():
    rng = random.Random(7)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(32)) for _ in range(300)]
    assert sum(bool(secrets.entropy_spans(k, LIMITS, ALLOWED)) for k in keys) > 285


def test_spans_within_fixed_kinds_against_brute_force():
    rng = random.Random(2)
    for _ in range(2000):
        base = sorted((a, a + rng.randrange(1, 12), "hex") for a in (rng.randrange(40) for _ in range(rng.randrange(6))))
        more = sorted((a, a + rng.randrange(1, 9), "entropy") for a in (rng.randrange(40) for _ in range(rng.randrange(6))))
        assert secrets._outside(more, base) == [x for x in more if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]


def test_a_long_text_of_spans_is_linear(spark):
    text = "0123456789abcdef01234567 q7Zp0Lx3Vt9Kc2Nw8Rb5Hs1Y " * 20_000
    df = spark.createDataFrame([(1, text), (2, None)], "spans long, text string")
    got = {r.doc_id: len(r.spans) for r in secrets.scan(df, id="spans").collect()}
    assert got == {1: 40_000, 2: 0}


def test_at_most_a_tenth_of_random_keys_is_missed():
    rng = random.Random(12)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = {"digits": digits, "hexadecimal": digits + "ABCDEF", "lower": low, "upper": up, "lower and digits": low + digits, "mixed": low + up, "mixed and digits": low + up + digits}
    for name, letters in classes.items():
        for n in (20, 24, 32, 40):
            for around in ("{}", "https={}", "http/{}", "key {} here", "http://x/{}"):
                keys = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(400)]
                missed = sum(not secrets.entropy_spans(around.format(k), LIMITS, ALLOWED) for k in keys)
                assert missed <= 40, (name, n, around, missed)


def test_times_and_words_are_allowed():
    for s in ("20240305T101500+0100Z", "2024-03-05T1015000100", "123e4567-e89b-12d3-a456-426614174000", "AbstractSingletonProxyFactoryBean", "internationalization", "MAX_CONNECTION_TIMEOUT_SECONDS"):
        assert secrets.entropy_spans(s, LIMITS, ALLOWED) == [], s
