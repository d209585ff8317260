import random
import re

import pytest

from marlstone.llm import pii

P = pii.Feistel(b"test key")
CARD = "4111 1111 1111 1111"


def test_data_inside_a_failed_candidate():
    for text, gone, kind in (
        (f"ID42 {CARD}", CARD, "card"),
        (f"PO77 {CARD}.", CARD, "card"),
        (f"1234 {CARD}", CARD, "card"),
        (f"BE68 5390 0754 7034 {CARD}", CARD, "card"),
        ("AB12 CDEF GHIJ KLMN@example.com", "KLMN@example", "email"),
        ("at 2024-03-05T10:00 it", "2024-03-05", "date"),
        ("at 2024-03-05T10:00:00Z", "2024-03-05", "date"),
    ):
        new, n = pii.pseudonymise(text, P)
        assert gone not in new and n[kind] == 1, (text, new)
        assert pii.pseudonymise(new, P, back=True)[0] == text
    for stays in ("2024-03-05Total", "2023-02-30T10:00", "order 4111111111111112", "x 999.1.1.1 y"):
        assert pii.pseudonymise(stays, P)[0] == stays


def test_going_back_from_overlapping_candidates():
    rng = random.Random(6)
    parts = ["ID42", "GB29", "BE68", "NWBK", "5390 0754 7034", CARD, "5500 0055 5555 5559", "1234", "19", "2024-03-05", "123-45-6789", "a@b.org", "555-123-4567", "x", "+12.34.56.78"]
    walked = 0
    for _ in range(1500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        new, n = pii.pseudonymise(text, P)
        back, m = pii.pseudonymise(new, P, back=True)
        walked += sum(n.values())
        assert (back, m) == (text, n), (text, new)
    assert walked > 1500


def test_long_runs_of_groups_are_linear():
    rng = random.Random(1)
    text = " ".join(f"{rng.randrange(10**4):04}" for _ in range(20_000))
    new, n = pii.pseudonymise(text, P)
    assert n["card"] > 1000 and pii.pseudonymise(new, P, back=True)[0] == text


def new_of(text):
    return pii.pseudonymise(text, P)[0]


def test_equal_values_in_other_spellings_stay_linked():
    days = [new_of(x) for x in ("1984-02-29", "02/29/1984", "29.02.1984")]
    y, m, d = days[0].split("-")
    assert days == [f"{y}-{m}-{d}", f"{m}/{d}/{y}", f"{d}.{m}.{y}"] and y + m + d != "19840229"
    mails = [new_of(x) for x in ("bob.b@example.com", "Bob.B@Example.com", "BOB.B@EXAMPLE.com")]
    assert len({x.lower() for x in mails}) == 1 and mails[1][0].isupper() and "bob" not in mails[0] and mails[2][:3].isupper()
    cards = {re.sub(r"\D", "", new_of(x)) for x in (CARD, CARD.replace(" ", ""), CARD.replace(" ", "-"), CARD.replace(" ", "\n"))}
    accounts = {re.sub(r"\s", "", new_of(x)) for x in ("GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "GB29 NWBK 6016\n1331 9268 19")}
    phones = {re.sub(r"\D", "", new_of(x))[-10:] for x in ("+1 (755) 555-9729", "+1-755-555-9729", "+17555559729", "(755) 555-9729", "755-555-9729", "+1 (755)\n555-9729")}
    assert len(cards) == len(accounts) == len(phones) == 1
    for x in ("Bob@Example.com", "+17555559729", "+37555559729", "+21234567890", "12/31/1999", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        assert pii.pseudonymise(new_of(x), P, back=True)[0] == x


def account(country, body):
    return f"{country}{98 - pii._mod97(body + country + '00'):02}{body}"


def test_account_numbers_of_any_letter_groups():
    rng = random.Random(3)
    for _ in range(400):
        body = "".join("".join(rng.choice(rng.choice(("ABCDEF", "0123456789", "AB01"))) for _ in range(4)) for _ in range(rng.randrange(3, 8)))[: rng.randrange(11, 31)]
        flat = account(rng.choice(("MT", "GB", "XK")), body)
        for shape in (flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)), "\n".join(flat[i : i + 4] for i in range(0, len(flat), 4))):
            text = f"see {shape}, thanks"
            new, n = pii.pseudonymise(text, P)
            assert n["iban"] == 1 and shape not in new, text
            assert pii.pseudonymise(new, P, back=True)[0] == text


def test_regions_hide_nothing(monkeypatch):
    """The search in regions is the search in whole texts."""
    rng = random.Random(9)
    parts = ["MT70", "MALT", "AB", "A", "ABCD.", "ABCDE", "(755)", "+1", "555-9729", "a@b.org", "x", "12", "4111", "1111", "1111 1111", "2024-03-05", "10.0.0.1", "é", "GB29", "NWBK", "6016 1331 9268 19"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\n", "  ", "", "\t"]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    split = [pii.pseudonymise(t, P) for t in texts]
    monkeypatch.setattr(pii, "_REGION", re.compile(r"(?s).+"))
    assert split == [pii.pseudonymise(t, P) for t in texts]


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.session_key(spark)
    assert pii.session_key(spark, b"mine") == b"mine"
