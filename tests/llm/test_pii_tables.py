"""Pseudonyms over a table whose personal values are known by construction."""

import datetime as dt
import random

from tidemark.llm.common import ship_package
from tidemark.llm.pii import KINDS, pseudonym, pseudonymise

KEY = b"a key"


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text):
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def values(rng):
    """(kind, text) of valid values, and (None, text) of ones that only look alike."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    body = "4" + digits(14)
    card = next(c for k in range(10) if luhn_ok(c := body + str(k)))
    flat = "".join(rng.choice("0123456789") for _ in range(18))
    iban = next(f"DE{k:02d}{flat}" for k in range(2, 99) if iban_ok(f"DE{k:02d}{flat}"))
    day = dt.date(1950, 1, 1) + dt.timedelta(days=rng.randrange(30_000))
    ssn = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    good = [
        ("email", f"{rng.choice(['ann', 'bob.lee', 'c+d'])}{digits(2)}@mail{digits(1)}.example.org"), ("card", card), ("card", " ".join(card[i : i + 4] for i in range(0, 16, 4))),
        ("iban", iban), ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("phone", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}"), ("ssn", ssn),
        ("date", day.strftime("%Y-%m-%d")), ("date", day.strftime("%d.%m.%Y")), ("date", day.strftime("%m/%d/%Y")), ("secret", "".join(rng.choice("0123456789abcdef") for _ in range(24))),
    ]
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    bad = [wrong, "300.1.2.3", "000-12-3456", "2020-13-40", "12345", "v1.2.3", "no@where", "31.02.1999", iban[:2] + f"{(int(iban[2:4]) + 1) % 97:02d}" + iban[4:]]
    return good, bad


def document(rng, n):
    """A text, what becomes of it, and how many of each kind it has."""
    text, want, counts = [], [], dict.fromkeys(KINDS, 0)
    for _ in range(n):
        good, bad = values(rng)
        kind, value = rng.choice(good) if rng.random() < 0.7 else (None, rng.choice(bad))
        before = rng.choice(["tanor ", "of the\n", "(see) ", "été "]) + ("token = " if kind == "secret" else "")
        after = rng.choice([" and ", ", ing ", " .\n"])
        text += [before, value, after]
        want += [before, pseudonym(kind, value, KEY) if kind else value, after]
        if kind:
            counts[kind] += 1
    return "".join(text), "".join(want), counts


def test_every_value_and_nothing_else(spark):
    ship_package(spark)
    rng = random.Random(9)
    known = [document(rng, rng.choice([1, 5, 40])) for _ in range(150)] + [document(rng, 6000)]  # a very long text too
    rows = [(i, t, "x", 1) for i, (t, _, _) in enumerate(known)] + [(None, known[0][0], "x", 1), (900, None, "x", 1), (901, "", "x", 1), (3, known[3][0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, n_card int").repartition(4)
    got = pseudonymise(df, KEY.decode()).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, (_, want, counts) in enumerate(known):
        assert by[i]["text"] == want and {k: by[i][f"n_{k}"] for k in KINDS} == counts, i
    assert by[None]["text"] == known[0][1] and by[900]["text"] is None and by[901]["text"] == ""
    back = {r["id"]: r["text"] for r in pseudonymise(spark.createDataFrame([(r["id"], r["text"]) for r in got], "doc_id bigint, text string"), KEY.decode(), inverse=True).collect()}
    assert all(back[i] == t for i, (t, _, _) in enumerate(known))


def test_pseudonyms_are_valid_and_linked():
    rng = random.Random(10)
    seen: dict[str, dict[str, str]] = {k: {} for k in KINDS}
    for _ in range(400):
        for kind, value in values(rng)[0]:
            new = pseudonym(kind, value, KEY)
            assert pseudonym(kind, value, KEY) == new and pseudonym(kind, new, KEY, inverse=True) == value and (len(new) == len(value) or kind == "ip")
            assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind in ("email", "secret", "ip")
            seen[kind][value] = new
            if kind == "card":
                assert luhn_ok(new.replace(" ", "")) and pseudonym(kind, value.replace(" ", ""), KEY) == new.replace(" ", "")
            if kind == "iban":
                assert iban_ok(new)
            if kind == "ip":
                assert all(0 <= int(x) <= 255 for x in new.split("."))
    for kind, made in seen.items():
        assert len(set(made.values())) == len(made) and sum(a == b for a, b in made.items()) <= 2, kind
