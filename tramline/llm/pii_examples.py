"""Made-up texts with personal data in unusual writing, and with numbers that only look like it, for training."""

from __future__ import annotations

import random

_FILL = "the report was sent after we had seen what they made of it in the end and then some more of this came up while others waited".split()
_NAMES = "anna.kern bob j.miller maria-lopez tom42 sales.team k_ito paul.b info lea".split()
_HOSTS = "example mailbox acme-corp univ post9 north".split()
_ENDS = "com org net de fr edu".split()


def _luhn_end(digits: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def _card(rng: random.Random, size: int) -> str:
    return _luhn_end(rng.choice("3456") + "".join(rng.choices("0123456789", k=size - 2)))


def _digits(rng: random.Random, k: int) -> str:
    return rng.choice("123456789") + "".join(rng.choices("0123456789", k=k - 1))


def _sample(rng: random.Random) -> tuple[str, str, bool]:
    """(cue before, text, whether it is personal data)"""
    name, host, end = rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS)
    kind = rng.randrange(13)
    if kind == 0:
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("[at]", "."), ("(at)", "."), ("{at}", "{dot}"), ("[@]", "[.]")])
        gap = rng.choice(["", " "])
        return rng.choice(["mail me at", "contact", "write to", "reach", "email:", ""]), f"{name}{gap}{at}{gap}{host}{gap}{dot}{gap}{end}", True
    if kind == 1:
        return rng.choice(["mail", "contact", "email", "write to", ""]), f"{name} at {host} dot {end}", True
    if kind == 2:
        return rng.choice(["meet", "look", "stay", "we stop"]), f"{rng.choice(_FILL)} at {rng.choice(_FILL)} dot {rng.choice(_FILL)}", False
    if kind == 3:
        quad = [str(rng.randrange(1, 256)) for _ in range(4)]
        return rng.choice(["host", "server", "ip", "address", "from", ""]), rng.choice(["[.]", "(.)", " dot ", "[dot]", "(dot)"]).join(quad), True
    if kind == 4:
        return rng.choice(["section", "chapter", "version", "release"]), "[.]".join(str(rng.randrange(300, 999)) for _ in range(4)), False
    if kind in (5, 6):
        number = _card(rng, 16)
        return rng.choice(["card", "visa", "credit card", "paid with", "mastercard no", "card number", ""]), rng.choice([".", "/", "_", "  "]).join(number[i : i + 4] for i in range(0, 16, 4)), True
    if kind == 7:
        number = _luhn_end(rng.choice(["34", "37"]) + "".join(rng.choices("0123456789", k=12)))
        return rng.choice(["card", "amex", "credit card", "paid with"]), rng.choice([f"{number[:4]} {number[4:10]} {number[10:]}", f"{number[:4]}-{number[4:10]}-{number[10:]}", number]), True
    if kind == 8:
        number = _digits(rng, 16)
        return rng.choice(["order", "ref", "serial", "ticket", "item no", "invoice", "id"]), rng.choice([".", "/", "_"]).join(number[i : i + 4] for i in range(0, 16, 4)), False
    if kind in (9, 10):
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        shape = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"0049 {a} {b} {c}", f"001-{a}-{b}-{c}"])
        return rng.choice(["call", "phone", "tel", "tel.", "mobile", "fax", "cell", "telefon", "phone number", "my number is"]), shape, True
    if kind == 11:
        sep = rng.choice([" ", "-", "."])
        return rng.choice(["order", "ref", "serial", "ticket", "total", "isbn", "part no", "invoice", "version", "room", "between", "scores", "", "", ""]), sep.join([_digits(rng, rng.choice([2, 3, 4])), _digits(rng, 3), _digits(rng, rng.choice([3, 4]))]), False
    return rng.choice(["order", "ref", "tracking", "id", "account"]), rng.choice(["37", "34", "35"]) + _digits(rng, 13), False


def examples(count: int, seed: int = 11) -> list[dict]:
    """Rows of text, and start, end (code points) and label of the one item in each."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        cue, item, label = _sample(rng)
        fill = lambda: " ".join(rng.choices(_FILL, k=rng.randrange(0, 9)))
        before = " ".join(x for x in (fill(), cue + rng.choice(["", ":"]) if cue else "") if x)
        before += " " if before else ""
        out.append({"text": f"{before}{item} {fill()}.", "start": len(before), "end": len(before) + len(item), "label": int(label)})
    return out
