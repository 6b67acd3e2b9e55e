"""Cases with known truth for the judge of personal data, planted into the corpus' own surroundings.

Each form makes a value and says whether it is personal.  What stands before it
is drawn apart from the value, with words of either kind or none, so that
neither the form nor the words alone tell the truth.
"""

from __future__ import annotations

import random
import string

_HEX = "0123456789abcdef"
_BASE = string.ascii_letters + string.digits


def _pick(draw: random.Random, chars: str, least: int, most: int | None = None) -> str:
    return "".join(draw.choice(chars) for _ in range(draw.randint(least, most or least)))


def _digits(draw: random.Random, *sizes: int, sep: str = " ") -> str:
    return sep.join(_pick(draw, string.digits, n) for n in sizes)


def _name(draw: random.Random) -> str:
    return _pick(draw, string.ascii_lowercase, 3, 9)


def _obfuscated(draw: random.Random) -> str:
    at, dot = draw.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", ".")])
    return f"{_name(draw)}{draw.choice(['', '.' + _name(draw), str(draw.randint(1, 99))])}{at}{_name(draw)}{dot}{draw.choice(['org', 'com', 'net', 'de', 'fr'])}"


def _date(draw: random.Random) -> str:
    y, m, d = draw.randint(1900, 2039), draw.randint(1, 12), draw.randint(1, 28)
    clock = f"{draw.randint(0, 23):02}:{draw.randint(0, 59):02}:{draw.randint(0, 59):02}"
    return draw.choice([
        f"{y}-{m:02}-{d:02}", f"{y}-{m:02}-{d:02} {clock}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{d:02}/{m:02}/{y} {clock}",
        f"{y}{m:02}{d:02}"])


def _years(draw: random.Random) -> str:
    a, b = draw.randint(1000, 2030), draw.randint(1000, 2030)
    return draw.choice([f"{a}-{a + draw.randint(1, 60)} {b}-{b + draw.randint(1, 60)}", f"{a}-{a + draw.randint(1, 60)}", f"{a}, {b}"])


def _decimals(draw: random.Random) -> str:
    one = lambda: f"{draw.randint(0, 999)}.{_pick(draw, string.digits, 4, 8)}"
    return draw.choice([one(), f"{one()} {one()}"])


def _thousands(draw: random.Random) -> str:
    return f"{draw.randint(1, 999)}" + draw.choice([" ", "."]) + draw.choice([
        _digits(draw, 3, 3), "000 000", "000 000 000", _digits(draw, 3, 3, 3), _digits(draw, 3, 3, sep=".")])


def _isbn(draw: random.Random) -> str:
    a = draw.randint(1, 5)
    return f"{draw.choice(['978', '979'])}-{draw.randint(0, 9)}-{_digits(draw, a, 8 - a, sep='-')}-{draw.randint(0, 9)}"


def _identifier(draw: random.Random) -> str:
    return draw.choice(["_", "-", "/"]).join(_name(draw) for _ in range(draw.randint(3, 5))) + str(draw.randint(0, 2030))


def _phone(draw: random.Random) -> str:
    return draw.choice([
        f"{_digits(draw, 3, 3, 4, sep=draw.choice([' ', '-', '.']))}", f"({_digits(draw, 3)}) {_digits(draw, 3, 4, sep='-')}",
        f"0{_digits(draw, 2, 7)}", f"0{_digits(draw, 2)}/{_digits(draw, 6)}", f"0{_digits(draw, 1, 2, 2, 2, 2)}"])


_CALL = ("call ", "tel ", "Tel. ", "phone: ", "fax ", "mobile ")
_ACCOUNT = ("account ", "account number ", "card ", "iban ", "account no. ")
_KEY = ("password: ", "token = ", "secret: ", "auth_token=", "api_key = ")
_PLAIN = ("", "", "on ", "of ", "in ", "since ", "and ", "no. ", "about ", "item ")

# Kind of the proposal, whether it is personal, what may stand before it, and the value.
FORMS = (
    ("contact", True, ("", "write to ", "contact ", "mail: ", "reach us at "), _obfuscated),
    ("contact", True, ("write to ", "contact ", "mail "), _obfuscated),
    ("contact", False, ("", "meet ", "see ", "call ", "contact "), lambda d: f"{_name(d)} {d.choice(['@', '(at)'])} {_name(d)}"),
    ("contact", False, ("", "ssh ", "run as "), lambda d: f"{_name(d)}@{_name(d)}"),
    ("contact", False, ("", "item ", "rate "), lambda d: f"{d.randint(10, 999)} @ {d.randint(10, 999)}"),
    ("number", True, _CALL, _phone),
    ("number", True, ("", *_CALL), lambda d: f"({_digits(d, 3)}) {_digits(d, 3, 4, sep='-')}"),
    ("number", True, _ACCOUNT, lambda d: _pick(d, string.digits, 9, 16)),
    ("number", True, _ACCOUNT, lambda d: _digits(d, 4, 4, 4, 4, sep=d.choice([" ", "-"]))),
    ("number", False, (*_PLAIN, "call on "), _date),
    ("number", False, _PLAIN, _date),
    ("number", False, ("", "from ", "in ", "between "), _years),
    ("number", False, ("", "at ", "lat ", "of "), _decimals),
    ("number", False, _PLAIN, _thousands),
    ("number", False, ("", "ISBN ", "isbn: "), _isbn),
    ("number", False, ("", "version ", "release "), lambda d: ".".join(str(d.randint(0, 400)) for _ in range(3)) + f".{d.randint(256, 999)}"),
    ("number", False, _PLAIN, lambda d: _pick(d, string.digits, 7, 16)),
    ("secret", True, _KEY, lambda d: _pick(d, _BASE, 18, 40) + str(d.randint(0, 9)) + d.choice(string.ascii_letters)),
    ("secret", True, tuple(f'{k}"' for k in _KEY), lambda d: _pick(d, _HEX, 30, 40) + "a1"),
    ("secret", False, ("", "commit ", "sha1 ", "rev ", "sha256: ", "hash ", "md5: ", 'commit = "'), lambda d: _pick(d, _HEX, d.choice([32, 40, 64]))),
    ("secret", False, ("", "see ", "in ", "file "), _identifier),
)


def planted(text: str, seed: int, around: int, cases: int) -> list[tuple[str, int, int, str, bool]]:
    """``(text around, start, end, kind, personal)`` of some values put between words of ``text``."""
    draw = random.Random(seed)
    out = []
    for _ in range(cases):
        kind, personal, leads, make = draw.choice(FORMS)
        at = text.find(" ", draw.randint(0, len(text)))
        at = len(text) if at < 0 else at
        lead, body = draw.choice(leads), make(draw)
        before = f"{text[max(0, at - around):at]} {lead}"
        after = draw.choice(['"'] if lead.endswith('"') else ["", "", ".", ","])
        out.append((f"{before}{body}{after}{text[at:at + around]}", len(before), len(before) + len(body), kind, personal))
    return out
