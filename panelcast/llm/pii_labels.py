"""Labelled texts for the trees of ``pii``: made by rule, the same whatever the corpus holds."""

from __future__ import annotations

import random
from collections.abc import Iterator

from panelcast.llm.pii import KEYWORDS, KINDS, luhn

PER_FORM = 90
LEAD = "the of and with from was in per la el der die und pour con see about for it said".split()
NAMES = "anna ben.king c_lee d.ortiz eva99 frank info sales j.smith kontakt office me us".split()
HOSTS = "example mail-box host acme uni-bonn firma school9 shop".split()
TOPS = "com org net de fr es info co.uk".split()
COMMON = "the a this home our that".split()

# A form draws one value: # is a digit, the rest stands for itself.
PHONES = [
    "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "1-8##-###-####", "0## #######",
    "0## / #######", "0#### ######", "(0##) ### ## ##", "(0###) ######", "01 ## ## ## ##",
    "6## ### ###", "9## ## ## ##", "0049 ## ########", "0033 # ## ## ## ##", "(###)###-####",
    "0##-####-####", "0## #### ####", "1 (###) ###-####", "1.###.###.####",
    "00 ## # ## ## ## ##", "00 ## ## ## ## ## ##",
]
NO_PHONES = [
    "19##-0#-1#", "20##-1#-0#", "1#.0#.20##", "0#/1#/19##", "#.##.###.#", "###.##.3##.7", "##.###.##",
    "20##-0#-1# 1#:##", "19##-19##", "19## - 20##", "#######", "########", "### ### ###.##", "#-###-#####-#",
    "978-#-##-######-#", "# ## ### ####", "##.####.##.##", "# # # # # # # # #", "## ### ### ##-####", "#### ####",
    "##########", "###/####/##", "20## 20## 20##", "######-####", "#.#.#.#.#.#.#", "###.###.3##.7",
    "############", "######_######", "####.####", "###.###.###",
]
CARDS = ["####.####.####.####", "####/####/####/####", "####_####_####_####", "####.######.#####"]
IPS = ["2001:db8::#", "fe80::#a#b:##ff:fe##:#c#d", "2a0#:##f8:#:##::#", "::1", "2001:0db8:85a3:0000:0000:8a2e:0370:####"]
NO_IPS = ["1#:##:##", "00:1a:##:3c:4d:5e", "#:#", "1:##:##:##", "##:##", "ab:cd:ef", "fe:##:ca", "a::b", "dead::beef"]


def _value(rng: random.Random, form: str) -> str:
    return "".join(rng.choice("0123456789") if c == "#" else c for c in form)


def _card(rng: random.Random, form: str, right: bool) -> str:
    while True:
        value = _value(rng, form)
        if luhn("".join(c for c in value if c.isdigit())) == right:
            return value


def _email(rng: random.Random, right: bool) -> str:
    if not right:
        dot = rng.choice([".", " dot ", "."])
        host = rng.choice(COMMON) if dot == " dot " else rng.choice(HOSTS)
        return f"{rng.choice(LEAD)} at {host}{dot}{rng.choice(TOPS[:6])}"
    left, close = rng.choice(["()", "[]", "{}"])
    space = rng.choice(["", " "])
    word = rng.choice(["at", "AT", "At"])
    inside = rng.choice(["", " "])
    at = f"{space}{left}{inside}{word}{inside}{close}{space}"
    dot = rng.choice([".", f"{space}{left}{inside}dot{inside}{close}{space}", " dot "])
    if rng.random() < 0.4:
        at, dot = f" {word} ", rng.choice([" dot ", " DOT "])
    return f"{rng.choice(NAMES)}{at}{rng.choice(HOSTS)}{dot}{rng.choice(TOPS[:6])}"


def labelled_texts(per_form: int = PER_FORM) -> Iterator[tuple[str, tuple[int, int, int] | None]]:
    """Texts with the span ``(kind, start, stop)`` that is right in them, or None where none is."""
    rng = random.Random(7)

    def text(kind: int, value: str, right: bool):
        lead = rng.sample(LEAD, 3)
        if rng.random() < (0.6 if right else 0.25):
            lead[-1] = rng.choice(KEYWORDS[KINDS[kind]])
        before = " ".join(lead) + rng.choice([" ", ": "])
        after = rng.choice([" ", ", ", ". ", ""]) + " ".join(rng.sample(LEAD, 2))
        span = (kind, len(before), len(before) + len(value)) if right else None
        return f"{before}{value}{after if after[0] in ' ,.' else ' ' + after}", span

    for _ in range(per_form):
        for _ in range(8):
            yield text(0, _email(rng, True), True)
            yield text(0, _email(rng, False), False)
        for form in IPS:
            yield text(1, _value(rng, form), True)
        for form in NO_IPS:
            yield text(1, _value(rng, form), False)
        for form in CARDS:
            yield text(2, _card(rng, form, True), True)
            yield text(2, _card(rng, form, False), False)
        for form in PHONES:
            yield text(3, _value(rng, form), True)
        for form in NO_PHONES:
            yield text(3, _value(rng, form), False)
