"""URL verdicts: listed rules first, a weighted vocabulary for all other addresses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.text import fresh_name, lower_ascii

# One of the first kind rejects an address, several different ones of the second do.
STRICT = ["camgirl", "camgirls", "hentai", "milf", "porn", "porno", "pornhub", "sexcam", "xxx"]
SOFT = [
    "adult",
    "bet",
    "betting",
    "casino",
    "dating",
    "escort",
    "gambling",
    "jackpot",
    "nude",
    "poker",
    "sex",
    "slots",
    "viagra",
    "warez",
]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for addresses on ``host`` or a subdomain whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lowered; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return on_host & F.startswith(path, F.lit(rule.path))


def _choice(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        chosen = F.when(_fits(host, path, rule), F.lit(value(rule))).otherwise(chosen)
    return chosen


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """A column function counting the distinct strict and soft terms of an address.

    One Aho-Corasick automaton finds all terms in one pass over the address. A hit counts where
    no ASCII letter or digit adjoins it on either side.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict:
            automaton.add_word(term, (term, True))
        for term in soft:
            automaton.add_word(term, (term, False))
        automaton.make_automaton()
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

        def of(url: str | None) -> tuple[int, int]:
            hits: tuple[set, set] = (set(), set())
            lowered = "" if url is None else url.translate(lower)
            for last, (term, is_strict) in automaton.iter(lowered):
                first = last - len(term) + 1
                before = lowered[first - 1] if first else ""
                after = lowered[last + 1 : last + 2]
                if before not in inner and after not in inner:
                    hits[is_strict].add(term)
            return len(hits[True]), len(hits[False])

        for urls in batches:
            yield pd.DataFrame([of(u) for u in urls], columns=["strict", "soft"])

    return F.pandas_udf(count, "strict long, soft long")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
    url: str = "url",
) -> DataFrame:
    """All rows and columns of ``pages`` plus ``host, path, rule, n_strict, n_soft, verdict``.

    Columns of those names are replaced. The longest fitting rule decides; where none fits, one
    strict term or ``soft_limit`` distinct soft ones block. A null, empty or malformed address has
    an empty host and path, fits no rule, and is blocked by its terms alone (null: allowed).
    Repeated rows are judged alike, addresses of any length whole; an empty table gives no rows. Rules and terms are parameters of
    the plan and bounded by that; a row is judged by itself, so nothing is shuffled.
    """
    host, path = F.col("host"), F.col("path")
    listed = _choice(host, path, rules, lambda r: r.verdict)
    found = fresh_name(pages, "found_")
    hits = vocabulary_hits(strict, soft)(F.col(url))
    blocked = (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit)
    own = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return (
        pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumn("rule", _choice(host, path, rules, lambda r: r.name))
        .withColumn(found, hits)
        .withColumns({"n_strict": F.col(f"{found}.strict"), "n_soft": F.col(f"{found}.soft")})
        .withColumn("verdict", F.coalesce(listed, own))
        .drop(found)
    )
