"""Personal data: exact base spans, and further ones chosen among candidates by boosted trees."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.text import fresh_name, whole
from panelcast.sources.scratch import Scratch

KINDS = ["email", "ip", "card", "phone"]


@dataclass(frozen=True)
class Selection:
    """How the trees are fitted and what they may add.

    The labels are made by rule (``pii_labels``) and never taken from the corpus, so a text gets the
    same spans in any company. ``most_labelled`` bounds the labelled candidates of the fit;
    ``least_labelled`` is the number of each class that every kind must have among them, or else
    the fit is refused; ``precision`` is what the threshold of each kind must reach on the held-out fifth,
    and ``least_score`` the lowest threshold.
    """

    most_labelled: int = 20_000
    least_labelled: int = 50
    trees: int = 20
    depth: int = 4
    precision: float = 0.99
    least_score: float = 0.9


# The base patterns. Runs are taken whole, which finds the same and stays linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What the wider candidates are made of: at signs in words, hosts, groups of hexadecimal digits,
# and runs of groups of digits.
WORDED_AT = re.compile(r"(?i)\s{0,3}[(\[{<]\s?at\s?[)\]}>]\s{0,3}|\s{1,3}at\s{1,3}")
HOST = re.compile(
    r"(?i)[a-z0-9-]{1,63}(?:(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s{1,3}dot\s{1,3}|\.)[a-z0-9-]{1,63})+"
)
HEX_GROUPS = re.compile(
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?=:))?(?::{1,2}[0-9A-Fa-f]{1,4}){0,8}(?:::)?(?![0-9A-Za-z:])"
)
DIGIT_RUN = re.compile(r"[0-9]++(?:[\x20().\-/_]{1,3}[0-9]++)*+")
DIGITS = re.compile(r"[0-9]+")
KEYWORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
SYMBOLS = frozenset("#*$%&|<>")
MORE_BEFORE = re.compile(r"[0-9][\x20().,/_-]{1,3}\Z")
MORE_AFTER = re.compile(r"[\x20().,/_-]{1,3}[0-9]")
COMMON_HOST = re.compile(r"(?i)\sat\s+(?:the|a|an|this|that|our|his|her|its|my|home)\b")
CONTEXT = 30

SPAN = "struct<kind:int,start:int,stop:int>"
FOUND = (
    f"base array<{SPAN}>, "
    "candidates array<struct<kind:int,start:int,stop:int,features:array<double>>>"
)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Matches around each at sign; those without a whole domain come with False."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            domain = DOMAIN.match(text, at + 1)
            if domain:
                last = domain.end()
                yield start, last, True
            else:
                yield start, at + 1, False
        at = text.find("@", max(at + 1, last))


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Matches of the base patterns, ``(kind, start, stop, passes)``."""
    if "@" in text:
        for start, stop, passes in emails(text):
            yield 0, start, stop, passes
    for found in IP.finditer(text):
        parts = found[0].split(".")
        passes = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
        yield 1, found.start(), found.end(), passes
    for found in CARD.finditer(text):
        if found.end() - found.start() < 10:
            continue
        digits = found[0].replace(" ", "").replace("-", "")
        if len(digits) >= 10:
            yield 2, found.start(), found.end(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for found in PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in found[0])
            yield 3, found.start(), found.end(), 9 <= n <= 15


def wide_matches(text: str) -> Iterator[tuple[int, int, int]]:
    """Whatever could be one of the kinds; the trees choose.

    Worded at signs in any case between a name, however long, and a host; hexadecimal groups with a
    double colon or eight in number (an address has no more); and in runs of digits with the usual
    separators every sequence of groups with 7 to 19 digits, so that a number is found beside another
    one. As a group has a digit, that is at most 19 sequences from any group.
    """
    for at in WORDED_AT.finditer(text):
        start = at.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at.end())
        if start < at.start() and host:
            yield 0, start, host.end()
    if "::" in text or text.count(":") >= 7:
        for found in HEX_GROUPS.finditer(text):
            if "::" in found[0] and len(found[0]) > 2 or found[0].count(":") == 7:
                yield 1, found.start(), found.end()
    for run in DIGIT_RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in DIGITS.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                first, stop = groups[j]
                n += stop - first
                if n > 19:
                    break
                if n < 7:
                    continue
                opened = start > 0 and text[start - 1] == "(" and ")" in text[start:stop]
                if n <= 15:
                    yield 3, start - opened, stop
                if n >= 13 and j > i:
                    yield 2, start, stop


def features(text: str, kind: int, start: int, stop: int) -> list[float]:
    """Format and context of a span; whether it has a leading plus or at sign is not among them."""
    value = text[start:stop]
    digits = "".join(c for c in value if "0" <= c <= "9")
    runs = [len(r) for r in re.findall("[0-9]+", value)] or [0]
    marks = [c for c in value if not c.isalnum() and c not in "+@"]
    before = text[max(0, start - CONTEXT) : start].lower()
    left, right = text[start - 1 : start], text[stop : stop + 1]
    tail = re.search(r"[A-Za-z]+\Z", value)
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(stop - start),
        float(len(digits)),
        float(sum(c.isalpha() for c in value)),
        float(len(marks)),
        float(len(set(marks))),
        float(len(runs)),
        float(max(runs)),
        float(min(runs)),
        float(len(set(digits))),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(kind == 1 and any(int(r[-6:]) > 255 for r in re.findall("[0-9]+", value))),
        float(len(tail[0]) if tail else 0),
        float(left.isalnum()),
        float(right.isalnum()),
        float(left in SYMBOLS or right in SYMBOLS),
        float(any(w in before for w in KEYWORDS[KINDS[kind]])),
        float(sum("0" <= c <= "9" for c in before)),
        float(kind == 1 and _is_ipv6(value)),
        float(bool(MORE_BEFORE.search(text[max(0, start - 4) : start]))),
        float(bool(MORE_AFTER.match(text[stop : stop + 4]))),
        float(kind == 0 and any(c in value for c in "([{<")),
        float(kind == 0 and bool(re.search(r"(?i)\Wdot\W", value))),
        float(kind == 0 and bool(COMMON_HOST.search(value))),
        float(kind == 0 and bool(re.search(r"(?i)\Wdot\W", value)) and not COMMON_HOST.search(value)),
        float(value[:1] == "0"),
        float(value[:1] in "12"),
        *[float(r) for r in (runs + [0] * 5)[:5]],
        *[float(value.count(c)) for c in " .-/_("],
    ]


def _is_ipv6(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def look_through(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans of a whole text, and the wider candidates, which overlap no base span but may
    overlap one another."""
    base, candidates = [], []
    if not re.search("[0-9@:]|(?i:at)", text):
        return base, candidates
    base = sorted((kind, start, stop) for kind, start, stop, passes in matches(text) if passes)
    merged: list[list[int]] = []
    for start, stop in sorted((s, e) for _, s, e in base):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(stop, merged[-1][1])
        else:
            merged.append([start, stop])
    starts = [s for s, _ in merged]
    for kind, start, stop in wide_matches(text):
        before = bisect_left(starts, stop) - 1
        if before < 0 or merged[before][1] <= start:
            candidates.append((kind, start, stop, features(text, kind, start, stop)))
    return base, candidates


def find_candidates(text: Column) -> Column:
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([look_through(t) for t in texts], columns=["base", "candidates"])

    return F.pandas_udf(find, FOUND)(whole(text))


@lru_cache(maxsize=1)
def _labelled() -> list[tuple[int, int, float, list[float]]]:
    """``(uid, kind, label, features)`` of the candidates in the labelled texts."""
    from panelcast.llm.pii_labels import labelled_texts

    rows = []
    for text, span in labelled_texts():
        for kind, start, stop, values in look_through(text)[1]:
            rows.append((len(rows), kind, float((kind, start, stop) == span), values))
    return rows


_FITTED: dict[tuple[str, Selection], dict[int, tuple[Model, float]]] = {}


def _fit(spark: SparkSession, options: Selection) -> dict[int, tuple[Model, float]]:
    """The trees of each kind and their threshold; too few labels of a kind are an error.

    Both classes weigh the same in the fit; the threshold is found on the labels as they are. As the
    labels are fixed, an application fits once for the same options.
    """
    key = spark.sparkContext.applicationId, options
    if key in _FITTED:
        return _FITTED[key]
    given = _labelled()
    share = min(1.0, options.most_labelled / len(given))
    unit = F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) / 1_000_000
    fitted = {}
    for kind, name in enumerate(KINDS):
        of_kind = [r for r in given if r[1] == kind]
        right = sum(r[2] == 1.0 for r in of_kind)
        wrong = len(of_kind) - right
        if min(right, wrong) < max(1, options.least_labelled):
            raise ValueError(f"{name}: {right} right and {wrong} wrong labelled candidates")
        rows = (
            spark.createDataFrame(
                of_kind, "uid long, kind int, label double, features array<double>"
            )
            .withColumn("unit", unit)
            .filter(F.col("unit") < share)
            .select(
                "label",
                F.when(F.col("label") == 1.0, wrong / right).otherwise(1.0).alias("weight"),
                array_to_vector("features").alias("vector"),
                (F.col("unit") < share / 5).alias("held"),
            )
            .coalesce(1)
        )
        trees = GBTClassifier(
            featuresCol="vector",
            weightCol="weight",
            maxIter=options.trees,
            maxDepth=options.depth,
            seed=7,
        )
        model = trees.fit(rows.filter(~F.col("held")))
        scored = model.transform(rows.filter("held")).select(
            vector_to_array("probability")[1].alias("p"), "label"
        )
        ranked = sorted(((r["p"], r["label"]) for r in scored.collect()), key=lambda r: -r[0])
        for output in ("prediction", "rawPrediction", "probability"):
            model = model.copy({model.getParam(f"{output}Col"): f"{output}_{name}"})
        fitted[kind] = model, _threshold(ranked, options)
    _FITTED.clear()
    _FITTED[key] = fitted
    return fitted


def _threshold(ranked: list[tuple[float, float]], options: Selection) -> float:
    """The lowest score down to which the held-out labels reach the precision."""
    threshold, right = 1.0, 0.0
    for i, (p, label) in enumerate(ranked):
        right += label
        last_of_ties = i + 1 == len(ranked) or ranked[i + 1][0] < p
        if last_of_ties and right / (i + 1) >= options.precision:
            threshold = p
    return max(threshold, options.least_score)


def _choose(spans: Column) -> Column:
    """Of overlapping spans the one of the highest score, ties to the first."""
    first_best = F.array_sort(
        F.transform(
            spans,
            lambda x: F.struct(
                (-x["p"]).alias("minus"), x["start"].alias("start"), x["stop"].alias("stop"),
                x["kind"].alias("kind"),
            ),
        )
    )
    none = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(
        first_best,
        none,
        lambda kept, x: F.when(
            F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"])), kept
        ).otherwise(
            F.concat(kept, F.array(F.struct(x["kind"], x["start"], x["stop"]).cast(SPAN)))
        ),
    )


def find_spans(
    docs: DataFrame,
    scratch: Scratch,
    options: Selection = Selection(),
    text: str = "text",
    keep_text: bool = True,
) -> tuple[DataFrame, str, str]:
    """``docs`` with the base spans and the added ones, and the names of the two columns.

    Both are arrays of ``(kind, start, stop)`` in code points, stop exclusive, ``kind`` a place in
    ``KINDS``. A null or empty text has none; long texts are read whole; repeated rows are treated
    alike; an empty table gives no rows; further columns stay, whatever their names. Texts are read in one pass, which also proposes the candidates; what
    the trees score are rows of a few numbers. Base spans are never dropped, and an added span never
    overlaps one. Without ``keep_text`` the text is left out of the result and of what is stored.
    """
    uid, found = fresh_name(docs, "uid"), fresh_name(docs, "found")
    base, added = fresh_name(docs, "base_spans"), fresh_name(docs, "added_spans")
    of_uid, chosen = fresh_name(docs, "of_uid"), fresh_name(docs, "chosen")
    looked = docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(
        found, find_candidates(F.col(text))
    )
    marked = scratch.save(looked if keep_text else looked.drop(text), "candidates")
    each = marked.select(
        F.col(uid).alias("uid"), F.explode(f"{found}.candidates").alias("c")
    ).select("uid", "c.*")
    fitted = _fit(docs.sparkSession, options)
    none = F.array().cast(f"array<{SPAN}>")
    with_base = marked.withColumn(base, F.col(f"{found}.base")).drop(found)
    each = each.withColumn("vector", array_to_vector("features"))
    score, threshold = F.lit(0.0), F.lit(1.0)
    for kind, (model, least) in fitted.items():
        each = model.transform(each)
        of_kind = F.col("kind") == kind
        p = vector_to_array(f"probability_{KINDS[kind]}")[1]
        score = F.when(of_kind, p).otherwise(score)
        threshold = F.when(of_kind, F.lit(least)).otherwise(threshold)
    scored = (
        each.withColumn("p", score)
        .filter(F.col("p") >= threshold)
        .groupBy("uid")
        .agg(F.collect_list(F.struct("kind", "start", "stop", "p")).alias("spans"))
        .select(F.col("uid").alias(of_uid), _choose(F.col("spans")).alias(chosen))
    )
    joined = with_base.join(scored, F.col(uid) == F.col(of_uid), "left")
    return (
        joined.withColumn(added, F.coalesce(chosen, none)).drop(uid, of_uid, chosen),
        base,
        added,
    )


def ordered(spans: Column) -> Column:
    """By kind, then start."""
    return F.array_sort(spans)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            ordered(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]),
        ),
        ",",
    )


def redact(
    docs: DataFrame, scratch: Scratch, options: Selection = Selection(), text: str = "text"
) -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``[EMAIL]``.

    Overlapping spans are replaced once, under the kind of the first. ``n_chars``, where there is
    one, follows the text; a null text stays null.
    """
    spanned, base, added = find_spans(docs, scratch, options, text)

    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def of(value, spans):
            if value is None or not len(spans):
                return value
            parts, at = [], 0
            for span in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                if span["start"] >= at:
                    parts += [value[at : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
                at = max(at, span["stop"])
            return "".join(parts) + value[at:]

        for texts, spans in batches:
            yield pd.Series([of(t, s) for t, s in zip(texts, spans)], dtype=object)

    cleaned = F.pandas_udf(replace, "string")(F.col(text), F.concat(base, added))
    done = spanned.withColumn(text, cleaned).drop(base, added)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
