"""Line-first cleaning by column expressions alone.

Every line is judged by itself, failing lines are removed, and a document that loses too much of
its text goes as a whole. A row is judged inside its own row: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.text import bind, count_of, fresh_name, whole, words

# Symbols that prose has little of, and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = [
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
]
# What a line with a sentence mark mostly has; looked for before the long class.
COMMON_MARKS = ".!?"
# Unicode's property Sentence_Terminal, which Java's patterns do not name, and colons and semicolons
# of other scripts.
TERMINATORS = (
    r".!?\x{589}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}\x{83E}\x{964}\x{965}"
    r"\x{104A}\x{104B}\x{1362}\x{1367}\x{1368}\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}"
    r"\x{1944}\x{1945}\x{1AA8}-\x{1AAB}\x{1B4E}\x{1B4F}\x{1B5A}\x{1B5B}\x{1B5E}\x{1B5F}\x{1B7D}-\x{1B7F}"
    r"\x{1C3B}\x{1C3C}\x{1C7E}\x{1C7F}\x{2024}\x{203C}\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}\x{2E2E}"
    r"\x{2E3C}\x{2E53}\x{2E54}\x{3002}\x{A4FF}\x{A60E}\x{A60F}\x{A6F3}\x{A6F7}\x{A876}\x{A877}\x{A8CE}"
    r"\x{A8CF}\x{A92F}\x{A9C8}\x{A9C9}\x{AA5D}-\x{AA5F}\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}"
    r"\x{FE52}\x{FE56}\x{FE57}\x{FF01}\x{FF0E}\x{FF1F}\x{FF61}\x{10A56}\x{10A57}\x{10F55}-\x{10F59}"
    r"\x{10F86}-\x{10F89}\x{11047}\x{11048}\x{110BE}-\x{110C1}\x{11141}-\x{11143}\x{111C5}\x{111C6}"
    r"\x{111CD}\x{111DE}\x{111DF}\x{11238}\x{11239}\x{1123B}\x{1123C}\x{112A9}\x{113D4}\x{113D5}\x{1144B}"
    r"\x{1144C}\x{115C2}\x{115C3}\x{115C9}-\x{115D7}\x{11641}\x{11642}\x{1173C}-\x{1173E}\x{11944}\x{11946}"
    r"\x{11A42}\x{11A43}\x{11A9B}\x{11A9C}\x{11C41}\x{11C42}\x{11EF7}\x{11EF8}\x{11F43}\x{11F44}\x{16A6E}"
    r"\x{16A6F}\x{16AF5}\x{16B37}\x{16B38}\x{16B44}\x{16D6E}\x{16D6F}\x{16E98}\x{1BC9F}\x{1DA88}"
    r"…:;\x{37E}\x{387}\x{61B}\x{FF1A}\x{FF1B}"
)
# Commas and dashes of all scripts.
CLAUSE_MARKS = (
    r",\x{55D}\x{60C}\x{7F8}\x{1363}-\x{1366}\x{1802}\x{1808}\x{2013}-\x{2015}\x{3001}\x{A4FE}\x{A60D}"
    r"\x{FE10}\x{FE11}\x{FE50}\x{FE51}\x{FF0C}\x{FF64}"
)
# Separators of menus beside the bar; a slash only as a word, a middle dot not inside a word.
SEPARATORS = r"[»›→▸▶❯•‣∙⋅]|(?<!\p{L})·|·(?!\p{L})|(?<!\S)/(?!\S)"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the two document rules.

    ``symbol_percent``: share of symbols in a line's word characters; ``shout_percent``: double
    exclamation marks per word; ``bars`` and ``bar_percent``: separators of a navigation line, at
    least so many and per word; ``furniture_words``: longest line that a boilerplate phrase fails;
    ``unmarked_words``: shortest line that can fail for the want of a sentence mark, which it does
    if it has no clause mark either, or fewer than ``distinct_percent`` of its words are distinct;
    ``lost_percent``: most word characters a document may lose with its failing lines;
    ``least_words`` and ``repeat_percent``: the base rules.
    """

    symbol_percent: int = 10
    shout_percent: int = 20
    bars: int = 3
    bar_percent: int = 20
    furniture_words: int = 30
    unmarked_words: int = 30
    lost_percent: int = 30
    least_words: int = 20
    repeat_percent: int = 30
    distinct_percent: int = 50


WINDOW = 8


def _line_fails(
    line: Column, n: Column, chars: Column, symbols: Column, hashes: Column, rules: Rules
) -> Column:
    """The cheap test of each rule comes first and spares most lines the counting."""
    bars = count_of(line, "|")
    # Closing guillemets are no separators.
    separators = bars + F.regexp_count(line, F.lit(SEPARATORS)) - count_of(line, "«‹")
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    punctuation = (
        (symbols * 100 > chars * rules.symbol_percent)
        | (F.contains(line, F.lit("!!")) & (shouts >= 2) & (shouts * 100 > n * rules.shout_percent))
        | (
            (n >= rules.unmarked_words)
            & ~F.rlike(line, F.lit(f"[{COMMON_MARKS}]"))
            & ~F.rlike(line, F.lit(f"[{TERMINATORS}]"))
            & (
                ~F.rlike(line, F.lit(f"[{CLAUSE_MARKS}]"))
                | (F.size(F.array_distinct(hashes)) * 100 < n * rules.distinct_percent)
            )
        )
    )
    navigation = (
        F.contains(line, F.lit("|"))
        & (bars >= rules.bars)
        & (bars * 100 > n * rules.bar_percent)
    ) | (
        # All separators but the slash lie outside ASCII, and take more than one byte.
        (F.contains(line, F.lit("/")) | (F.octet_length(line) > F.length(line)))
        & F.rlike(line, F.lit(SEPARATORS))
        & F.rlike(line, F.lit(r"\p{L}{2}"))
        & (separators >= rules.bars)
        & (separators * 100 > n * rules.bar_percent)
    )

    def has_phrase(lowered: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(lowered, F.lit(phrase))
        return found

    furniture = (n <= rules.furniture_words) & bind(F.lower(line), has_phrase)
    return punctuation | navigation | furniture


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _covered(keys: Column) -> Column:
    """Words that lie in a window whose key occurs twice or more, of the keys of all windows."""

    def of_positions(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: F.coalesce(F.get(ordered, i - 1)["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["k"] == x["k"], F.lit(False)),
        )
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
            lambda a, p: F.struct(
                p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")
            ),
            lambda a: a["total"],
        )

    ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return bind(ordered, of_positions)


def _line_measures(line: Column, rules: Rules) -> Column:
    symbols = F.when(F.rlike(line, F.lit(f"[{SYMBOLS}]")), count_of(line, SYMBOLS)).otherwise(
        F.lit(0)
    )
    measured = bind(
        words(line),
        lambda w: F.struct(
            F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"),
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            symbols.alias("symbols"),
        ),
    )
    return bind(
        measured,
        lambda m: F.struct(
            line.alias("line"),
            m["hashes"].alias("hashes"),
            m["chars"].alias("chars"),
            m["symbols"].alias("symbols"),
            _line_fails(line, m["n"], m["chars"], m["symbols"], m["hashes"], rules).alias(
                "fails"
            ),
        ),
    )


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``judged``, named free of clashes.

    Its fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_failed_lines``, ``kept_chars``, ``base_failed``, ``kept`` and ``cleaned``, the text
    without its failing lines. A null or empty text has no words and fails the base rule; a
    repeated row is judged like the first; ties cannot occur; an empty table gives no rows.

    Windows of eight words are compared by 64-bit hashes built by doubling (words, pairs, fours,
    eights), so the work is linear in the words; positions are sorted only where a window repeats.
    Each step is a column of its own, which keeps Spark from computing it once per mention.
    """
    lines, tokens, said, fours, keys, total, n, repeated = (
        fresh_name(docs, f"{name}_")
        for name in ("lines", "tokens", "said", "fours", "keys", "total", "n", "repeated")
    )
    outer = fresh_name(docs, "judged")

    def doubled(values: Column, by: int) -> Column:
        return F.zip_with(values, _shifted(values, by), lambda x, y: F.xxhash64(x, y))

    ended = F.greatest(F.size(tokens) - WINDOW + 1, F.lit(0))
    repeats = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
        _covered(F.col(keys))
    )
    kept = F.filter(lines, lambda x: ~x["fails"])
    sums = F.aggregate(
        lines,
        F.struct(*[F.lit(0).cast("long").alias(x) for x in ("chars", "symbols", "kept", "failed")]),
        lambda a, x: F.struct(
            (a["chars"] + x["chars"]).alias("chars"),
            (a["symbols"] + x["symbols"]).alias("symbols"),
            (a["kept"] + F.when(x["fails"], 0).otherwise(x["chars"])).alias("kept"),
            (a["failed"] + F.when(x["fails"], 1).otherwise(0)).alias("failed"),
        ),
    )
    b = F.col(total)
    base_failed = (F.col(n) < rules.least_words) | (
        F.col(repeated) * 100 > F.col(n) * rules.repeat_percent
    )
    lost = (b["chars"] - b["kept"]) * 100 > b["chars"] * rules.lost_percent
    return (
        docs.withColumn(
            lines,
            F.transform(F.split(whole(text), "\n", -1), lambda line: _line_measures(line, rules)),
        )
        .withColumn(tokens, F.flatten(F.transform(lines, lambda x: x["hashes"])))
        .withColumn(
            said, F.transform(F.filter(lines, lambda x: x["chars"] > 0), lambda x: x["line"])
        )
        .withColumn(fours, doubled(F.col(tokens), 1))
        .withColumn(fours, doubled(F.col(fours), 2))
        .withColumn(keys, F.slice(doubled(F.col(fours), 4), F.lit(1), ended))
        .withColumn(total, sums)
        .withColumn(n, F.size(tokens).cast("long"))
        .withColumn(repeated, repeats.cast("long"))
        .withColumn(
            outer,
            F.struct(
                F.col(n).alias("n_words"),
                b["chars"].alias("word_chars"),
                b["symbols"].alias("n_symbols"),
                (F.size(said) - F.size(F.array_distinct(said))).cast("long").alias("n_dup_lines"),
                F.col(repeated).alias("n_repeat_words"),
                b["failed"].alias("n_failed_lines"),
                b["kept"].alias("kept_chars"),
                base_failed.alias("base_failed"),
                (~base_failed & ~lost).alias("kept"),
                F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("cleaned"),
            ),
        )
        .drop(lines, tokens, said, fours, keys, total, n, repeated)
    )


def clean(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that stay, without their failing lines, in the columns of ``docs``.

    ``n_chars``, where there is one, follows the text.
    """
    verdict = judge(docs, rules, text)
    judged = verdict.columns[-1]
    # A row number in the condition keeps the optimizer from moving the filter below the measures,
    # where each of them would be computed once more for every mention.
    row = fresh_name(verdict, "row_")
    kept = (
        verdict.withColumn(row, F.monotonically_increasing_id())
        .filter(F.col(f"{judged}.kept") & (F.col(row) >= 0))
        .drop(row)
        .withColumn(text, F.col(f"{judged}.cleaned"))
    )
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return kept.drop(judged)
