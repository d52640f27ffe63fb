"""Licences of files: headers and licence files against templates, then by directory.

Column expressions, joins and sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.licence_templates import TEMPLATES
from panelcast.llm.text import bind, lower_ascii, whole
from panelcast.sources.scratch import Scratch

MARKER = (
    r"(?i)licen[cs]e|copyright|copyleft|redistribut|permission is hereby|public domain|spdx"
    r"|creative commons|cc0|\bcc[ -]by"
)
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# What begins a comment line, what is taken off every line, and what parts blocks of lines.
COMMENT = r"^[\x20\t]*(?:[#*;%]|//|/\*|--|<!--)"
LEADER = r"^[\x20\t#*;%/!<>-]+"
GAP = r"\n(?:[\x20\t\r]*\n)+"
RUN_END = r"\n\n+"
SPDX = r"spdx-license-identifier:[\x20\t(]*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
LEAST_COSINE = 0.7
LEAST_MARGIN = 0.01
COMMON = 0.3
DIGITS = 6


def template_rows(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("line"))
        for i, (name, text) in enumerate(templates)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _terms(line: str) -> Column:
    """Words and numbers; an identifier after the SPDX tag is one term with it."""
    plain = F.regexp_replace(lower_ascii(F.col(line)), SPDX, "spdx-")
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def _headers(text: Column, is_licence_file: Column) -> Column:
    """What states a licence, without the signs of comments: every marked line, alone, with the next,
    and with both its neighbours; marked runs of comment lines, and the parts of these between blank
    comment lines; the whole text of a licence file and its marked blocks."""
    marked = lambda x: F.rlike(x, F.lit(MARKER))
    plain = lambda x: F.regexp_replace(x, LEADER, "")
    # A line that is no comment is empty, and a blank comment line is not.
    remark = lambda x: F.when(
        F.rlike(x, F.lit(COMMENT)), F.concat(F.lit(" "), plain(x))
    ).otherwise(F.lit(""))
    none = F.array().cast("array<string>")

    def around(lines: Column) -> Column:
        def beside(x: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            return F.when(
                marked(x),
                F.array(
                    x, F.concat_ws("\n", x, after), F.concat_ws("\n", F.get(lines, i - 1), x, after)
                ),
            ).otherwise(none)

        return F.flatten(F.transform(lines, beside))

    def blocks(joined: Column, *ends: str) -> Column:
        return F.filter(F.concat(*[F.split(joined, end, -1) for end in ends]), marked)

    raw = F.split(text, "\n", -1)
    remarks = F.array_join(F.transform(raw, remark), "\n")
    whole_file = lambda x: F.concat(F.array(x), blocks(x, GAP))
    found = F.concat(
        bind(F.transform(raw, plain), around),
        bind(remarks, lambda x: blocks(x, RUN_END, GAP)),
        F.when(
            is_licence_file, bind(F.array_join(F.transform(raw, plain), "\n"), whole_file)
        ).otherwise(none),
    )
    trimmed = F.transform(found, lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.when(marked(text), F.array_distinct(trimmed)).otherwise(none)


def _counted(units: DataFrame, key: str) -> DataFrame:
    """``(key, term, tf)`` of the terms of ``line``."""
    return (
        units.select(key, F.explode(_terms("line")).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, ``(name, depth)``, the empty top included."""
    parts = F.split(directory, "/", -1)
    upto = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n), "/").alias("name"), n.alias("depth")
        ),
    )
    top = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("depth")))
    return F.when(directory == "", top).otherwise(F.concat(top, upto))


def scan_licenses(
    files: DataFrame,
    scratch: Scratch,
    templates: list[tuple[str, str]] = TEMPLATES,
    least_cosine: float = LEAST_COSINE,
    least_margin: float = LEAST_MARGIN,
) -> DataFrame:
    """``file_id, path, own_license, score, license, found_in`` for every row ``(file_id, path,
    text)`` of ``files``.

    Every line of a text that mentions licensing is a header, alone and with its neighbours; so is every
    run of comment lines with such a line, and the whole text of a licence file and its blocks. A header's
    best template by the cosine of TF-IDF vectors (ties to the smaller name) is the file's own licence if
    the cosine reaches ``least_cosine`` and is by ``least_margin`` above that of any other licence.
    Document frequencies are counted over all headers of all files and the templates; a term of the
    templates weighs the more the fewer licences use it. A file without a licence takes that of the
    nearest directory above it (its own first) with a licence file, of several the one that scores
    best; ``found_in`` is the directory. Null texts and paths count as empty: no header, and the top
    directory. Repeated rows come out repeated; without headers nothing is found; an empty table
    gives no rows.

    Equal headers are counted and compared once, however many files hold them; directories are
    resolved once each.
    """
    spark = files.sparkSession
    named = files.select(
        "file_id",
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        whole("text").alias("text"),
    )
    is_licence_file = F.rlike(F.col("path"), F.lit(LICENCE_FILE))
    found = scratch.save(
        named.select(
            "file_id",
            "path",
            parent(F.col("path")).alias("directory"),
            is_licence_file.alias("is_licence_file"),
            F.transform(
                _headers(F.col("text"), is_licence_file),
                lambda x: F.struct(F.sha2(x, 256).alias("unit"), x.alias("line")),
            ).alias("headers"),
        ),
        "headers",
    )
    units = scratch.save(
        found.select(F.explode("headers").alias("h"))
        .select("h.*")
        .groupBy("unit")
        .agg(F.any_value("line").alias("line"), F.count("*").alias("copies")),
        "units",
    )
    best = scratch.save(
        _best_templates(spark, units, templates, least_cosine, least_margin), "best"
    )
    own = (
        found.select("file_id", "path", F.explode("headers.unit").alias("unit"))
        .join(best, "unit")
        .groupBy("file_id", "path")
        .agg(F.max(F.struct("score", "rank", "license")).alias("own"))
        .select(F.col("file_id").alias("own_id"), F.col("path").alias("own_path"), "own")
    )
    same = F.col("file_id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path"))
    judged = scratch.save(
        found.join(own, same, "left").select(
            "file_id",
            "path",
            "directory",
            "is_licence_file",
            F.col("own.license").alias("own_license"),
            F.col("own.score").alias("score"),
            F.col("own.rank").alias("rank"),
        ),
        "judged",
    )
    stated = (
        judged.filter("is_licence_file AND own_license IS NOT NULL")
        .groupBy("directory")
        .agg(F.max(F.struct("score", "rank", "own_license")).alias("best"))
        .select(F.col("directory").alias("name"), F.col("best.own_license").alias("license"))
    )
    inherited = (
        judged.select("directory")
        .distinct()
        .select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
        .select("directory", "above.name", "above.depth")
        .join(stated, "name")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "name", "license")).alias("nearest"))
    )
    return judged.join(inherited, "directory", "left").select(
        "file_id",
        "path",
        "own_license",
        "score",
        F.coalesce("own_license", "nearest.license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("nearest.name")).alias("found_in"),
    )


def _best_templates(
    spark: SparkSession,
    units: DataFrame,
    templates: list[tuple[str, str]],
    least_cosine: float,
    least_margin: float,
) -> DataFrame:
    """``unit, license, score, rank`` of the headers that reach the cosine and the margin.

    The templates, and with them their postings, are a parameter of a few hundred rows at most: these
    alone are broadcast.
    """
    given = template_rows(spark, templates)
    in_units, in_templates = _counted(units, "unit"), _counted(given, "template")
    seen = (
        in_units.join(units.select("unit", "copies"), "unit")
        .groupBy("term")
        .agg(F.sum("copies").alias("df"))
        .unionByName(in_templates.groupBy("term").agg(F.count("*").alias("df")))
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    total = units.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] + len(templates)
    n_licenses = len({name for name, _ in templates})
    users = (
        in_templates.join(F.broadcast(given.select("template", "license")), "template")
        .groupBy("term")
        .agg(F.count_distinct("license").alias("users"))
    )
    telling = F.coalesce(F.log(F.lit(n_licenses + 1) / (F.col("users") + 1)) + COMMON, F.lit(1.0))
    idf = seen.join(F.broadcast(users), "term", "left").select(
        "term", ((F.log(F.lit(total + 1) / (F.col("df") + 1)) + 1) * telling).alias("idf")
    )
    weigh = F.col("tf") * F.col("idf")
    unit_weights = in_units.join(idf, "term").select("unit", "term", weigh.alias("w"))
    template_weights = idf.join(F.broadcast(in_templates), "term").select(
        "template", "term", weigh.alias("tw")
    )
    template_norms = template_weights.groupBy("template").agg(
        F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm")
    )
    norms = unit_weights.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        unit_weights.join(F.broadcast(template_weights), "term")
        .groupBy("unit", "template")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), DIGITS)
    scored = (
        dots.join(norms, "unit")
        .join(F.broadcast(template_norms), "template")
        .join(F.broadcast(given.select("template", "license")), "template")
        .select("unit", "license", cosine.alias("score"), (-F.col("template")).alias("rank"))
        .filter(F.col("score") >= least_cosine - least_margin)
        .groupBy("unit", "license")
        .agg(F.max(F.struct("score", "rank")).alias("top"))
        # At most one entry per licence.
        .groupBy("unit")
        .agg(F.sort_array(F.collect_list(F.struct("top.*", "license")), asc=False).alias("best"))
    )
    best, second = F.col("best")[0], F.coalesce(F.get("best", F.lit(1))["score"], F.lit(0.0))
    clear = F.round(best["score"] - second, DIGITS) >= least_margin
    return scored.filter((best["score"] >= least_cosine) & clear).select(
        "unit", best["license"].alias("license"), best["score"].alias("score"), best["rank"].alias("rank")
    )
