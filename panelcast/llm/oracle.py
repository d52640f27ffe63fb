"""The SQL that the numbered queries are checked by, where SQL can state them."""

from __future__ import annotations

from panelcast.llm.licence_templates import TEMPLATES
from panelcast.llm.licenses import COMMENT, GAP, LEADER, RUN_END, SPDX, TERM
from panelcast.llm.quality import BOILERPLATE, CLAUSE_MARKS, SYMBOLS, TERMINATORS
from panelcast.llm.url_filter import RULES, SOFT, STRICT

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TERM_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _count(column: str, characters: str) -> str:
    counted = column
    for character in characters:
        counted = f"replace({counted}, '{character}', '')"
    return f"(length({column}) - length({counted}))"


def _plain_count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


# Separators besides the bar. Patterns here cannot look around: letters and spaces are doubled, so
# that each separator has neighbours of its own, and dots between two letters are subtracted.
LETTERS_DOUBLED = r"regexp_replace(line, '(\p{L})', '\1\1', 'g')"
SPACES_DOUBLED = rf"regexp_replace(' ' || line || ' ', '({SPACE_CLASS})', '\1\1', 'g')"
OTHER_SEPARATORS = (
    f"({_plain_count('line', '[»›→▸▶❯•‣∙⋅·]')}"
    + f" - {_plain_count(LETTERS_DOUBLED, r'\p{L}·\p{L}')}"
    + f" + {_plain_count(SPACES_DOUBLED, f'{SPACE_CLASS}/{SPACE_CLASS}')})"
)
ALL_SEPARATORS = f"""({_count("line", "|")} + {OTHER_SEPARATORS} - {_count("line", "«‹")})"""

PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
starts AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS k FROM starts),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM windows)
          WHERE n >= 2),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(8) AS o(j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
measured AS (SELECT r, line, regexp_extract_all(line, '{WORD}') AS said,
                    length(regexp_replace(line, '{SPACE_CLASS}', '', 'g')) AS chars FROM lines),
told AS (SELECT *, len(said) AS n FROM measured),
judged AS (SELECT *,
    {_count("line", SYMBOLS)} * 10 > chars
    OR ((length(line) - length(replace(line, '!!', ''))) // 2 >= 2
        AND (length(line) - length(replace(line, '!!', ''))) // 2 * 5 > n)
    OR (n >= 30 AND NOT regexp_matches(line, '[{TERMINATORS}]')
        AND (NOT regexp_matches(line, '[{CLAUSE_MARKS}]') OR len(list_distinct(said)) * 2 < n))
    OR ({_count("line", "|")} >= 3 AND {_count("line", "|")} * 5 > n)
    OR ({OTHER_SEPARATORS} > 0 AND regexp_matches(line, '\p{{L}}{{2}}')
        AND {ALL_SEPARATORS} >= 3 AND {ALL_SEPARATORS} * 5 > n)
    OR (n <= 30 AND ({PHRASES})) AS fails FROM told),
per AS (SELECT r, CAST(sum(chars) AS BIGINT) AS word_chars,
    CAST(sum(CASE WHEN fails THEN 0 ELSE chars END) AS BIGINT) AS kept_chars,
    count(*) FILTER (WHERE fails) AS n_failed_lines,
    count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0)
        AS n_dup_lines
    FROM judged GROUP BY r),
base AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, word_chars,
    CAST({_count("text", SYMBOLS)} AS BIGINT) AS n_symbols, n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, n_failed_lines, kept_chars
    FROM w JOIN per USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND (word_chars - kept_chars) * 100 <= word_chars * 30 AS kept FROM failed
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_choice(field: str) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r.name))
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}'))"
        f" AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'"
        for r in longest_first
    )
    return f"CASE {cases} END"


def _hits(terms: list[str]) -> str:
    return " + ".join(
        f"CAST(regexp_matches(lowered, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms
    )


OP6 = f"""
WITH parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')
        AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS lowered FROM pages),
counted AS (SELECT *, {_hits(STRICT)} AS n_strict, {_hits(SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, {_rule_choice("name")} AS rule, n_strict, n_soft,
    coalesce({_rule_choice("verdict")},
             CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM counted
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
          AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
    FROM d GROUP BY source),
limits AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS most,
    CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s),
prefixes AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(most) OVER (ORDER BY ratio, source ASC NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM limits),
shares AS (SELECT *, max(CASE WHEN share <= ratio THEN share END) OVER () AS level FROM prefixes),
aims AS (SELECT source, source_size, least(most, level * weight) AS target FROM shares),
plan AS (SELECT *,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    CASE WHEN source_size > 0
         THEN target / source_size - floor(target / source_size) ELSE 0.0 END AS part FROM aims),
classes AS (SELECT source, CAST(length(bin(size)) AS BIGINT) AS digits, sum(size) AS words
    FROM d WHERE size > 0 GROUP BY ALL),
falling AS (SELECT c.source, digits, greatest((target - whole * source_size
    - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY digits DESC
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(digits * words) OVER (PARTITION BY c.source ORDER BY digits DESC
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS level
    FROM classes AS c JOIN plan AS p ON c.source IS NOT DISTINCT FROM p.source AND part > 0),
levels AS (SELECT source, max(level) AS level FROM falling WHERE level * digits <= 1 GROUP BY source),
leveled AS (SELECT p.*, coalesce(level, 0.0) AS level
    FROM plan AS p LEFT JOIN levels AS l ON p.source IS NOT DISTINCT FROM l.source),
chances AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing,
    CASE WHEN size > 0 THEN least(1.0, level * length(bin(size))) ELSE 0.0 END AS p
    FROM d JOIN leveled AS p ON d.source IS NOT DISTINCT FROM p.source),
ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0.0
    WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM chances),
summed AS (SELECT *, odds IS NOT NULL AND
    sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, doc_id, size) <= missing
    AS sampled FROM ranked),
gaps AS (SELECT source, any_value(missing) - coalesce(sum(size) FILTER (WHERE sampled), 0) AS open
    FROM summed GROUP BY source),
keys AS (SELECT source, odds, doc_id, size, sum(size) AS words FROM summed
    WHERE odds IS NOT NULL AND NOT sampled GROUP BY ALL),
firsts AS (SELECT k.*, open, row_number() OVER (PARTITION BY k.source, size ORDER BY odds, doc_id)
    AS place FROM keys AS k JOIN gaps AS g ON k.source IS NOT DISTINCT FROM g.source AND size <= open),
f1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS nr FROM firsts
    WHERE place = 1 AND words <= open),
f2 AS (SELECT f.* REPLACE (a.open - a.words AS open,
    row_number() OVER (PARTITION BY f.source ORDER BY f.size DESC) AS nr)
    FROM (SELECT *, 0 AS nr FROM firsts WHERE place = 1) AS f
    JOIN f1 AS a ON f.source IS NOT DISTINCT FROM a.source AND a.nr = 1
    WHERE f.size < a.size AND f.words <= a.open - a.words),
f3 AS (SELECT f.* REPLACE (a.open - a.words AS open,
    row_number() OVER (PARTITION BY f.source ORDER BY f.size DESC) AS nr)
    FROM (SELECT *, 0 AS nr FROM firsts WHERE place = 1) AS f
    JOIN f2 AS a ON f.source IS NOT DISTINCT FROM a.source AND a.nr = 1
    WHERE f.size < a.size AND f.words <= a.open - a.words),
fills AS (SELECT source, doc_id, size, true AS filled FROM (
    FROM f1 UNION ALL BY NAME FROM f2 UNION ALL BY NAME FROM f3) WHERE nr = 1),
chosen AS (SELECT s.*, whole + CASE WHEN sampled OR filled THEN 1 ELSE 0 END AS copies
    FROM summed AS s LEFT JOIN fills AS f ON s.source IS NOT DISTINCT FROM f.source
        AND s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.size = f.size)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM chosen
"""


GIVEN = ", ".join(
    "({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
    for i, (name, text) in enumerate(TEMPLATES)
)
N_LICENSES = len({name for name, _ in TEMPLATES})


def _license_terms(line: str) -> str:
    lowered = f"translate({line}, '{UPPER}', '{LOWER}')"
    return f"regexp_extract_all(regexp_replace({lowered}, '{SPDX}', 'spdx-', 'g'), '{TERM}')"


LINE_MARKER = r"(?i)licen[cs]e|copyright|copyleft|redistribut|permission is hereby|public domain|spdx|creative commons|cc0|\bcc[ -]by"

OP8 = f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, length(text) <= 300 AS is_file,
    concat_ws('/', source, lang, CASE WHEN length(text) <= 300 AND doc_id % 2 = 0 THEN NULL
        ELSE CAST(doc_id // 64 AS VARCHAR) END) AS directory,
    CASE WHEN length(text) <= 300 THEN 'LICENSE.' ELSE 'text.' END || doc_id AS name
    FROM documents),
m AS (SELECT doc_id, is_file,
    list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{LEADER}', '')) AS lines,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x:
        CASE WHEN regexp_matches(x, '{COMMENT}') THEN ' ' || regexp_replace(x, '{LEADER}', '') ELSE '' END),
        chr(10)) AS remarks
    FROM f WHERE regexp_matches(text, '{LINE_MARKER}')),
l AS (SELECT *, lines[i] AS line, CASE WHEN i > 1 THEN lines[i - 1] END AS before, lines[i + 1] AS after
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM m)
    WHERE regexp_matches(lines[i], '{LINE_MARKER}')),
h AS (SELECT DISTINCT doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM (
    SELECT doc_id, line FROM l
    UNION ALL SELECT doc_id, concat_ws(chr(10), line, after) FROM l
    UNION ALL SELECT doc_id, concat_ws(chr(10), before, line, after) FROM l
    UNION ALL SELECT doc_id, unnest(string_split_regex(remarks, '{RUN_END}')) FROM m
    UNION ALL SELECT doc_id, unnest(string_split_regex(remarks, '{GAP}')) FROM m
    UNION ALL SELECT doc_id, unnest(string_split_regex(array_to_string(lines, chr(10)), '{GAP}'))
        FROM m WHERE is_file
    UNION ALL SELECT doc_id, array_to_string(lines, chr(10)) FROM m WHERE is_file)
    WHERE regexp_matches(line, '{LINE_MARKER}')),
u AS (SELECT line, count(*) AS copies FROM h GROUP BY line),
t(template, license, line) AS (VALUES {GIVEN}),
ut AS (SELECT line, copies, term, count(*) AS tf FROM (SELECT line, copies,
    unnest({_license_terms("line")}) AS term FROM u)
    GROUP BY line, copies, term),
tt AS (SELECT template, term, count(*) AS tf FROM (SELECT template,
    unnest({_license_terms("line")}) AS term FROM t)
    GROUP BY template, term),
users AS (SELECT term, count(DISTINCT license) AS n FROM tt JOIN t USING (template) GROUP BY term),
df AS (SELECT term, sum(df) AS df FROM (SELECT term, sum(copies) AS df FROM ut GROUP BY term
    UNION ALL SELECT term, count(*) AS df FROM tt GROUP BY term) GROUP BY term),
idf AS (SELECT term, (ln(((SELECT coalesce(sum(copies), 0) FROM u) + {len(TEMPLATES)} + 1)
    / CAST(df + 1 AS DOUBLE)) + 1)
    * coalesce(ln({N_LICENSES + 1} / CAST(n + 1 AS DOUBLE)) + 0.3, 1.0) AS idf
    FROM df LEFT JOIN users USING (term)),
uw AS (SELECT line, term, tf * idf AS w FROM ut JOIN idf USING (term)),
tw AS (SELECT template, term, tf * idf AS tw FROM tt JOIN idf USING (term)),
un AS (SELECT line, sqrt(sum(w * w)) AS norm FROM uw GROUP BY line),
tn AS (SELECT template, sqrt(sum(tw * tw)) AS t_norm FROM tw GROUP BY template),
s AS (SELECT line, template, round(sum(w * tw) / (any_value(norm) * any_value(t_norm)), 6) AS score
    FROM uw JOIN tw USING (term) JOIN un USING (line) JOIN tn USING (template)
    GROUP BY line, template),
sl AS (SELECT s.line, license, max(score) AS score, arg_min(template, (-score, template)) AS template
    FROM s JOIN t USING (template) GROUP BY s.line, license),
sb AS (SELECT *, row_number() OVER w AS place, lead(score, 1, 0.0) OVER w AS second
    FROM sl WINDOW w AS (PARTITION BY line ORDER BY score DESC, template)),
best AS (SELECT doc_id, license, score, template, row_number() OVER
    (PARTITION BY doc_id ORDER BY score DESC, template) AS place
    FROM h JOIN sb USING (line)
    WHERE sb.place = 1 AND score >= 0.7 AND round(score - second, 6) >= 0.01),
j AS (SELECT f.doc_id, f.directory || '/' || f.name AS path, f.directory, f.is_file, b.license AS own_license, b.score, b.template
    FROM f LEFT JOIN best AS b ON f.doc_id = b.doc_id AND b.place = 1),
stated AS (SELECT directory, own_license, row_number() OVER
    (PARTITION BY directory ORDER BY score DESC, template) AS place FROM j
    WHERE is_file AND own_license IS NOT NULL)
SELECT doc_id, path, j.own_license, score,
    coalesce(j.own_license, s1.own_license, s2.own_license) AS license,
    CASE WHEN j.own_license IS NOT NULL THEN NULL WHEN s1.own_license IS NOT NULL THEN s1.directory
         ELSE s2.directory END AS found_in
FROM j LEFT JOIN stated AS s1 ON j.directory = s1.directory AND s1.place = 1
LEFT JOIN stated AS s2 ON regexp_extract(j.directory, '(?s)^(.*)/[^/]*$', 1) = s2.directory
    AND s2.place = 1
"""


OP11 = rf"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_RUN}') AS terms FROM documents),
d AS (SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
asked AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_RUN}')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term,
    CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, totals GROUP BY term, all_docs),
scored AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf
        + 8 * (100 - 90 + ((90 * n * all_docs) // all_terms))))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN d USING (r), totals
    GROUP BY q, item_id, doc_id, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (
    PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _added(label: str, cost: str, letters: str) -> str:
    """A label (nine digits of cost, then the audit) after an edit."""
    return (
        f"(lpad(CAST(CAST(left({label}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0')"
        f" || substr({label}, 10) || '{letters}')"
    )


def _either(*labels: str) -> str:
    return f"least({', '.join(labels)})"


def _row_step() -> str:
    """The labels of the four states (before anything, after a system, a user, an assistant row)
    behind a row, from those before it; null where a state cannot be reached."""
    inserted = {
        "b0": "s0",
        "b1": "s1",
        "b2": _either("s2", *(_added(s, "5", "I") for s in ("s0", "s1", "s3"))),
        "b3": _either("s3", _added("s2", "5", "I"), *(_added(s, "10", "II") for s in ("s0", "s1"))),
    }
    may_stay = "fault NOT IN ('blank', 'duplicate')"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"

    def stays(label: str, initial: str) -> list[str]:
        kept = f"CASE WHEN {may_stay} AND initial = '{initial}' THEN {_added(label, extra, 'K')} END"
        return [kept, f"CASE WHEN {may_stay} THEN {_added(label, f'1 + {extra}', 'R')} END"]

    before = ", ".join(f"{label} AS {name}" for name, label in inserted.items())
    user = _either(_added("b2", "2", "D"), *(x for b in ("b0", "b1", "b3") for x in stays(b, "u")))
    after = {
        "s0": _added("b0", "2", "D"),
        "s1": _either(_added("b1", "2", "D"), stays("b0", "s")[0]),
        "s2": user,
        "s3": _either(_added("b3", "2", "D"), *stays("b2", "a")),
    }
    return (
        f"SELECT c, i, {', '.join(f'{x} AS {s}' for s, x in after.items())} FROM (SELECT f.c, f.i,"
        f" fault, initial, {before} FROM p JOIN faults f ON f.c = p.c AND f.i = p.i + 1)"
    )


CRC_STEP = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"

OP13 = rf"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(b, range(8)),
        lambda x, k: {CRC_STEP}) ORDER BY b) AS t FROM range(256) AS g(b)),
named AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER () AS r,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations),
marked AS (SELECT named.*, xor(list_reduce(list_prepend(4294967295,
        list_transform(string_split(k, ''), lambda s: CAST(ord(s) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS kind
    FROM named, crc_table),
damaged AS (SELECT c, conv_id, turn,
    CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
        ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked),
placed AS (SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (SELECT *, regexp_replace(text, '{SPACE_CLASS}+$', '') AS bare,
    row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair,
    CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
    FROM placed),
p AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1,
    CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM named
    UNION ALL {_row_step()}),
best AS (SELECT c, {_either("s0", _added("s1", "10", "II"), _added("s2", "5", "I"), "s3")} AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS back FROM p) WHERE back = 1),
edits AS (SELECT c, substr(label, 10) AS audit, CAST(left(label, 9) AS BIGINT) AS cost,
    string_split(substr(label, 10), '') AS letters FROM best),
letters AS (SELECT c, unnest(letters) AS letter, unnest(range(1, len(letters) + 1)) AS nr FROM edits),
spelled AS (SELECT *, count(*) FILTER (WHERE letter IN ('D', 'K', 'R'))
        OVER (PARTITION BY c ORDER BY nr) AS i FROM letters),
made AS (SELECT s.c, nr, letter, f.role, f.text, f.initial,
        row_number() OVER (PARTITION BY s.c ORDER BY nr) AS slot
    FROM spelled s LEFT JOIN faults f ON f.c = s.c AND f.i = s.i AND letter IN ('K', 'R')
    WHERE letter != 'D'),
offsets AS (SELECT c, max(CASE WHEN slot = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END)
    AS o FROM made GROUP BY c),
repaired AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role
        WHEN (slot - o) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY nr) AS body
    FROM made JOIN offsets USING (c) GROUP BY c),
counts AS (SELECT c, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faults GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM named) LEFT JOIN counts USING (c) LEFT JOIN edits USING (c)
    LEFT JOIN repaired USING (c)
"""


def statements() -> dict[str, str]:
    return {
        "op3_quality_rules": OP3,
        "op6_url_filter": OP6,
        "op8_license_scan": OP8,
        "op7_source_mix": OP7,
        "op11_lexical_search": OP11,
        "op13_conversation_repair": OP13,
    }
