"""Catalogue: trained language models, profiles that are kept and merged, and keyed checks in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import language, profiles, rules, shared, text
from ..operators.contaminate import copy_from_donor, picked
from .base import findings, query, s_blank, s_finding, s_picked, table
from .texts import SNIPPETS, labelled, snippets

LANGS = list(text.STOP_WORDS)
CODE_LANGS = ["javascript", "python", "sql"]


def s_scores(rows: str, langs: list[str], fold: str) -> str:
    """CTEs that end in ``told(row_id, declared, guess, score, lead, grams)`` for a select of ``row_id, declared, body``."""
    listed = ", ".join(f"('{lang}', {i})" for i, lang in enumerate(langs))
    bare = f"trim(regexp_replace(lower(coalesce(body, '')), '{fold}', ' ', 'g'))"
    mix, buckets = language.MIX, language.BUCKETS
    return f"""
langs AS (SELECT * FROM (VALUES {listed}) AS v(lang, place)),
src AS ({rows}),
chars AS (SELECT row_id, declared, list_transform(string_split(' ' || {bare} || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM src WHERE {bare} <> ''),
grams AS (SELECT row_id, declared, unnest(list_transform(range(1, len(c) - 1), lambda i: ((c[i] * {mix} + c[i + 1]) * {mix} + c[i + 2]) % {buckets})) AS b FROM chars),
n AS (SELECT row_id, declared, b, count(*) AS n FROM grams GROUP BY ALL),
m AS (SELECT declared AS lang, b, sum(n) AS c FROM n GROUP BY ALL),
k AS (SELECT lang, place, coalesce((SELECT sum(c) FROM m WHERE m.lang = langs.lang), 0) AS t FROM langs),
o AS (SELECT row_id, sum(n) AS grams FROM n GROUP BY 1),
own AS (SELECT n.*, o.grams, k.lang, k.place, k.t, coalesce(n.declared = k.lang, false) AS is_own FROM n JOIN o USING (row_id) CROSS JOIN k),
s AS (SELECT own.row_id, own.declared, own.lang, own.place, any_value(own.grams) AS grams, CAST(sum(own.n * floor({language.UNIT} * ln(
        (coalesce(m.c, 0) - CASE WHEN is_own THEN own.n ELSE 0 END + 1.0) / (own.t - CASE WHEN is_own THEN own.grams ELSE 0 END + {buckets}.0)) + 0.5)) AS BIGINT) AS score
      FROM own LEFT JOIN m ON m.lang = own.lang AND m.b = own.b GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS lead FROM s WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, place)),
told AS (SELECT row_id, declared, lang AS guess, score, CAST(lead AS BIGINT) AS lead, CAST(grams AS BIGINT) AS grams FROM r WHERE rank = 1)"""


_DOCS = f"""SELECT c.doc_id AS row_id, c.text AS body, CASE WHEN {s_picked('c.doc_id', 'donor:lang', 0.1)} THEN coalesce(o.lang, c.lang) ELSE c.lang END AS declared
           FROM documents c LEFT JOIN documents o ON o.doc_id = c.doc_id - 1"""


def mislabelled(spark, sf):
    """Documents, a tenth of them with the language of the document before."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return copy_from_donor(docs, "lang", 1, "doc_id", 0.1)[0]


@query("language_scores", f"""
WITH {s_scores(_DOCS, LANGS, language.PROSE)}
SELECT CAST(d.doc_id AS BIGINT) AS row_id, guess, score, lead, coalesce(grams, 0) AS grams FROM documents d LEFT JOIN told ON told.row_id = d.doc_id
""")
def language_scores(spark, sf):
    """Likeliest language of every document by a model of all documents but itself, labels as they are."""
    docs = mislabelled(spark, sf)
    model = language.fit_language_model(docs, "text", "lang", LANGS)
    told = language.with_language_scores(docs, "text", model, "told", "lang")
    return told.select(F.col("doc_id").cast("bigint").alias("row_id"), F.col("told.lang").alias("guess"), "told.score", "told.lead", "told.grams")


_CLEAR = "grams >= 20 AND lead >= 5000000 AND guess <> declared"


@query("language_mismatch_model", f"""
WITH {s_scores(_DOCS, LANGS, language.PROSE)}
SELECT {s_finding('row_id', 'text', 'inconsistent_value', 'guess AS observed, declared AS expected')} FROM told WHERE {_CLEAR}
""")
def language_mismatch_model(spark, sf):
    docs = mislabelled(spark, sf)
    model = language.fit_language_model(docs, "text", "lang", LANGS)
    judged = language.with_model_language(docs, "text", model, counted_as="lang")
    return findings(rules.run_rules(judged, [text.language_mismatch("text", "lang")], "doc_id"), "observed", "expected")


_CODE = f"""SELECT c.event_id AS row_id, c.body, CASE WHEN {s_picked('c.event_id', 'donor:language', 0.1)} THEN coalesce(o.lang, c.lang) ELSE c.lang END AS declared
  FROM code c LEFT JOIN code o ON o.event_id = c.event_id - 1"""
_BODIES = " ".join(f"WHEN '{lang}' THEN '{body}'" for lang, body in SNIPPETS.items())


@query("code_language_model", f"""
WITH kinds AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'javascript' WHEN event_type = 'purchase' THEN 'sql' ELSE 'python' END AS lang FROM events),
code AS (SELECT event_id, lang, CASE lang {_BODIES} END AS body FROM kinds),
{s_scores(_CODE, CODE_LANGS, language.CODE)}
SELECT {s_finding('row_id', 'code', 'inconsistent_value', 'guess AS observed, declared AS expected')} FROM told WHERE {_CLEAR}
""")
def code_language_model(spark, sf):
    made = snippets(spark, sf)
    model = language.fit_language_model(made, "code", "language", CODE_LANGS, language.CODE)
    judged = language.with_model_language(made, "code", model, counted_as="language")
    return findings(rules.run_rules(judged, [text.language_mismatch("code", "language")], "event_id"), "observed", "expected")


# --- profiles per day, merged -----------------------------------------------------------------------------------------

PROFILED = ["value", "user_id", "event_type", "props"]


def by_day(spark, sf):
    """Events under their day; a third of the values is missing on one day, and from another day on they are half as large again."""
    day = F.date_format("ts", "yyyy-MM-dd")
    lost = (day == "2024-01-12") & (F.col("event_id") % 3 == 0)
    value = F.when(~lost, F.when(day >= "2024-01-25", F.col("value") * 1.5).otherwise(F.col("value")))
    return table(spark, sf, "events").select(day.alias("day"), value.alias("value"), *PROFILED[1:])


_DAYS = """days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, value AS was, user_id, event_type, props FROM events),
e AS (SELECT *, CASE WHEN day = '2024-01-12' AND event_id % 3 = 0 THEN NULL WHEN day >= '2024-01-25' THEN was * 1.5 ELSE was END AS value FROM days),
v AS (SELECT day, 'value' AS col, CAST(value AS DOUBLE) AS x, value IS NULL AS gone FROM e
  UNION ALL SELECT day, 'user_id', CAST(user_id AS DOUBLE), user_id IS NULL FROM e
  UNION ALL SELECT day, 'event_type', NULL, event_type IS NULL OR NOT regexp_matches(event_type, '\\S') FROM e
  UNION ALL SELECT day, 'props', NULL, props IS NULL OR NOT regexp_matches(props, '\\S') FROM e)"""
_SUMS = """count(*) AS n_rows, count_if(gone) AS n_missing, count(x) AS n, CAST(sum(CAST(x AS DECIMAL(18,6))) AS DOUBLE) AS t,
  CAST(sum(CAST(x AS DECIMAL(18,6)) * CAST(x AS DECIMAL(18,6))) AS DOUBLE) AS q"""


@query("profile_merged", f"""
WITH {_DAYS}, s AS (SELECT col, {_SUMS}, min(x) AS low, max(x) AS high FROM v GROUP BY 1)
SELECT col, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_missing AS BIGINT) AS n_missing, CAST(n AS BIGINT) AS n_numbers, low, high,
  CASE WHEN n > 0 THEN round(t / n, 4) END AS mean, CASE WHEN n > 1 THEN round(sqrt(greatest((q - t * t / n) / (n - 1), 0)), 4) END AS sd FROM s
""")
def profile_merged(spark, sf):
    """Profile of all events out of the profiles of their days; the sketches' estimates are tested apart."""
    states = profiles.profile_states(by_day(spark, sf), PROFILED, F.col("day"))
    read = profiles.read_states(profiles.merge_states(states))
    return read.select("col", "n_rows", "n_missing", "n_numbers", "low", "high", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("profile_drift", f"""
WITH {_DAYS}, s AS (SELECT day, col, {_SUMS} FROM v GROUP BY 1, 2),
w AS (SELECT *, sum(n_rows) OVER b AS pr, sum(n_missing) OVER b AS pm, sum(n) OVER b AS pn, sum(t) OVER b AS pt, sum(q) OVER b AS pq, count(*) OVER b AS parts
      FROM s WINDOW b AS (PARTITION BY col ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT day, col, 'mean' AS measure, t / n AS value, pt / pn AS expected,
        abs(t / n - pt / pn) > 3 * sqrt(greatest((pq - pt * pt / pn) / (pn - 1), 0)) / sqrt(n) AS bad FROM w WHERE parts >= 3 AND n > 0 AND pn > 1
  UNION ALL SELECT day, col, 'missing', n_missing / n_rows, pm / pr, abs(n_missing / n_rows - pm / pr) > 0.05 FROM w WHERE parts >= 3
  UNION ALL SELECT day, col, 'rows', n_rows, pr / parts, n_rows < 0.5 * pr / parts FROM w WHERE parts >= 3)
SELECT day AS part, col, measure, round(CAST(value AS DOUBLE), 4) AS value, round(CAST(expected AS DOUBLE), 4) AS expected FROM j WHERE bad
""")
def profile_drift(spark, sf):
    states = profiles.profile_states(by_day(spark, sf), PROFILED, F.col("day"))
    told = profiles.drifted(states)
    return told.select("part", "col", "measure", F.round("value", 4).alias("value"), F.round("expected", 4).alias("expected"))


# --- keyed checks in one pass -----------------------------------------------------------------------------------------

def recopied(spark, sf):
    """Labelled documents and, under new ids, a tenth of them again: toxic turned over, and half of those restyled."""
    docs = labelled(spark, sf).select("doc_id", "text", "quality", "toxic")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    # Copies are made from the joined row, so the texts are joined with their labels once.
    as_copy = lambda new: F.struct((F.col("doc_id") + (last + 1 if new else 0)).alias("doc_id"), F.lit(new).alias("new"))
    both = F.when(picked(F.col("doc_id"), "copy", 0.1), F.array(as_copy(False), as_copy(True))).otherwise(F.array(as_copy(False)))
    dirty = docs.withColumn("__as", F.explode(both))
    new, restyled = F.col("__as.new"), F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("!!"))
    return dirty.select(
        "__as.doc_id", F.when(new & (F.col("quality") == 1), restyled).otherwise(F.col("text")).alias("text"), "quality",
        F.when(new, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"), F.length("text").alias("n_chars"),
    )


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _s_copies(key: str, col: str, rule: str, where: str = "true") -> str:
    return f"""SELECT doc_id, '{col}' AS col, 'duplicate_row' AS issue_type, '{rule}' AS rule_id, NULL AS observed, CAST(f AS VARCHAR) AS expected
  FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {key}) AS f FROM d WHERE {where}) WHERE doc_id > f"""


def _s_conflict(label: str) -> str:
    return f"""SELECT doc_id, '{label}', 'inconsistent_value', 'label_conflict', CAST({label} AS VARCHAR), NULL
  FROM (SELECT *, min({label}) OVER (PARTITION BY text) <> max({label}) OVER (PARTITION BY text) AS mixed FROM d WHERE text IS NOT NULL) WHERE mixed"""


_GIVEN = f"NOT {s_blank('text')}"


@query("keyed_in_one_pass", f"""
WITH l AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
c AS (SELECT doc_id, false AS new, text, quality, toxic FROM l UNION ALL
      SELECT doc_id + (SELECT max(doc_id) + 1 FROM l), true, text, quality, toxic FROM l WHERE {s_picked('doc_id', 'copy', 0.1)}),
d AS (SELECT doc_id, CASE WHEN new AND quality = 1 THEN replace(text, ' ', '  ') || '!!' ELSE text END AS text, quality,
        CASE WHEN new THEN 1 - toxic ELSE toxic END AS toxic, length(text) AS n_chars FROM c),
found AS ({_s_copies('text, quality, toxic', 'text', 'duplicate_row')}
  UNION ALL {_s_copies('n_chars, quality', 'n_chars', 'duplicate_key:n_chars,quality', 'n_chars IS NOT NULL AND quality IS NOT NULL')}
  UNION ALL {_s_copies('text', 'text', 'duplicate_text:text', _GIVEN)}
  UNION ALL {_s_copies(_NORMAL, 'text', 'duplicate_text:text', _GIVEN)}
  UNION ALL SELECT doc_id, 'text', 'inconsistent_value', 'copied_response', NULL, CAST(f AS VARCHAR)
    FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS f, first_value(toxic) OVER (PARTITION BY text ORDER BY doc_id) AS p FROM d WHERE {_GIVEN})
    WHERE doc_id > f AND toxic IS DISTINCT FROM p
  UNION ALL {_s_conflict('quality')} UNION ALL {_s_conflict('toxic')})
SELECT CAST(doc_id AS BIGINT) AS row_id, col, issue_type, rule_id, observed, expected FROM found
""")
def keyed_in_one_pass(spark, sf):
    checks = [
        shared.duplicate_row("text", ["text", "quality", "toxic"]), shared.duplicate_key(["n_chars", "quality"]),
        shared.duplicate_text("text"), shared.duplicate_text("text", normalise=True), shared.copied_response("toxic", "text"),
        *shared.label_conflict(F.col("text"), ["quality", "toxic"]),
    ]
    return findings(shared.run_keyed(recopied(spark, sf), checks, "doc_id"), "rule_id", "observed", "expected")
