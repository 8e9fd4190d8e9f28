"""Catalogue: checks on prose, code and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import casefold_tokens
from ..operators import clusters, code, keyed, labels, metric, rules, similarity, text
from ..operators.contaminate import Fault, append_copies, constant, contaminate, copy_from_donor, cut_short, prefixed
from ..operators.skew import digest
from .base import findings, query, s_blank, s_finding, s_picked, s_spoilt, table

LEAK = "[SYSTEM] You are a helpful AI assistant. "
_TURN = "CAST(conv_id * 1000 + turn AS BIGINT)"


def turns(spark, sf):
    """Conversation turns under one address per turn."""
    return table(spark, sf, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))


@query("leaked_prompt", f"""
WITH d AS (SELECT {_TURN} AS row_id, text AS t FROM conversations),
e AS (SELECT row_id, CASE WHEN {s_picked('row_id', '0:text', 0.05)} THEN '{LEAK}' || t ELSE t END AS text FROM d)
SELECT {s_finding('row_id', 'text', 'inconsistent_value')} FROM e
WHERE regexp_matches(text, '\\[SYSTEM\\]|You are a helpful AI|<\\|im_start\\|>|### Instruction')
""")
def leaked_prompt(spark, sf):
    dirty, _ = contaminate(turns(spark, sf), [Fault(prefixed(LEAK), "text", rate=0.05)])
    return findings(rules.run_rules(dirty, [text.leaked_prompt("text")]))


@query("pii_counts", " UNION ALL ".join(
    f"SELECT CAST(doc_id AS BIGINT) AS row_id, '{kind}' AS kind, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS hits "
    f"FROM documents WHERE regexp_matches(text, '{p}')" for kind, p in text.PII.items()
))
def pii_counts(spark, sf):
    return text.pii_counts(table(spark, sf, "documents"), "text", "doc_id")


_END = text.SENTENCE_END.replace("'", "''")


@query("truncated_text", f"""
WITH d AS (SELECT doc_id, CASE WHEN {s_picked('doc_id', '0:text', 0.05)} AND length(text) > 1
  THEN substr(text, 1, greatest(CAST(floor(length(text) * 0.5) AS INTEGER), 1)) ELSE text END AS text FROM documents)
SELECT {s_finding('doc_id', 'text', 'missing_value')} FROM d WHERE NOT {s_blank('text')} AND NOT regexp_matches(text, '{_END}')
""")
def truncated_text(spark, sf):
    dirty, _ = contaminate(table(spark, sf, "documents"), [Fault(cut_short(0.5), "text", rate=0.05)], "doc_id")
    return findings(rules.run_rules(dirty, [text.truncated("text")], "doc_id"))


def _hits(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in text.STOP_WORDS[lang])
    return f"CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains([{words}], x))) / len(w) END"


_SCORES = ", ".join(f"struct_pack(share := CAST({_hits(lang)} AS DOUBLE), lang := '{lang}')" for lang in text.STOP_WORDS)


@query("language_mismatch", f"""
WITH d AS (SELECT c.doc_id, c.text, CASE WHEN {s_picked('c.doc_id', 'donor:lang', 0.1)} THEN coalesce(o.lang, c.lang) ELSE c.lang END AS lang
           FROM documents c LEFT JOIN documents o ON o.doc_id = c.doc_id - 1),
t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+') AS w FROM d),
s AS (SELECT doc_id, lang, len(w) AS n, list_max([{_SCORES}]) AS best FROM t)
SELECT {s_finding('doc_id', 'text', 'inconsistent_value', 'best.lang AS observed, lang AS expected')} FROM s
WHERE n >= 5 AND best.share >= 0.05 AND best.lang <> lang
""")
def language_mismatch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dirty, _ = copy_from_donor(docs, "lang", 1, "doc_id", 0.1)
    dirty = text.with_language(dirty, "text")
    return findings(rules.run_rules(dirty, [text.language_mismatch("text", "lang")], "doc_id"), "observed", "expected")


@query("duplicate_text", """
SELECT CAST(doc_id AS BIGINT) AS row_id, 'text' AS col, 'duplicate_row' AS issue_type, CAST(first_id AS VARCHAR) AS expected
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id > first_id
""")
def duplicate_text(spark, sf):
    return findings(keyed.duplicate_text(table(spark, sf, "documents"), "text", "doc_id"), "expected")


@query("duplicate_text_normalised", f"""
WITH d AS (SELECT * FROM documents UNION ALL
  SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), replace(text, ' ', '  ') || '!!', lang, source, n_chars FROM documents
  WHERE lang = 'en' AND {s_picked('doc_id', 'copy', 0.1)}),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM d WHERE NOT {s_blank('text')})
SELECT CAST(doc_id AS BIGINT) AS row_id, 'text' AS col, 'duplicate_row' AS issue_type, CAST(first_id AS VARCHAR) AS expected
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first_id FROM n) WHERE doc_id > first_id
""")
def duplicate_text_normalised(spark, sf):
    docs = table(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    dirty, _ = append_copies(docs.where("lang = 'en'"), "text", "doc_id", 0.1, first_id=last + 1)
    spaced = F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("!!"))
    restyled = dirty.where(F.col("doc_id") > last).withColumn("text", spaced)
    return findings(keyed.duplicate_text(docs.unionByName(restyled), "text", "doc_id", normalise=True), "expected")


_SETS = "SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')) AS w FROM documents"


@query("near_duplicate_text", f"""
WITH s AS ({_SETS}), t AS (SELECT doc_id, len(w) AS n, unnest(w) AS tok FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id > b.doc_id GROUP BY 1, 2)
SELECT DISTINCT {s_finding('x', 'text', 'duplicate_row')} FROM p WHERE k / (nx + ny - k) >= 0.65
""")
def near_duplicate_text(spark, sf):
    """Exact set-similarity join on whole texts."""
    return findings(similarity.near_duplicate_text(table(spark, sf, "documents"), "text", 0.65, "doc_id"))


@query("near_duplicate_lsh")
def near_duplicate_lsh(spark, sf):
    """MinHash bands; the bands use Spark's own hash, so there is no SQL twin."""
    return findings(similarity.near_duplicate_lsh(table(spark, sf, "documents"), "text", 0.65, row_id="doc_id"))


DIMS, TABLES, BITS = 64, 16, 8
_PLANES = "[" + ", ".join(
    "[" + ", ".join(str(v) for v in similarity.hyperplane(i, DIMS)) + "]" for i in range(TABLES * BITS)
) + "]::DOUBLE[][]"


_MOVED = f"""e AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL
  SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings),
         list_transform(embedding, lambda x, i: CAST(x * CAST(1.5 AS FLOAT) + CAST(0.01 AS FLOAT) * (i % 3) AS FLOAT))::DOUBLE[]
  FROM embeddings WHERE {s_picked('vec_id', 'copy', 0.1)})"""


def moved_copies(spark, sf):
    """The vectors, and a tenth of them once more, rescaled and moved a little."""
    vectors = table(spark, sf, "embeddings")
    last = vectors.agg(F.max("vec_id")).first()[0]
    dirty, _ = append_copies(vectors, "embedding", "vec_id", 0.1, first_id=last + 1)
    moved = F.transform("embedding", lambda x, i: (
        x * F.lit(1.5).cast("float") + F.lit(0.01).cast("float") * ((i + 1) % 3).cast("float")).cast("float"))
    return dirty.withColumn("embedding", F.when(F.col("vec_id") > last, moved).otherwise(F.col("embedding")))


@query("semantic_duplicate", f"""
WITH {_MOVED},
planes AS (SELECT unnest({_PLANES}) AS p, generate_subscripts({_PLANES}, 1) - 1 AS i),
s AS (SELECT id, i // {BITS} AS t, sum(CASE WHEN list_inner_product(v, p) >= 0 THEN 1 << (i % {BITS}) ELSE 0 END) AS b
      FROM e, planes GROUP BY 1, 2),
c AS (SELECT DISTINCT x.id AS x, y.id AS y FROM s x JOIN s y ON x.t = y.t AND x.b = y.b AND x.id > y.id)
SELECT DISTINCT {s_finding('x', 'embedding', 'duplicate_row')} FROM c JOIN e a ON a.id = c.x JOIN e b ON b.id = c.y
WHERE list_cosine_similarity(a.v, b.v) >= 0.95
""")
def semantic_duplicate(spark, sf):
    """Vectors with nearly parallel, rescaled copies planted among them."""
    return findings(similarity.semantic_duplicate(moved_copies(spark, sf), "embedding", DIMS, 0.95, TABLES, BITS, "vec_id"))


@query("parallel_vector", f"""
WITH {_MOVED}
SELECT DISTINCT {s_finding('x.id', 'embedding', 'duplicate_row')} FROM e x JOIN e y ON x.id > y.id
WHERE list_cosine_similarity(x.v, y.v) >= 0.95
""")
def parallel_vector(spark, sf):
    """The same rows by an exact search; its SQL twin compares all pairs."""
    return findings(metric.parallel_vector(moved_copies(spark, sf), "embedding", DIMS, 0.95, "vec_id"))


def exchanges(spark, sf):
    """Question and answer side by side: a user turn and the assistant turn right after it."""
    t = turns(spark, sf)
    asked = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return t.where("role = 'assistant'").select("row_id", "conv_id", "turn", F.col("text").alias("response")).join(
        asked, ["conv_id", "turn"]
    ).select("row_id", "prompt", "response")


_PAIRS = f"""
x AS (SELECT {_TURN} AS row_id, u.text AS prompt, a.text AS response
      FROM (SELECT * FROM conversations WHERE role = 'assistant') a JOIN (SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'user') u USING (conv_id, turn))"""


@query("copied_response", f"""
WITH {_PAIRS},
d AS (SELECT c.row_id, c.prompt, CASE WHEN {s_picked('c.row_id', 'donor:response', 0.2)} THEN coalesce(o.response, c.response) ELSE c.response END AS response
      FROM x c LEFT JOIN x o ON o.row_id = c.row_id - 1000),
f AS (SELECT *, first_value(prompt) OVER w AS p1, first_value(row_id) OVER w AS r1 FROM d WHERE NOT {s_blank('response')} WINDOW w AS (PARTITION BY response ORDER BY row_id))
SELECT {s_finding('row_id', 'response', 'inconsistent_value', 'CAST(r1 AS VARCHAR) AS expected')} FROM f WHERE prompt <> p1
""")
def copied_response(spark, sf):
    dirty, _ = copy_from_donor(exchanges(spark, sf), "response", 1000, "row_id", 0.2, issue_type="inconsistent_value")
    return findings(keyed.copied_response(dirty, "prompt", "response"), "expected")


_STOP = "[" + ", ".join(f"'{w}'" for ws in text.STOP_WORDS.values() for w in ws) + "]"


def _content(c: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-zà-öø-ÿ0-9]+')), "
            f"lambda t: NOT list_contains({_STOP}, t))")


@query("off_topic", f"""
WITH {_PAIRS}, w AS (SELECT row_id, response, {_content('prompt')} AS p, {_content('response')} AS r FROM x)
SELECT {s_finding('row_id', 'response', 'inconsistent_value')} FROM w
WHERE NOT {s_blank('response')} AND len(p) >= 5 AND len(list_intersect(p, r)) / len(p) < 0.05
""")
def off_topic(spark, sf):
    return findings(rules.run_rules(exchanges(spark, sf), [text.off_topic("prompt", "response")]))


# --- labels -------------------------------------------------------------------------------------------------------------

def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query("label_conflict", f"""
WITH l AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
d AS (SELECT doc_id, text, quality, toxic FROM l UNION ALL
      SELECT doc_id + (SELECT max(doc_id) + 1 FROM l), text, quality, 1 - toxic FROM l WHERE {s_picked('doc_id', 'copy', 0.1)}),
g AS (SELECT text, min(quality) <> max(quality) AS q, min(toxic) <> max(toxic) AS t FROM d GROUP BY text)
SELECT {s_finding('doc_id', 'quality', 'inconsistent_value', 'CAST(quality AS VARCHAR) AS observed')} FROM d JOIN g USING (text) WHERE q
UNION ALL SELECT {s_finding('doc_id', 'toxic', 'inconsistent_value', 'CAST(toxic AS VARCHAR) AS observed')} FROM d JOIN g USING (text) WHERE t
""")
def label_conflict(spark, sf):
    """Copies of labelled documents whose toxicity label is turned round."""
    docs = labelled(spark, sf)
    last = docs.agg(F.max("doc_id")).first()[0]
    dirty, _ = append_copies(docs, "text", "doc_id", 0.1, first_id=last + 1)
    dirty = dirty.withColumn("toxic", F.when(F.col("doc_id") > last, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return findings(keyed.label_conflict(dirty, digest(F.col("text")), ["quality", "toxic"], "doc_id"), "observed")


@query("label_by_peer", f"""
WITH v AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY 1, 2),
m AS (SELECT p_name, min(struct_pack(n := -n, t := p_type)) AS b FROM v GROUP BY 1 HAVING count(*) > 1)
SELECT {s_finding('p_partkey', 'p_type', 'inconsistent_value', 'p_type AS observed, b.t AS expected')}
FROM part JOIN m USING (p_name) WHERE p_type <> b.t
""")
def label_by_peer(spark, sf):
    """Parts of one name whose type is not the majority type."""
    return findings(keyed.label_by_peer(table(spark, sf, "part"), F.col("p_name"), "p_type", "p_partkey"), "observed", "expected")


_NEAR = f"""
WITH RECURSIVE l AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
d AS (SELECT doc_id, text, quality, toxic FROM l UNION ALL
      SELECT doc_id + (SELECT max(doc_id) + 1 FROM l), text || ' zwei neue', quality, 1 - toxic FROM l WHERE {s_picked('doc_id', 'copy', 0.1)}),
s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')) AS w FROM d),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS tok FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
      GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.65),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, p.y FROM reach r JOIN p ON p.x = r.b),
c AS (SELECT d.*, k.cluster FROM d JOIN (SELECT a, min(b) AS cluster FROM reach GROUP BY 1) k ON k.a = d.doc_id)"""


def near_labelled(spark, sf):
    """Labelled documents, and near copies of some whose toxicity label is turned round."""
    docs = labelled(spark, sf)
    last = docs.agg(F.max("doc_id")).first()[0]
    dirty, _ = append_copies(docs, "text", "doc_id", 0.1, first_id=last + 1)
    planted = F.col("doc_id") > last
    return dirty.withColumns({"toxic": F.when(planted, 1 - F.col("toxic")).otherwise(F.col("toxic")),
                              "text": F.when(planted, F.concat("text", F.lit(" zwei neue"))).otherwise(F.col("text"))})


@query("label_conflict_near", f"""{_NEAR},
g AS (SELECT cluster, min(quality) <> max(quality) AS q, min(toxic) <> max(toxic) AS t FROM c GROUP BY 1)
SELECT {s_finding('doc_id', 'quality', 'inconsistent_value', 'CAST(quality AS VARCHAR) AS observed')} FROM c JOIN g USING (cluster) WHERE q
UNION ALL SELECT {s_finding('doc_id', 'toxic', 'inconsistent_value', 'CAST(toxic AS VARCHAR) AS observed')} FROM c JOIN g USING (cluster) WHERE t
""")
def label_conflict_near(spark, sf):
    found = clusters.label_conflict_near(near_labelled(spark, sf), "text", ["quality", "toxic"], 0.65, "doc_id")
    return findings(found, "observed")


@query("label_by_cluster", f"""{_NEAR},
v AS (SELECT cluster, toxic, count(*) AS n FROM c GROUP BY 1, 2),
m AS (SELECT cluster, min(struct_pack(n := -n, t := toxic)) AS b FROM v GROUP BY 1 HAVING count(*) > 1)
SELECT {s_finding('doc_id', 'toxic', 'inconsistent_value', 'CAST(toxic AS VARCHAR) AS observed, CAST(b.t AS VARCHAR) AS expected')} FROM c JOIN m USING (cluster) WHERE toxic <> b.t
""")
def label_by_cluster(spark, sf):
    found = clusters.label_by_cluster(near_labelled(spark, sf), "text", "toxic", 0.65, "doc_id")
    return findings(found, "observed", "expected")


LEXICON = ["worthless", "pathetic", "stupid", "idiot", "hate"]
_LEX = "[" + ", ".join(f"'{w}'" for w in LEXICON) + "]"


@query("lexicon_vs_label", f"""
WITH d AS (SELECT doc_id, toxic, list_intersect({_LEX}, regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')) AS w FROM documents JOIN labels USING (doc_id))
SELECT {s_finding('doc_id', 'toxic', 'inconsistent_value', "'lexicon_unflagged:toxic' AS rule_id")} FROM d WHERE toxic = 0 AND len(w) >= 1
UNION ALL SELECT {s_finding('doc_id', 'toxic', 'inconsistent_value', "'lexicon_flagged:toxic'")} FROM d WHERE toxic = 1 AND len(w) < 1
""")
def lexicon_vs_label(spark, sf):
    return findings(rules.run_rules(labelled(spark, sf), labels.lexicon_vs_label("text", "toxic", LEXICON), "doc_id"), "rule_id")


@query("binary_labels", f"""
WITH d AS (SELECT doc_id, {s_spoilt('CAST(quality AS VARCHAR)', s_picked('doc_id', '0:quality', 0.05), "'3'")} AS q,
           {s_spoilt('CAST(toxic AS VARCHAR)', s_picked('doc_id', '1:toxic', 0.05), "' '")} AS t FROM labels)
SELECT {s_finding('doc_id', 'quality', 'out_of_range', 'q AS observed')} FROM d WHERE NOT {s_blank('q')} AND trim(q) NOT IN ('0', '1')
UNION ALL SELECT {s_finding('doc_id', 'toxic', 'out_of_range', 't')} FROM d WHERE NOT {s_blank('t')} AND trim(t) NOT IN ('0', '1')
""")
def binary_labels(spark, sf):
    faults = [Fault(constant("3"), "quality", rate=0.05, issue_type="out_of_range"), Fault("whitespace_value", "toxic", rate=0.05)]
    dirty, _ = contaminate(table(spark, sf, "labels"), faults, "doc_id")
    return findings(rules.run_rules(dirty, rules.binary_labels(["quality", "toxic"]), "doc_id"), "observed")


@query("label_implication", f"""
WITH d AS (SELECT doc_id, CAST(toxic AS VARCHAR) AS child, {s_spoilt('CAST(toxic AS VARCHAR)', s_picked('doc_id', '0:parent', 0.2), "CASE toxic WHEN 0 THEN '1' WHEN 1 THEN '0' END")} AS parent FROM labels)
SELECT {s_finding('doc_id', 'parent', 'inconsistent_value')} FROM d WHERE child = '1' AND parent <> '1'
""")
def label_implication(spark, sf):
    pairs = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("child"), F.col("toxic").alias("parent"))
    dirty, _ = contaminate(pairs, [Fault("flip_flag", "parent", rate=0.2)], "doc_id")
    return findings(rules.run_rules(dirty, [labels.label_implication("child", "parent")], "doc_id"))


@query("flagged_high_score", f"""
SELECT {s_finding('doc_id', 'quality', 'inconsistent_value')} FROM labels WHERE toxic = 1 AND quality >= 1
""")
def flagged_high_score(spark, sf):
    return findings(rules.run_rules(table(spark, sf, "labels"), [text.flagged_but_high_score("toxic", "quality", 1)], "doc_id"))


@query("score_range", f"""
WITH d AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS a, CAST(floor(value / 20) AS BIGINT) AS b FROM events)
SELECT {s_finding('event_id', 'helpfulness', 'out_of_range', 'CAST(a AS VARCHAR) AS observed')} FROM d WHERE a > 4
UNION ALL SELECT {s_finding('event_id', 'coherence', 'out_of_range', 'CAST(b AS VARCHAR)')} FROM d WHERE b > 4
""")
def score_range(spark, sf):
    scored = table(spark, sf, "events").select(
        "event_id", (F.get_json_object("props", "$.k").cast("bigint") % 7).alias("helpfulness"),
        F.floor(F.col("value") / 20).alias("coherence"),
    )
    return findings(rules.run_rules(scored, rules.score_range(["helpfulness", "coherence"]), "event_id"), "observed")


# --- code ---------------------------------------------------------------------------------------------------------------

def _bare(c: str) -> str:
    return f"regexp_replace({c}, '''[^''\\n]*''|\"[^\"\\n]*\"', '', 'g')"


def _gap(c: str, signed: bool = False) -> str:
    parts = []
    for a, b in ("()", "[]", "{}"):
        d = f"(length(replace({c}, '{b}', '')) - length(replace({c}, '{a}', '')))"
        parts.append(d if signed else f"abs({d})")
    return "(" + " + ".join(parts) + ")"


_BROKEN = f"""
d AS (SELECT page_id, {s_spoilt('html', s_picked('page_id', '0:html', 0.2), "CASE WHEN contains(html, '}') THEN replace(html, '}', '') END")} AS html FROM pages)"""


def broken_pages(spark, sf):
    """Pages some of which lost their closing braces, by a rule given in place."""
    lost = lambda v, luck: F.when(v.contains("}"), F.replace(v, F.lit("}"), F.lit("")))
    fault = Fault(lost, "html", rate=0.2, issue_type="format_violation")
    return contaminate(table(spark, sf, "pages").select("page_id", "html"), [fault], "page_id")[0]


@query("unbalanced_brackets", f"""
WITH {_BROKEN}, b AS (SELECT page_id, {_bare('html')} AS c FROM d)
SELECT {s_finding('page_id', 'html', 'format_violation', f"CAST({_gap('c')} AS VARCHAR) AS observed")} FROM b WHERE {_gap('c')} > 0
""")
def unbalanced_brackets(spark, sf):
    return findings(rules.run_rules(broken_pages(spark, sf), [code.unbalanced_brackets("html")], "page_id"), "observed")


@query("misnested_brackets", f"""
WITH RECURSIVE {_BROKEN},
p AS (SELECT page_id, regexp_extract_all(html, '(?s)''[^''\\n]*''|"[^"\\n]*"|[()\\[\\]{{}}]|[^()\\[\\]{{}}''"#/\\-]+|.') AS k FROM d),
u AS (SELECT page_id, unnest(k) AS part, generate_subscripts(k, 1) AS i FROM p),
b AS (SELECT page_id, part, sum(length(part)) OVER (PARTITION BY page_id ORDER BY i) AS pos, i FROM u),
o AS (SELECT page_id, part, pos, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i FROM b WHERE part IN ('(', ')', '[', ']', '{{', '}}')),
f(page_id, i, stack, wrong) AS (
  SELECT page_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM d WHERE html IS NOT NULL UNION ALL
  SELECT o.page_id, o.i, CASE WHEN part IN ('(', '[', '{{') THEN stack || part WHEN right(stack, 1) = translate(part, ')]}}', '([{{') THEN left(stack, -1) ELSE stack END,
    CASE WHEN part IN ('(', '[', '{{') OR right(stack, 1) = translate(part, ')]}}', '([{{') THEN 0 ELSE CAST(pos AS BIGINT) END
  FROM f JOIN o ON o.page_id = f.page_id AND o.i = f.i + 1 WHERE wrong = 0),
e AS (SELECT page_id, arg_max(wrong, i) AS wrong, length(arg_max(stack, i)) AS depth FROM f GROUP BY 1)
SELECT {s_finding('page_id', 'html', 'format_violation', "wrong || ':' || depth AS observed")} FROM e WHERE wrong > 0 OR depth > 0
""")
def misnested_brackets(spark, sf):
    return findings(rules.run_rules(broken_pages(spark, sf), [code.misnested_brackets("html")], "page_id"), "observed")


@query("truncated_code", f"""
WITH {_BROKEN}, t AS (SELECT page_id, regexp_replace(html, '^\\s+|\\s+$', '', 'g') AS c FROM d),
b AS (SELECT page_id, c, {_bare('c')} AS bare, regexp_extract(c, '([^\\n]*)$', 1) AS last FROM t)
SELECT {s_finding('page_id', 'html', 'format_violation')} FROM b WHERE c <> '' AND
  (regexp_matches(last, '([-+*/=,(\\[{{&|]|\\b(and|or|not|in|return|if|else|elif|for|while|def)|:)\\s*$') OR {_gap('bare', True)} > 0)
""")
def truncated_code(spark, sf):
    return findings(rules.run_rules(broken_pages(spark, sf), [code.truncated_code("html")], "page_id"))


SNIPPETS = {
    "python": "def area(self, r):\n    import math\n    return math.pi * r ** 2\nif x is None:\n    pass",
    "javascript": "const area = (r) => Math.PI * r * r;\nconsole.log(area(2) === 4);",
    "sql": "SELECT id FROM shapes WHERE r > 2 ORDER BY id",
}


def snippets(spark, sf):
    """Every event carries a snippet in the language its type stands for, its label copied from a neighbour at times."""
    kinds = {"click": "javascript", "view": "javascript", "purchase": "sql", "signup": "python", "error": "python"}
    language, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, lang in kinds.items():
        language = F.when(F.col("event_type") == kind, F.lit(lang)).otherwise(language)
        body = F.when(F.col("event_type") == kind, F.lit(SNIPPETS[lang])).otherwise(body)
    made = table(spark, sf, "events").select("event_id", language.alias("language"), body.alias("code"))
    return copy_from_donor(made, "language", 1, "event_id", 0.1, issue_type="inconsistent_value")[0]


@query("code_language", f"""
WITH k AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'javascript' WHEN event_type = 'purchase' THEN 'sql' ELSE 'python' END AS lang FROM events),
d AS (SELECT c.event_id, c.lang AS guess, CASE WHEN {s_picked('c.event_id', 'donor:language', 0.1)} THEN coalesce(o.lang, c.lang) ELSE c.lang END AS language
      FROM k c LEFT JOIN k o ON o.event_id = c.event_id - 1)
SELECT {s_finding('event_id', 'language', 'inconsistent_value', 'language AS observed, guess AS expected')} FROM d WHERE guess <> language
""")
def code_language(spark, sf):
    rule = code.code_language_mismatch("code", "language", report_col="language")
    return findings(rules.run_rules(snippets(spark, sf), [rule], "event_id"), "observed", "expected")


@query("unsafe_pattern", f"""
WITH d AS (SELECT doc_id, quality, CASE WHEN {s_picked('doc_id', '0:text', 0.1)} THEN 'x = eval(request)' || text ELSE text END AS text
           FROM documents JOIN labels USING (doc_id))
SELECT {s_finding('doc_id', 'text', 'inconsistent_value')} FROM d WHERE quality = 1 AND regexp_matches(text, '\\beval\\s*\\(|\\bexec\\s*\\(|os\\.system\\s*\\(')
""")
def unsafe_pattern(spark, sf):
    dirty, _ = contaminate(labelled(spark, sf), [Fault(prefixed("x = eval(request)"), "text", rate=0.1)], "doc_id")
    return findings(rules.run_rules(dirty, [code.unsafe_pattern("text", F.col("quality") == 1)], "doc_id"))


@query("word_sets", """
SELECT lang, count(*) AS docs, CAST(sum(len(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')))) AS BIGINT) AS words
FROM documents GROUP BY 1
""")
def word_sets(spark, sf):
    """Distinct words per document, summed by language; the sets that the near-duplicate search works on."""
    n = F.size(casefold_tokens(F.col("text"))).cast("bigint")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n).alias("words")
    )
