"""Queries that join the words and phrases of whole documents with term dictionaries, names and rules, each with SQL.

The dictionary is the default one with the words of `benchmark` as custom terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import terms as T
from vellum.operators import terms as ops
from vellum.plans.textual import _q
from vellum.sources.overlays import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark, d, name):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name == "documents" else df


def _dictionary(spark, d):
    custom = _read(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return ops.dictionary(spark, custom)


def _values(rows, *names):
    return "(VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({', '.join(names)})"


_TOKENS = f"regexp_extract_all(lower(text), {_q(T.TOKEN)})"
_TERMS = f"""suffixes AS (SELECT * FROM {_values([(s,) for s in T.SUFFIXES], 's')}),
terms AS (SELECT DISTINCT term FROM (SELECT term FROM {_values([(t,) for t in T.TERMS + T.DRUGS], 'term')} UNION ALL SELECT unnest({_TOKENS}) FROM benchmark) WHERE term <> '')"""


def _via(source: str, out: str) -> str:
    """(word, via) of the words of a relation that a term protects."""
    return f"""{out} AS (SELECT word, CASE WHEN bool_or(form = lower(word)) THEN 'exact' ELSE 'stem' END AS via
    FROM (SELECT word, lower(word) AS form FROM {source} UNION ALL SELECT word, left(lower(word), length(word) - length(s)) FROM {source} JOIN suffixes ON length(word) > length(s) + {T.STEM} AND ends_with(lower(word), s))
    WHERE form IN (SELECT term FROM terms) GROUP BY word)"""


def _protected_tokens(spark, d):
    return ops.protected_tokens(_read(spark, d, "documents"), _dictionary(spark, d)).withColumn("protected", F.md5("protected"))


QUERIES["j12_protected_tokens"] = _protected_tokens
ORACLE_SQL["j12_protected_tokens"] = f"""WITH {_TERMS},
numbered AS (SELECT row_number() OVER () AS d, doc_id, {_TOKENS} AS words FROM documents),
listed AS (SELECT d, unnest(words) AS word FROM numbered),
counted AS (SELECT d, word, count(*) AS n FROM listed GROUP BY ALL),
words AS (SELECT DISTINCT word FROM listed), {_via('words', 'hits')}
SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens, CAST(coalesce(sum(n) FILTER (via IS NOT NULL), 0) AS BIGINT) AS n_protected, CAST(coalesce(sum(n) FILTER (via = 'stem'), 0) AS BIGINT) AS n_by_stem,
       md5(coalesce(string_agg(word, ' ' ORDER BY word) FILTER (via IS NOT NULL), '')) AS protected
FROM numbered LEFT JOIN counted USING (d) LEFT JOIN hits USING (word) GROUP BY d, doc_id"""


def phrases(docs):
    """The distinct runs of one to three capitalised words, white space as one space."""
    run = F.explode(F.regexp_extract_all("text", F.lit(T.NAME_RUN), F.lit(0)))
    return docs.select(run.alias("phrase")).select(F.regexp_replace("phrase", r"(?U)\s+", " ").alias("phrase")).distinct()


QUERIES["pi16_protected_phrases"] = lambda spark, d: ops.protected_phrases(phrases(_read(spark, d, "documents")), _dictionary(spark, d)).select("phrase", F.coalesce("via", F.lit("none")).alias("via"))
#: Words of a text with the gap before, place, start and whether they are capitalised: islands of those are the runs.
WORDS_SQL = f"""numbered AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
split_up AS (SELECT d, doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]+') AS gs FROM numbered),
words_at AS (SELECT d, doc_id, i, word, gap, regexp_full_match(word, {_q(T.NAME_WORD)}) AS capital, sum(length(gap) + length(word)) OVER (PARTITION BY d ORDER BY i) - length(word) AS start
    FROM (SELECT d, doc_id, unnest(ws) AS word, unnest(gs[: len(ws)]) AS gap, unnest(range(len(ws))) AS i FROM split_up)),
islands AS (SELECT *, sum(CAST(NOT (capital AND joined) AS INT)) OVER (PARTITION BY d ORDER BY i) AS island FROM (SELECT *, coalesce(lag(capital) OVER (PARTITION BY d ORDER BY i), false) AND regexp_full_match(gap, '\\s+') AS joined FROM words_at)),
runs AS (SELECT d, doc_id, island, part, min(i) AS i, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS phrase, max(start + length(word)) - min(start) AS size, min(start) AS start
    FROM (SELECT *, (row_number() OVER (PARTITION BY d, island ORDER BY i) - 1) // 3 AS part FROM islands WHERE capital) GROUP BY ALL)"""
ORACLE_SQL["pi16_protected_phrases"] = f"""WITH {_TERMS}, {WORDS_SQL},
phrases AS (SELECT DISTINCT phrase FROM runs),
parts AS (SELECT phrase, phrase AS word, 0 AS place FROM phrases UNION ALL SELECT phrase, unnest(string_split(phrase, ' ')), 1 FROM phrases WHERE contains(phrase, ' ')),
words AS (SELECT DISTINCT word FROM parts), {_via('words', 'hits')}
SELECT phrase, CASE min(CASE WHEN via IS NULL THEN 3 WHEN place = 1 THEN 2 WHEN via = 'exact' THEN 0 ELSE 1 END) WHEN 0 THEN 'exact' WHEN 1 THEN 'stem' WHEN 2 THEN 'word' ELSE 'none' END AS via
FROM parts LEFT JOIN hits USING (word) GROUP BY phrase"""


def _eponyms(spark, d):
    names = spark.createDataFrame([(n,) for n in T.EPONYMS], "name string").unionByName(_read(spark, d, "nation").select(F.initcap("n_name").alias("name")))
    found = ops.eponyms(_read(spark, d, "documents"), names)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_names"), F.count_if("in_list").alias("n_listed"), F.count_if(F.col("near")).alias("n_near"), F.count_if(F.col("near") | F.col("in_list")).alias("n_kept"))


QUERIES["pi17_eponyms"] = _eponyms
_NEAR = " OR ".join(f"contains(context, {_q(w)})" for w in T.DISEASE_WORDS)
ORACLE_SQL["pi17_eponyms"] = f"""WITH {WORDS_SQL},
names AS (SELECT name FROM {_values([(n,) for n in T.EPONYMS], 'name')} UNION SELECT lower(n_name) FROM nation)
SELECT doc_id, count(*) AS n_names, count(*) FILTER (listed) AS n_listed, count(*) FILTER (near) AS n_near, count(*) FILTER (near OR listed) AS n_kept
FROM (SELECT doc_id, low IN (SELECT name FROM names) AS listed, {_NEAR} AS near FROM (
    SELECT w.doc_id, lower(word) AS low, lower(substr(text, CAST(greatest(start - {ops.REACH}, 0) + 1 AS BIGINT), CAST(least(start, {ops.REACH}) + length(word) + {ops.REACH} AS BIGINT))) AS context FROM words_at w JOIN numbered USING (d) WHERE capital)) GROUP BY doc_id"""


def _verified(spark, d):
    part = _read(spark, d, "part").select(F.split("p_type", " ")[0].alias("abbreviation"), F.col("p_type").alias("meaning")).groupBy("abbreviation").agg(F.min("meaning").alias("meaning"))
    words = _read(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return ops.verified(words, ops.rules(spark, part))


QUERIES["pi19_verified_terms"] = _verified
_W = r"[^\p{L}\p{N}_]"
_EXPRESSIONS = {7: rf"(?i)(?:^|{_W})(?:{'|'.join(g.replace('.', chr(92) + '.') for g in T.GENERA)})(?:{'|'.join(T.SPECIES)})?(?:$|{_W})", 8: "(?i)" + T.ANTIBODIES.replace(r"\b", rf"(?:^|$|{_W})"), 11: "(?i)" + "|".join(T.COMPOUNDS)}
_RULES = [(p, w, v, r.replace("{}", v)) for p, w, v, r in dict.fromkeys(T.RULES) if w != T.EXPRESSION]
ORACLE_SQL["pi19_verified_terms"] = f"""WITH words AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents),
rules AS (SELECT * FROM {_values(_RULES, 'priority', 'way', 'value', 'reason')} UNION ALL SELECT 1, 'equal', lower(a), 'abbreviation:' || left(m, 50) FROM (SELECT split_part(p_type, ' ', 1) AS a, min(p_type) AS m FROM part GROUP BY 1)),
roots AS (SELECT * FROM {_values([(r, i) for i, r in enumerate(T.ROOTS)], 'value', 'nth')}),
hits AS (
    SELECT term, priority, -length(r.value) AS place, r.value, reason FROM words JOIN rules r ON way = 'equal' AND term = r.value
    UNION ALL SELECT term, priority, -length(r.value), r.value, reason FROM words JOIN rules r ON way = 'end' AND ends_with(term, r.value) AND length(term) > length(r.value) + 2
    UNION ALL SELECT term, priority, -length(r.value), r.value, reason FROM words JOIN rules r ON way = 'beginning' AND starts_with(term, r.value) AND length(term) > length(r.value) + 3 AND regexp_matches(term, '(ie|isch|al|ar|ose|itis)$')
    UNION ALL SELECT term, priority, nth, r.value, reason FROM words JOIN rules r ON way = 'part' AND contains(term, r.value) JOIN roots o ON o.value = r.value
    {' '.join(f"UNION ALL SELECT term, {p}, 0, '', {_q(next(x[3] for x in T.RULES if x[0] == p))} FROM words WHERE regexp_matches(term, {_q(e)})" for p, e in _EXPRESSIONS.items())}),
best AS (SELECT * FROM hits WHERE length(term) >= 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY priority, place, value) = 1)
SELECT term, reason IS NOT NULL AS is_medical, coalesce(reason, CASE WHEN length(term) < 2 THEN 'too_short' ELSE 'not_medical' END) AS reason FROM words LEFT JOIN best USING (term)"""
