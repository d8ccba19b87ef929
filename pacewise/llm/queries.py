"""The registered queries of this package, each next to SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pacewise.llm import alignment, bytebpe, decontaminate, jaccard, language, lexical, mixing, passages, quality, rules, suffixes, tokens, warc
from pacewise.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return keep


JACCARD_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, {WORDS.format(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM doc
  UNION
  SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id
FROM doc LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = doc.doc_id"""


@query("op1_jaccard_join", JACCARD_SQL)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SUFFIX_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE m < w.doc_id),
island AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh
        FROM hit)),
span AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM island GROUP BY doc_id, g),
part AS (
  SELECT doc_id, b, substr(h, 2 * p + 1, 2 * (b - p)) AS kept
  FROM (SELECT doc_id, b, h, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p
        FROM (SELECT doc_id, b, e FROM span UNION ALL SELECT doc_id, n, n FROM d) JOIN d USING (doc_id))),
kept AS (SELECT doc_id, string_agg(kept, '' ORDER BY b) AS kept FROM part GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""


@query("op6_suffix_dedup", SUFFIX_SQL)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACE = r"[\x20\x09-\x0D]"


def _rate(count: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN least({rules.STEPS}, 1000 * {count} // {base}) ELSE 0 END"


RULES_SQL = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {WORDS.format("text")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM twice, (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
              AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_marks
  FROM doc LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT doc_id, stratum, unnest({list(rules.RULES)}) AS rule, unnest([
    {_rate("n_symbols", "word_chars")}, {_rate("n_dup_lines", "n_words")}, {_rate("n_repeat_words", "n_words")},
    {_rate("n_capitals", "word_chars")}, {_rate("n_marks", "n_words")},
    CASE WHEN n_words > 0 THEN least({rules.STEPS}, 10 * word_chars // n_words) ELSE 0 END]) AS value
  FROM m),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tally AS (
  SELECT stratum, rule, value, count(*) FILTER (q = 1) AS good, count(*) FILTER (q <> 1) AS bad
  FROM v JOIN lab USING (doc_id) GROUP BY 1, 2, 3),
size AS (SELECT stratum, rule, sum(good) AS n, count(*) OVER () AS tests FROM tally GROUP BY 1, 2),
term AS (
  SELECT stratum, rule, tests, i,
         CAST(n AS DOUBLE) * ln(1 - {rules.RISK}) + i * ln({rules.RISK} / (1 - {rules.RISK}))
         + coalesce(sum(ln((n - i + 1) / CAST(i AS DOUBLE))) FILTER (i > 0)
                    OVER (PARTITION BY stratum, rule ORDER BY i), 0) AS l
  FROM (SELECT *, unnest(range(0, CAST(least(n - 1, ceil(n * {rules.RISK})) AS BIGINT) + 1)) AS i FROM size WHERE n > 0)),
most AS (
  SELECT stratum, rule, coalesce(max(i) FILTER (p <= {rules.LEVEL} / tests), -1) AS most
  FROM (SELECT *, sum(exp(l)) OVER (PARTITION BY stratum, rule ORDER BY i) AS p FROM term) GROUP BY 1, 2),
cut AS (
  SELECT stratum, rule, max_by(value, gain * 10000 + value) AS cutoff
  FROM (SELECT stratum, rule, value, g, b - {rules.COST} * g AS gain
        FROM (SELECT stratum, rule, value, coalesce(sum(good) OVER x, 0) AS g, coalesce(sum(bad) OVER x, 0) AS b FROM tally
              WINDOW x AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  JOIN most USING (stratum, rule) WHERE g <= most AND gain > 0 GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cut USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f AS base_failed,
       NOT f AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS f FROM m)"""


@query("op10_quality_rules", RULES_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixing_sql(documents: str = "documents") -> str:
    return rf"""
WITH doc AS (
  SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)),
capped AS (SELECT *, ({list(mixing.WEIGHTS)})[src % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.MOST_TIMES} AS cap
           FROM ranked),
stepped AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, src
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM capped),
aim AS (
  SELECT src, source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(max(CASE WHEN level <= cap / weight THEN level END)
         OVER (), 0)) AS target FROM stepped),
size AS (
  SELECT words, block, words // block AS slots
  FROM (SELECT words, greatest(1, least({mixing.BLOCK_WORDS}, words // {mixing.LEAST_SLOTS})) AS block
        FROM (SELECT CAST(sum(source_size) AS BIGINT) AS words FROM aim))),
upto AS (
  SELECT src, CASE WHEN src = max(src) OVER () THEN {mixing.POINTS}
              ELSE CAST(floor(sum(target) OVER (ORDER BY src) / sum(target) OVER () * {mixing.POINTS}) AS BIGINT) END AS hi FROM aim),
bound AS (SELECT src, hi, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM upto),
slot AS (
  SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, slot * {mixing.GOLDEN} % {mixing.POINTS} AS point FROM (SELECT unnest(range(0, slots)) AS slot FROM size))
  JOIN bound ON point >= lo AND point < hi),
placed AS (
  SELECT doc_id, size, src, source_size, target, coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc JOIN aim ON doc.source IS NOT DISTINCT FROM aim.source),
turn AS (
  SELECT src, start, k * source_size + start AS f, k * source_size + start + size AS u
  FROM placed, (SELECT unnest(range(0, {mixing.MOST_TIMES})) AS k) WHERE size > 0),
part AS (
  SELECT src, start, f, u, unnest(range(CAST(f // block AS BIGINT), CAST((u - 1) // block + 1 AS BIGINT))) AS rank, block
  FROM turn, size),
taken AS (
  SELECT src, start, sum(least(u, (rank + 1) * block) - greatest(f, rank * block)) AS taken
  FROM part JOIN slot USING (src, rank) GROUP BY src, start)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (src, start)"""


@query("op3_mix_sources", mixing_sql())
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_digest(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, n, min(page_id) AS first FROM d GROUP BY h, n),
bits AS (
  SELECT h, string_agg(lpad(bin(CAST('0x' || substr(h, 10 * k + 1, 10) AS BIGINT)), 40, '0'), '' ORDER BY k) AS bits
  FROM (SELECT DISTINCT h FROM d), (SELECT unnest(range(0, 4)) AS k) GROUP BY h),
b32 AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j)))::INTEGER, 1),
         '' ORDER BY i) AS digest
  FROM bits, (SELECT unnest(range(0, 32))::INTEGER AS i) GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h, n) JOIN b32 USING (h)"""


@query("op8_warc_packages", WARC_SQL)
def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_substring_chains")
def op7_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bytebpe.digests(bytebpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    figures, _ = alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return figures


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_UPPER, _UPPER.lower())

LEXICAL_SQL = rf"""
WITH doc AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents)),
size AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS words FROM doc),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM doc) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN df USING (term), size GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}"""


@query("op13_lexical_search", LEXICAL_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
