"""The registered queries of the training-data operators, with their SQL.

``QUERIES`` and ``ORACLE`` are added by ``__spark_entry__`` when this
subpackage is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.llm import alignment, bpe, conversations, decreasing, exact_dedup, license_scan, line_dedup, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules
from revkit.sources.tables import table

#: The tokenizer files of the queries; operators take paths.
TOKENIZER = "word_bpe_49k.json"
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return deco


_OP6 = r"""WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM k
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)"""


@register("op6_exact_dedup", _OP6)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.assign(table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_RULE_ROWS = " UNION ALL ".join(
    f"SELECT r, doc_id, stratum, base_failed, '{rule}' AS rule, {top} AS a, {bottom} AS d FROM f" for rule, (top, bottom, _) in quality_rules.RULES.items()
)
_GRID_ROWS = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(quality_rules.GRID))
_SHARE = quality_rules.ALPHA / len(quality_rules.RULES)
_LEVEL = quality_rules.DELTA / (len(quality_rules.RULES) * (len(quality_rules.STRATA) + 1))
_OP7 = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN {quality_rules.STRATA} THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS b FROM documents),
w AS (SELECT *, regexp_extract_all(b, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(b, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (
  SELECT r, unnest(generate_series(1, len(ws) - 7)) AS i, unnest(list_transform(generate_series(1, len(ws) - 7), lambda i: array_to_string(ws[i:i + 7], ' '))) AS x
  FROM w WHERE len(ws) >= 8),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) q WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM dup) q GROUP BY r),
m AS (
  SELECT r, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    length(regexp_replace(b, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(b, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(b, '[^!?]', '', 'g')) AS n_marks
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
ratio AS ({_RULE_ROWS}),
grid(step, cutoff) AS (VALUES {_GRID_ROWS}),
cells AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (d > 0 AND a > cutoff * d) AS k
  FROM ratio JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY stratum, rule, step, cutoff),
tails AS (
  SELECT *, CASE WHEN k > ceil(n * {_SHARE!r}) THEN 1.0 ELSE list_sum(list_transform(generate_series(0, k),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})))) END AS tail FROM cells),
certain AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, max(tail) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst FROM tails) q
  WHERE worst <= {_LEVEL!r} GROUP BY stratum, rule),
out AS (SELECT r, bool_or(d > 0 AND a > cutoff * d) AS rejected FROM ratio JOIN certain USING (stratum, rule) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN out USING (r)"""


@register("op7_quality_rules", _OP7)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_docs(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest_docs(table(spark, sf_dir, "documents"), tokenizer_path(BYTES_FILE), tokenizer_path(PIECES_FILE))


@register("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decreasing.pack_docs(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_damaged(table(spark, sf_dir, "conversations"))


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_docs(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), shingle=4)


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


@register("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


_OP5 = rf"""WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '{line_dedup.HOST}', 1)), '') AS host,
    list_filter(list_transform(
      regexp_split_to_array(regexp_replace(coalesce(html, ''), '{line_dedup.ANY_CASE + line_dedup.DROPPED}', '', 'g'), '{line_dedup.ANY_CASE + line_dedup.BREAKS}'),
      lambda s: regexp_replace(regexp_replace(s, '{line_dedup.TAGS}', '', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda s: s <> '') AS lines
  FROM pages
), l AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL),
bad AS (
  SELECT host, line FROM l GROUP BY host, line
  HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.RATIO} * (SELECT count(*) FROM p WHERE p.host = l.host)
), d AS (SELECT r, list(line) AS gone FROM l JOIN bad USING (host, line) GROUP BY r),
k AS (
  SELECT page_id, host, lines, list_filter(lines, lambda s: NOT list_contains(coalesce(gone, []), s)) AS kept
  FROM p LEFT JOIN d USING (r)
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM k"""


@register("op5_line_dedup", _OP5)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "pages"))


@register("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


#: The file tree of the documents, in SQL that Spark and DuckDB both run: the
#: source is the repository, the id gives the folder, and half of the texts that
#: speak of a licence are files named LICENSE, some of them one folder higher.
_FILES = """SELECT doc_id, source AS repo, text,
  CASE WHEN doc_id % 2 = 0 AND (lower(text) LIKE '%license%' OR lower(text) LIKE '%licensed%') THEN
      CASE WHEN doc_id % 3 = 0 THEN concat('d', CAST(doc_id % 16 AS STRING), '/LICENSE')
        ELSE concat('d', CAST(doc_id % 16 AS STRING), '/e', CAST(doc_id % 64 AS STRING), '/LICENSE') END
    ELSE concat('d', CAST(doc_id % 16 AS STRING), '/e', CAST(doc_id % 64 AS STRING), '/f', CAST(doc_id AS STRING), '.txt') END AS path
FROM documents"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
_OP8 = f"""WITH f AS (SELECT doc_id, repo, path, coalesce(text, '') AS text, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches(path, '/LICENSE$') AS is_license FROM ({_FILES})),
tpl(template, license, body) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT template, term, count(*) AS n FROM (SELECT template, unnest({_SPLIT.format('body')}) AS term FROM tpl) GROUP BY template, term),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_SPLIT.format('text')})) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY term),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT term, ln(((SELECT n FROM n) + 1.0) / (coalesce(df, 0) + 1.0)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
tw AS (SELECT template, term, n * idf AS tw FROM tt JOIN idf USING (term)),
norm AS (SELECT template, sqrt(sum(tw * tw)) AS norm FROM tw GROUP BY template),
seg AS (
  SELECT DISTINCT doc_id, segment FROM (
    SELECT doc_id, unnest(CASE WHEN is_license THEN list_append(string_split(text, chr(10)), text) ELSE string_split(text, chr(10)) END) AS segment FROM f)
),
w AS (
  SELECT segment, term, count(*) * coalesce(idf, ln((SELECT n FROM n) + 1.0) + 1) AS w
  FROM (SELECT segment, unnest({_SPLIT.format('segment')}) AS term FROM (SELECT DISTINCT segment FROM seg)) LEFT JOIN idf USING (term) GROUP BY segment, term, idf
),
own AS (SELECT segment, sqrt(sum(w * w)) AS own FROM w GROUP BY segment),
score AS (
  SELECT segment, license, round(dot / (own * norm), 4) AS score
  FROM (SELECT segment, template, sum(w * tw) AS dot FROM w JOIN tw USING (term) GROUP BY segment, template)
    JOIN norm USING (template) JOIN tpl USING (template) JOIN own USING (segment)
),
best AS (SELECT doc_id, license, score FROM seg JOIN score USING (segment) WHERE score >= {license_scan.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
m AS (SELECT f.doc_id, repo, path, dir, is_license, license, score FROM f LEFT JOIN best USING (doc_id)),
holder AS (SELECT repo, dir, license, score FROM m WHERE is_license AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo, dir ORDER BY score DESC, license) = 1),
up AS (SELECT m.doc_id, h.dir, h.license, h.score FROM m JOIN holder h ON m.repo = h.repo AND (m.dir = h.dir OR starts_with(m.dir, h.dir || '/'))
  WHERE m.license IS NULL QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY length(h.dir) DESC) = 1)
SELECT m.doc_id, m.repo, m.path, coalesce(m.license, up.license) AS license, coalesce(m.score, up.score) AS score,
  CASE WHEN m.license IS NOT NULL THEN 'own' WHEN up.license IS NOT NULL THEN 'inherited' END AS how,
  CASE WHEN m.license IS NOT NULL THEN m.dir ELSE up.dir END AS from_dir
FROM m LEFT JOIN up USING (doc_id)"""


@register("op8_license_scan", _OP8)
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(spark.sql(_FILES.replace("FROM documents", "FROM {docs}"), docs=docs))
