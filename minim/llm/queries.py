"""The numbered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register under the function's name; `sql` is its DuckDB counterpart, left out where SQL cannot express it."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.quality import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query("""
WITH line AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, p, lines[p] AS line,
         translate(trim(lines[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM line)),
owner AS (SELECT k, min(doc_id) AS first_doc FROM numbered WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT n.*, o.first_doc IS NOT NULL AND o.first_doc <> n.doc_id AS gone FROM numbered n LEFT JOIN owner o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.line_dedup import apply_bitmaps, keep_bitmaps

    documents = table(spark, sf_dir, "documents")
    return apply_bitmaps(documents, keep_bitmaps(documents)).drop("text")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN first_page END AS refers_to
FROM f
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


#: Target weights of the mix by level of the tree; groups without one weigh 1.
MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}


def _weight_sql(level: str) -> str:
    return "CASE " + level + " ".join(["", *(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())]) + " ELSE 1 END"


def _share_sql(name: str, level: str, group: str, parent: str) -> str:
    """One level of the budget: siblings of `parent` share its budget `b` by weight, up to what each can hold."""
    over = f"PARTITION BY {parent}" if parent else ""
    source = f"(SELECT {group}, sum(cap) AS cap, {_weight_sql(level)} AS w FROM leaf GROUP BY {group})"
    joined = f"{source} JOIN {'share_' + parent.split(', ')[-1]} USING ({parent})" if parent else f"{source}, whole"
    return f"""
{name}_ranked AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM {joined} WINDOW o AS ({over} ORDER BY cap / w, {level})),
{name}_full AS (SELECT *, (b - filled) * w >= cap * weight AS f FROM {name}_ranked),
{name}_rest AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({over}) AS held, sum(CASE WHEN f THEN 0 ELSE w END) OVER ({over}) AS rest FROM {name}_full),
share_{level} AS (SELECT {group}, CASE WHEN f THEN cap ELSE ((b - held) * w) // rest END AS b FROM {name}_rest)"""


_MIX_SQL = rf"""
WITH doc AS (
  SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4, 0) AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS available, 3 * sum(n_tokens) AS cap FROM doc GROUP BY ALL),
whole AS (SELECT sum(available) // 2 AS b FROM leaf),
{_share_sql("d", "domain", "domain", "").strip()},
{_share_sql("l", "lang", "domain, lang", "domain").strip()},
{_share_sql("s", "source", "domain, lang, source", "domain, lang").strip()},
part AS (SELECT domain, lang, source, b // available AS epochs, b % available AS rest FROM leaf JOIN share_source USING (domain, lang, source)),
placed AS (
  SELECT doc.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '17', CAST(epochs AS BIGINT), doc_id))) AS upto
  FROM doc JOIN part USING (domain, lang, source)),
taken AS (SELECT *, greatest(0, least(n_tokens, rest - upto + n_tokens)) AS prefix_tokens FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(prefix_tokens AS BIGINT) AS prefix_tokens,
       CAST(epochs * n_tokens + prefix_tokens AS BIGINT) AS total_tokens
FROM taken
"""


@query(_MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)


_JACCARD_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM doc WHERE len(w) BETWEEN 1 AND 2),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v AS other FROM reach r JOIN link l ON l.u = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN size s USING (doc_id) GROUP BY d.doc_id
"""


@query(_JACCARD_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.ngram_join import Rule, ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), Rule(width=3, num=90, den=100))


@query()
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.secrets_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


#: Words that mark a host whose pages are not wanted, as whole tokens of the host.
HOST_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
#: Ends of paths that hold forms and not text.
FORM_PATHS = ("/cart", "/checkout", "/login", "/signup", "/wp-login.php")
#: Host and path of the stated rules, and their verdicts.
STATED_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_rules() -> list[tuple]:
    """`(rule, pattern, verdict, tier)`; the stated rules stand above the others."""
    stated = [(host + path, f"||{host}{path}", verdict, 1) for host, path, verdict in STATED_RULES]
    words = [(f"host word {w}", f"||@^{w}^@/", "block", 0) for w in HOST_WORDS]
    return stated + words + [(f"form {p}", f"{p}|", "block", 0) for p in FORM_PATHS]


_URL_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*(.*)', 1) AS rest FROM pages),
stated(rule, h, p, v) AS (VALUES {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in STATED_RULES)}),
words(rule, pattern, w) AS (VALUES {", ".join(f"('host word {w}', '||@^{w}^@/', '{w}')" for w in HOST_WORDS)}),
forms(rule, pattern, e) AS (VALUES {", ".join(f"('form {p}', '{p}|', '{p}')" for p in FORM_PATHS)}),
hit AS (
  SELECT u.*, s.rule AS name, '||' || s.rule AS pattern, s.v, 1 AS tier FROM u, stated s WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  UNION ALL SELECT u.*, w.rule, w.pattern, 'block', 0 FROM u, words w WHERE starts_with(rest, '/') AND regexp_matches(host, '(^|[^A-Za-z0-9])' || w || '([^A-Za-z0-9]|$)')
  UNION ALL SELECT u.*, f.rule, f.pattern, 'block', 0 FROM u, forms f WHERE ends_with(host || rest, e)),
best AS (SELECT page_id, arg_min((name, pattern, v, tier), (-tier, -length(pattern), name)) AS b FROM hit GROUP BY page_id)
SELECT u.page_id, host, path, CASE WHEN b[4] = 1 THEN b[1] END AS rule, b[2] AS pattern, coalesce(b[3], 'allow') AS verdict
FROM u LEFT JOIN best ON best.page_id = u.page_id
"""


@query(_URL_SQL)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from minim.llm.url_filter import RULE, url_verdicts

    found = url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(url_rules(), RULE))
    return found.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("rule")).alias("rule"), "pattern", "verdict")


@query("""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from minim.llm.hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query(r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM piece),
gram AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM word, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidate AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT c.*, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM candidate WHERE size = 3) GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM cut LEFT JOIN longer USING (lang, phrase) JOIN total USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from minim.llm.collocations import top_collocations

    return top_collocations(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)
