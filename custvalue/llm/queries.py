"""The registered queries of the corpus operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from custvalue.bindings.registry import query, table
from custvalue.llm import (
    collocations,
    cotraining,
    hosts,
    impact,
    jaccard,
    langid,
    licenses,
    mixing,
    packing,
    rules,
    spellings,
    substrings,
    warc,
)
from custvalue.llm.shared import shared_folder

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, p, list_slice(w, p, p + 19) AS run
  FROM d, unnest(range(1, len(w) - 18)) AS u(p) WHERE len(w) >= 20
),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS r FROM s
  ) WHERE r > 1
),
gone AS (
  SELECT DISTINCT doc_id, p + i AS p FROM later, unnest(range(0, 20)) AS u(i)
),
lost AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(
    [x FOR x, i IN w IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""


@query(_OP4_SQL)
def op4_substring_dedup(spark, sf):
    stripped = substrings.without_repeats(table(spark, sf, "documents"))
    return stripped.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') AS run
  FROM d, unnest(range(1, len(w) - 3)) AS u(p) WHERE len(w) >= 5
),
again AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs
  ) WHERE n > 1
),
repeats AS (
  SELECT doc_id, count(DISTINCT p + i) AS n FROM again, unnest(range(0, 5)) AS u(i) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM d, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[\x00-\x40\x5b-\x60\x7b-\x7f]', '', 'g')) AS n_letters
  FROM d LEFT JOIN repeats r ON d.doc_id = r.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 100 * n_letters < 50 * word_chars) AS kept
FROM f
"""


@query(_OP9_SQL)
def op9_quality_rules(spark, sf):
    entries = rules.ledger(table(spark, sf, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.kept(rules.BASE)).alias("base_failed"),
        rules.kept(rules.CURRENT).alias("kept"),
    )


# The vocabulary file and its place are the installed package's matter; ids come from it alone.
def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)
    )
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out)


@query()
def op2_source_mix(spark, sf):
    copies = mixing.schedule(table(spark, sf, "documents"))
    return copies.groupBy("row").agg(
        F.first("id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("words").alias("taken"),
    ).drop("row")


@query()
def op8_best_fit_packing(spark, sf):
    return packing.packed(packing.pieces(table(spark, sf, "documents"), vocabulary()))


_OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(p) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN sizes i ON x = i.doc_id JOIN sizes j ON y = j.doc_id
  WHERE 100 * c >= 80 * (i.n + j.n - c)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""


@query(_OP10_SQL)
def op10_jaccard_join(spark, sf):
    return jaccard.similar_groups(table(spark, sf, "documents"))


RULES = (
    hosts.Rule("net/", "block"),
    hosts.Rule("example.net/en/", "allow"),
    hosts.Rule("example.com/de/", "block"),
    hosts.Rule("org/fr/", "allow"),
)

_KAPPA = """
  SELECT CASE WHEN room IS NULL OR room = 0 THEN 10.0
    ELSE (1 - least(greatest(over / room, 0.001), 0.5)) / least(greatest(over / room, 0.001), 0.5)
    END AS k
  FROM (
    SELECT sum(b2 - p * b - p * (1 - p) * (c - 1)) AS over,
      sum(p * (1 - p) * (n - n2 / n - (c - 1))) AS room
    FROM (
      SELECT count(*) AS c, sum(n) AS n, sum(bad) AS b, sum(n * n) AS n2,
        sum(bad * bad / n) AS b2, sum(bad) / sum(n) AS p
      FROM {children} GROUP BY {parent}
    ) WHERE c > 1
  )
"""

def _posterior(tag, rows):
    """Steps of the lower bounds (table ``steps``) from the outcomes of some rows, as SQL."""
    kappa = {k: _KAPPA.format(children=f"{k}{tag}", parent=v)
             for k, v in (("h", "domain"), ("d", "suffix"), ("s", "everything"))}
    return f"""
r{tag} AS (SELECT * FROM outcomes WHERE {rows}),
h{tag} AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
  FROM r{tag} GROUP BY ALL),
d{tag} AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h{tag} GROUP BY ALL),
s{tag} AS (SELECT suffix, 0 AS everything, sum(n) AS n, sum(bad) AS bad FROM d{tag} GROUP BY suffix),
t{tag} AS (SELECT coalesce(sum(bad) / sum(n), 0) AS m FROM s{tag}),
kh{tag} AS ({kappa["h"]}),
kd{tag} AS ({kappa["d"]}),
ks{tag} AS ({kappa["s"]}),
sm{tag} AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s{tag}, ks{tag}, t{tag}),
dm{tag} AS (SELECT d.domain, (bad + k * m) / (n + k) AS m
  FROM d{tag} d JOIN sm{tag} USING (suffix), kd{tag}),
post{tag} AS (
  SELECT host AS key, bad + k * m AS a, n - bad + k * (1 - m) AS b
  FROM h{tag} JOIN dm{tag} USING (domain), kh{tag}
  UNION ALL SELECT '/' || domain, k * m, k * (1 - m) FROM dm{tag}, kh{tag}
  UNION ALL SELECT '//' || suffix, k * m, k * (1 - m) FROM sm{tag}, kd{tag}
),
parts{tag} AS (
  SELECT key, a, greatest(a, 1.0) AS x, greatest(b, 1.0) AS y,
    1 / (2 * greatest(a, 1.0) - 1) AS i, 1 / (2 * greatest(b, 1.0) - 1) AS j,
    (1.645::DOUBLE * 1.645 - 3) / 6 AS lean FROM post{tag}
),
quantiles{tag} AS (
  SELECT key, least(a, 1.0) * x / (x + y * exp(2 * (1.645::DOUBLE * sqrt(2 / (i + j) + lean)
    / (2 / (i + j)) - (j - i) * (lean + 5::DOUBLE / 6 - 2 / (3 * (2 / (i + j))))))) AS bound
  FROM parts{tag}
),
steps{tag} AS (
  SELECT host, floor(1000 * coalesce(b1.bound, b2.bound, b3.bound, t{tag}.m))::INTEGER AS step
  FROM (SELECT DISTINCT host, domain, suffix FROM p) CROSS JOIN t{tag}
  LEFT JOIN quantiles{tag} b1 ON b1.key = host
  LEFT JOIN quantiles{tag} b2 ON b2.key = '/' || domain
  LEFT JOIN quantiles{tag} b3 ON b3.key = '//' || suffix
)"""


_OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
),
q AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(nullif(regexp_extract(rest, '^[^/?#]*/[^/?#]*/([0-9]+)', 1), '') AS BIGINT) AS about
  FROM u
),
p AS (
  SELECT *, split_part(host, '.', -1) AS suffix,
    CASE WHEN contains(host, '.')
      THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%'
        THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%'
        THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    END AS rule
  FROM q
),
known AS (SELECT doc_id, max(1 - quality) AS bad FROM labels
  WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT p.*, bad FROM p JOIN known ON about = doc_id WHERE host <> ''),
{_posterior("0", "coalesce(page_id % 2, 0) = 0")},
gains AS (
  SELECT step, sum(5 * bad - (1 - bad)) AS gain FROM (
    SELECT p.*, bad FROM p JOIN known ON about = doc_id
    WHERE rule IS NULL AND coalesce(page_id % 2, 0) <> 0
  ) JOIN steps0 USING (host) GROUP BY step
),
sums AS (SELECT step, sum(gain) OVER (ORDER BY step DESC) AS gain FROM gains),
lim AS (SELECT coalesce(max(step), 2000) AS least_step FROM sums
  WHERE gain > 0 AND gain = (SELECT max(gain) FROM sums)),
{_posterior("", "true")}
SELECT page_id, p.host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN step >= least_step THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN steps USING (host) CROSS JOIN lim
"""


@query(_OP3_SQL)
def op3_url_filter(spark, sf):
    """The outcome of a page is the label of the document that its path names by number."""
    about = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/([0-9]+)", 1)
    labels = table(spark, sf, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(
        F.max(1 - F.col("quality")).alias("bad")
    )
    pages = table(spark, sf, "pages").select(
        "page_id", "url", about.try_cast("bigint").alias("about")
    )
    same = F.struct("about") == F.struct("doc_id")
    judged = hosts.judged(pages.join(labels, same, "left"), RULES)
    return judged.drop("bad_bound")


_OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum([a * c.v[i] FOR a, i IN q.v])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s
) WHERE rank <= 20
"""


@query(_OP5_SQL)
def op5_exact_top_k(spark, sf):
    return impact.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


_OP6_SQL = """
WITH b AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
),
x AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM b
),
y AS (
  SELECT page_id, payload_bytes, list_reduce([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)
    FOR v IN [('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)]
  ], lambda a, c: a || c) AS payload_digest FROM x
),
f AS (SELECT payload_digest, min(page_id) AS first FROM y GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM y JOIN f USING (payload_digest)
"""


@query(_OP6_SQL)
def op6_warc_round_trip(spark, sf):
    folder = shared_folder(spark)
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_captures(spark, folder, with_payload=False).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query()
def op7_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = cotraining.fit(docs, labels.select("doc_id", (1 - F.col("quality")).alias("bad")))
    scored = cotraining.scored(docs, model)
    return scored.select("doc_id", "p_text", "p_metadata", "score", "accepted")


_OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
  )
),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase, count(*) AS f
  FROM pieces, unnest(range(1, len(w) + 1)) AS u(p), unnest(range(1, 6)) AS t(k)
  WHERE p + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j, n, x.f AS l, y.f AS r,
    ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, j + 1, c.k), ' ')
  JOIN total ON total.lang = c.lang
),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
),
alone AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f t WHERE t.lang = s.lang AND t.k > s.k AND 100 * t.f >= 100 * s.a
      AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM alone
) WHERE rank <= 2000
"""


@query(_OP11_SQL)
def op11_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query()
def op12_license_scan(spark, sf):
    return licenses.scanned(table(spark, sf, "documents"))


_OP13_SQL = r"""
WITH t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS r(i)
),
run AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
),
x AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM run),
summed AS (
  SELECT run, n, xor(list_reduce(
    list_concat([4294967295],
      [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(len(x) // 2)]),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM x, t
),
v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0
      THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
      ELSE run END AS word FROM summed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short
  FROM v, unnest(range(length(word))) AS u(i)
),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM less a JOIN less b USING (short, i)
  WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON l.short = v.word
  UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON l.short = v.word
),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS m
  FROM near GROUP BY word
),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form,
    CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word
),
chain AS (
  WITH RECURSIVE c(word, root, step) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN forms f ON c.root = f.word
    WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(root, step) AS root FROM c GROUP BY word
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain ON forms.word = chain.word
"""


@query(_OP13_SQL)
def op13_spelling_variants(spark, sf):
    return spellings.variants_of(table(spark, sf, "documents"))
