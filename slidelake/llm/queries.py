"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from slidelake.llm.toxicity import learn, scored, training_labels

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, training_labels(_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    found = scored(docs, lexicon)
    return found.select("doc_id", held_out.alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.hits").alias("n_hits"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.mixing import mixed, rates

    docs = _table(spark, sf_dir, "documents")
    return mixed(docs, rates(docs, temperature=0.5), seed=42, added=("copy", "shuffle_key"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.ngram_join import near_components

    return near_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.warc import capture_histories

    return capture_histories(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.records import token_records

    return token_records(_table(spark, sf_dir, "documents"), end_id=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from slidelake.llm.quality import quality

    found = quality(_table(spark, sf_dir, "documents"))
    return found.withColumn("class_js", F.round("class_js", 6)).withColumn("word_js", F.round("word_js", 6))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.centroids import clusters, whole_vectors

    return clusters(whole_vectors(_table(spark, sf_dir, "embeddings")), k=8, rounds=10, seed=3)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidelake.llm.languages import language_of

    return language_of(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage, by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {"op2_mixing": OP2, "op3_ngram_join": OP3, "op4_warc": OP4, "op8_exact_dedup": OP8, "op10_quality": OP10, "op11_spelling": OP11, "op12_centroids": _op12_sql()}


OP2 = r"""
WITH s AS (SELECT coalesce(source, '') AS src, CAST(sum(CASE WHEN n_chars > 0 THEN n_chars ELSE length(coalesce(text, '')) END) AS DOUBLE) AS size FROM documents GROUP BY 1),
t AS (SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_goal FROM s WHERE size > 0),
r AS (SELECT src, CASE WHEN size > 0 THEN sqrt(size) / all_goal / (size / all_size) ELSE 1.0 END AS rate FROM s, t),
q AS (SELECT src, greatest(1, CAST(ceil(rate / 8.0) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / 8.0) AS INT)) AS part FROM r),
cdf AS (SELECT src, k, sum(exp(k * ln(part) - part - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS p FROM q, range(0, 54) t(k)),
d AS (SELECT doc_id, coalesce(source, '') AS src FROM documents),
u AS (SELECT doc_id, src, j, CAST('0x' || substr(md5('42' || CASE WHEN j = 0 THEN '' ELSE ' part ' || j END || '|' || doc_id), 1, 13) AS BIGINT) / pow(2, 52) AS u
      FROM (SELECT doc_id, src, unnest(range(0, parts)) AS j FROM d JOIN q USING (src))),
n AS (SELECT doc_id, count(*) FILTER (p <= u) AS n FROM u JOIN cdf USING (src) GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, md5('order 42|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT documents.*, unnest(range(0, n)) AS copy FROM documents JOIN n USING (doc_id))
"""


OP8 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
c AS (WITH RECURSIVE r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached) SELECT node, min(reached) AS least FROM r GROUP BY node)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = documents.doc_id
"""


OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CASE WHEN split_part(coalesce(url, ''), '://', 2) <> '' THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END AS bare FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS hex, split_part(bare, '/', 1) AS host FROM p),
k AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, first,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * i // 4 + 1 AS INT), 2) AS BIGINT) >> (3 - 5 * i % 4)) & 31) AS INT), 1)), '') AS payload_digest,
             array_to_string(list_reverse(string_split(lower(split_part(host, ':', 1)), '.')), ',') || ')' || substr(bare, length(host) + 1) AS url_key,
             strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
      FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS index_place
FROM k
"""


# b: a row per document; g: the common words; h: how often a document has each; s: their shares
OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l, length(coalesce(text, '')) AS c, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, l, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
v AS (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n
      FROM (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY place)) WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT place + k) AS n FROM v, range(3) z(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, l, c, len(w) AS n_words, c - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS n_space,
             c - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
             c - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper, c - length(regexp_replace(t, '[0-9]+', '', 'g')) AS n_digit,
             c - length(regexp_replace(t, '[.,;:!?''"\-]+', '', 'g')) AS n_stop,
             list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT m.*, c - n_space AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
             [n_upper, n_digit, n_stop, n_space, n_symbols, c - n_upper - n_digit - n_stop - n_space - n_symbols] AS classes FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT DISTINCT doc_id, x.l, trim(word, '.,;:!?"''()') AS v FROM x JOIN b USING (doc_id) WHERE n_words >= 50 GROUP BY doc_id, x.l, word HAVING count(*) > 1),
g AS (SELECT l, v, row_number() OVER (PARTITION BY l ORDER BY n DESC, v) AS i FROM (SELECT l, v, count(*) AS n FROM f WHERE regexp_matches(v, '^[\p{L}\p{M}]+$') GROUP BY l, v) QUALIFY i <= 64),
h AS (SELECT doc_id, x.l, i, count(*) AS n FROM x JOIN g ON g.l = x.l AND g.v = trim(word, '.,;:!?"''()') GROUP BY ALL),
good AS (SELECT * FROM b WHERE base_failed = (SELECT min(o.base_failed) FROM b o WHERE o.l = b.l)),
tot AS (SELECT l, sum(n_words) AS words FROM good GROUP BY l),
cls AS (SELECT l, k, sum(classes[k]) AS n FROM good, range(1, 7) z(k) GROUP BY l, k),
used AS (SELECT h.l, i, sum(n) AS n FROM h JOIN good USING (doc_id) GROUP BY h.l, i),
s AS (SELECT g.l, g.i, coalesce(used.n, 0) / tot.words AS q FROM g JOIN tot USING (l) LEFT JOIN used ON used.l = g.l AND used.i = g.i
      WHERE tot.words > 0 AND g.i <= (SELECT max(o.i) FROM used o WHERE o.l = g.l)),
lang AS (SELECT tot.l, coalesce(sum(q), 0) AS common, greatest(0, 1 - coalesce(sum(q), 0)) AS other FROM tot LEFT JOIN s USING (l) GROUP BY tot.l),
e AS (SELECT *, sqrt(greatest(0, log2(2 / (1 + other)) + CASE WHEN other > 0 THEN other * log2(2 * other / (1 + other)) ELSE 0 END + common) / 2) AS without FROM lang),
hp AS (SELECT doc_id, sum(p) AS p, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) AS terms
       FROM (SELECT doc_id, h.n / n_words AS p, q FROM h JOIN b USING (doc_id) JOIN s ON s.l = h.l AND s.i = h.i) GROUP BY doc_id),
y AS (SELECT b.doc_id, greatest(0, 1 - coalesce(p, 0)) AS p, other AS q, coalesce(terms, 0) + common - coalesce(hp.q, 0) AS rest, without FROM b JOIN e USING (l) LEFT JOIN hp USING (doc_id)),
cp AS (SELECT doc_id, classes[k] / c AS p, n / sum(n) OVER (PARTITION BY doc_id) AS q FROM b JOIN cls USING (l) WHERE c >= 200),
cj AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2) AS class_js FROM cp GROUP BY doc_id),
j AS (SELECT b.*, without, class_js,
             CASE WHEN n_words >= 50 THEN sqrt(greatest(0, rest + CASE WHEN y.p > 0 THEN y.p * log2(2 * y.p / (y.p + y.q)) ELSE 0 END + CASE WHEN y.q > 0 THEN y.q * log2(2 * y.q / (y.p + y.q)) ELSE 0 END) / 2) END AS word_js,
             floor(2 * ln(greatest(c, 1)) / ln(2)) AS chars, floor(2 * ln(greatest(n_words, 1)) / ln(2)) AS words
      FROM b JOIN y USING (doc_id) LEFT JOIN cj USING (doc_id)),
bc AS (SELECT l, chars, quantile_cont(ceil(class_js * 1000), [0.25, 0.5, 0.75]) AS q FROM j WHERE class_js IS NOT NULL AND NOT base_failed GROUP BY l, chars),
bw AS (SELECT l, words, quantile_cont(ceil(word_js * 1000), [0.25, 0.5, 0.75]) AS q FROM j WHERE word_js IS NOT NULL AND NOT base_failed GROUP BY l, words),
k AS (SELECT j.*, bw.q[2] / 1000 AS middle, bc.q[2] / 1000 + 8 * greatest(0.02, (bc.q[3] - bc.q[1]) / 1000) AS of_class, bw.q[2] / 1000 + 3 * greatest(0.02, (bw.q[3] - bw.q[1]) / 1000) AS of_word
      FROM j LEFT JOIN bc ON bc.l = j.l AND bc.chars = j.chars LEFT JOIN bw ON bw.l = j.l AND bw.words = j.words)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_js <= least(of_class, 0.35), true) AND coalesce(word_js <= least(CASE WHEN middle < without THEN least(of_word, 0.15 * middle + 0.85 * without) ELSE of_word END, 0.45), true) AS kept,
       round(class_js, 6) AS class_js, round(word_js, 6) AS word_js
FROM k
"""


# t: the table of the CRC-32; b: what is summed; v: words without one code point
OP11 = r"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
b AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(range(0, length(h), 2), lambda c, i: xor(c >> 8, t.t[xor(c & 255, CAST('0x' || substr(h, i + 1, 2) AS BIGINT)) + 1]), 4294967295)) AS h FROM b, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) x
      WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.d = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.d = w.word),
g AS (SELECT p.word, count(*) AS n_near, min({'n': -w.n, 'near': near}) AS best FROM p JOIN w ON w.word = near GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.near END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (WITH RECURSIVE y(word, now) AS (SELECT word, word FROM f UNION SELECT y.word, f.form FROM y JOIN f ON f.word = y.now WHERE f.form IS NOT NULL)
      SELECT y.word, y.now AS root FROM y JOIN f ON f.word = y.now WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c USING (word)
"""


def _op12_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out: ci the centroids, ai the assignment to them."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT v.row, v.x, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT row, min({{'d': d, 'c': c}}) AS b FROM d{i} GROUP BY row)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT b.c AS c, j, floor(sum(x[j]) / count(*)) AS m FROM a{i} JOIN v USING (row), range(1, 65) z(j) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(CAST(m AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))")
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS y FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(y, lambda z: CAST(floor(1024 * z) AS BIGINT)) AS x FROM e WHERE len(list_filter(y, lambda z: isfinite(z))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(b.c AS INT) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.c = b.c"""
