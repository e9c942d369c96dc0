"""Registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, chat, pii, quality, url_filters, warc
from quillgraph.llm.collocations import collocations
from quillgraph.llm.embedding_dedup import near_duplicates
from quillgraph.llm.neighbours import nearest
from quillgraph.llm.ngram_join import ngram_classes
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.periodic_runs import periodic_runs, repeated_by_id
from quillgraph.llm.text import vocabulary
from quillgraph.llm.token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl that captured each page in full once and asked for it again once.

    Ids are 2 * page_id for the response (captured on day page_id) and 2 * page_id + 1 for the revisit, which comes later
    by 1000 * (page_id mod 97) days and an hour, under the URL with its scheme and host in capitals and, for some pages,
    before the response. Revisits state the entity tag of their page, only the time of its last modification, or neither.
    """
    day = F.col("page_id") * 86400
    etag, modified = F.concat(F.lit('"'), F.sha1("html"), F.lit('"')), (day - 3600).cast("string")
    headers = lambda *pairs: F.map_filter(F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs)), lambda _, v: v.isNotNull())
    id_, url = F.col("page_id"), F.col("url")
    full = pages.select(
        (id_ * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.lit(200).alias("status"), url, F.timestamp_seconds(day).alias("captured"),
        headers("Content-Type", "text/html", "Content-Length", F.octet_length("html").cast("string"), "ETag", etag, "Last-Modified", modified, "Date", day.cast("string"), "Cache-Control", "max-age=60").alias("headers"),
    )
    again = F.when(id_ % 13 == 0, day - 86400).otherwise(day + (id_ % 97) * 86_400_000 + 3600)
    shouted = F.concat(F.upper(F.regexp_extract(url, "^[^:]*://[^/?#]*", 0)), F.regexp_replace(url, "^[^:]*://[^/?#]*", ""))
    revisit = pages.select(
        (id_ * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.lit(304).alias("status"), shouted.alias("url"), F.timestamp_seconds(again).alias("captured"),
        headers("ETag", F.when((id_ % 7 != 0) & (id_ % 17 != 0), F.concat(F.lit("W/"), etag)), "Last-Modified", F.when((id_ % 7 == 0) & (id_ % 17 != 0), modified), "Date", again.cast("string"),
                "Cache-Control", "max-age=3600", "Content-Length", "0", "Connection", "close, X-Hop", "X-Hop", "a", "X-Served", "again").alias("headers"),
    )
    return full.unionByName(revisit)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bodies = pages.select((F.col("page_id") * 2).alias("record_id"), F.sha2("html", 256).alias("body_sha256"))
    resolved = warc.with_payloads(warc.resolve(crawl(pages)), bodies)
    return resolved.select(
        F.shiftright("record_id", 1).alias("page_id"), "url", "outcome", F.shiftright("response_id", 1).alias("response_page"),
        F.sha2(warc.header_block(F.col("headers")), 256).alias("headers_sha256"), "body_sha256",
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    nodes, conversations = chat.prefix_trees(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    return chat.digests(nodes, conversations)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), repeated_by_id)


#: The longest that fits a page decides.
URL_RULES = [url_filters.Rule(*r) for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled where its path names a labelled document (``/<language>/<doc_id>``): good if that one has quality
    1 and is not toxic, by all of its labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filters.host_and_path(F.col("url"))
    number = F.regexp_extract(path, "^/[a-z]+/([0-9]{1,18})(?![0-9])", 1)
    named = pages.select(host.alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.groupBy("doc_id").agg(F.min(F.when(bad, 0).when(F.col("quality").isNotNull(), 1)).alias("good"))
    return url_filters.judge(pages, url_filters.reputations(named.join(outcomes, "doc_id", "left")), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat": op7_chat,
    "op8_neighbours": op8_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filters": op13_url_filters,
}

_OP1 = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM worded)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) c ON c.doc_id = d.doc_id
"""

_OP4 = """
WITH RECURSIVE able AS MATERIALIZED (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS MATERIALIZED (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM able),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
    WHERE list_dot_product(a.u, b.u) >= 0.93),
reach AS (SELECT DISTINCT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) n ON n.a = e.vec_id
LEFT JOIN (SELECT vec_id, min(other) AS least FROM reach GROUP BY 1) c ON c.vec_id = e.vec_id
"""

_OP5 = r"""
WITH p AS (
    SELECT page_id, html, regexp_replace(url, '#.*$', '') AS plain, page_id * 86400 AS day,
        CASE WHEN page_id % 13 = 0 THEN page_id * 86400 - 86400 ELSE page_id * 86400 + (page_id % 97) * 86400000 + 3600 END AS again FROM pages),
q AS (SELECT *, lower(regexp_extract(plain, '^[^:]*://[^/?]*')) || CASE WHEN regexp_replace(plain, '^[^:]*://[^/?]*', '') LIKE '/%' THEN '' ELSE '/' END || regexp_replace(plain, '^[^:]*://[^/?]*', '') AS u FROM p),
m AS (
    SELECT r.page_id, r.u AS url, f.page_id AS found, f.html, r.again, f.day,
        CASE WHEN f.page_id IS NULL THEN 'no earlier response' WHEN r.page_id % 17 = 0 THEN 'no validator'
            WHEN r.page_id % 7 <> 0 AND r.html = f.html OR r.page_id % 7 = 0 AND r.day = f.day THEN 'resolved' ELSE 'validator mismatch' END AS outcome
    FROM q r ASOF LEFT JOIN q f ON r.u = f.u AND f.day < r.again)
SELECT page_id, url, outcome, CASE WHEN outcome = 'resolved' THEN found END AS response_page,
    CASE WHEN outcome = 'resolved' THEN sha256('cache-control: max-age=3600' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || again || chr(10)
        || 'etag: ' || CASE WHEN page_id % 7 <> 0 THEN 'W/' ELSE '' END || '"' || sha1(html) || '"' || chr(10) || 'last-modified: ' || (day - 3600) || chr(10) || 'x-served: again' || chr(10)) END AS headers_sha256,
    CASE WHEN outcome = 'resolved' THEN sha256(html) END AS body_sha256
FROM m
"""

_OP7 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
        SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
s AS (SELECT *, length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS more,
    length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', '')) AS more_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(length('<turn:></turn>') + 1 + length(role) + more_role + length(text) + more) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS ks(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, s, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT u.lang, u.k, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, CAST(u.a::HUGEINT * u.a::HUGEINT * 1000000 // (x.a::HUGEINT * y.a::HUGEINT) AS BIGINT) AS score FROM cuts u
    JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.s[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.s[u.cut+1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, array_to_string(s[1:k-1], ' ') AS phrase, a FROM c WHERE k > 2 UNION ALL SELECT lang, array_to_string(s[2:], ' '), a FROM c WHERE k > 2) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.m IS NULL OR 100 * o.m < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


def _weight(name: str, n: str, k: str, of: str) -> str:
    """``name`` (w): what the prior of ``of`` (``n``, ``k``, m: prior mean) counts for."""
    rho = f"coalesce(sum(({k} - {n} * m) * ({k} - {n} * m) - {n} * m * (1 - m)) / nullif(sum(({n} - 1) * {n} * m * (1 - m)), 0), 0)"
    return f"{name} AS MATERIALIZED (SELECT 1 / least(greatest({rho}, 1 / 1001e0), 0.5e0) - 1 AS w FROM {of})"


_OP13 = rf"""
WITH h AS MATERIALIZED (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM h),
t AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS site, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(?:[^0-9]|$)', 1), '') AS BIGINT) AS doc_id FROM u),
o AS (SELECT doc_id, min(CASE WHEN quality = 0 OR toxic = 1 THEN 0 WHEN quality IS NOT NULL THEN 1 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS MATERIALIZED (SELECT site, count(good) AS n, coalesce(sum(good), 0) AS k FROM t LEFT JOIN o ON o.doc_id = t.doc_id GROUP BY site),
s2 AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(site, '^[0-9.]*$') OR site LIKE '[%' THEN '' WHEN regexp_matches(site, '(?:^|\.)(?:{"|".join(url_filters.SECOND_LEVEL)})\.[a-z]{{2}}$') THEN regexp_extract(site, '((?:{"|".join(url_filters.SECOND_LEVEL)})\.[a-z]{{2}})$', 1)
    ELSE regexp_extract(site, '([^.]*)$', 1) END AS suffix FROM s),
s3 AS MATERIALIZED (SELECT *, CASE WHEN suffix = '' OR length(suffix) >= length(site) THEN site ELSE regexp_extract(substr(site, 1, length(site) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix END AS domain FROM s2),
dm AS MATERIALIZED (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM s3 GROUP BY 1, 2), sx AS MATERIALIZED (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM dm GROUP BY 1),
top AS MATERIALIZED (SELECT *, ((SELECT sum(sk) FROM sx) - sk + 1e0) / ((SELECT sum(sn) FROM sx) - sn + 2e0) AS m FROM sx), {_weight("w1", "sn", "sk", "top")},
mid AS MATERIALIZED (SELECT domain, dn, dk, (sk - dk + w * m) / (sn - dn + w) AS m FROM dm JOIN top ON top.suffix = dm.suffix, w1), {_weight("w2", "dn", "dk", "mid")},
low AS MATERIALIZED (SELECT site, n, k, (dk - k + w * m) / (dn - n + w) AS m FROM s3 JOIN mid ON mid.domain = s3.domain, w2), {_weight("w3", "n", "k", "low")},
post AS (SELECT site, k + w * m AS g, n - k + w * (1 - m) AS b FROM low, w3),
bad AS (SELECT site FROM post WHERE least(1, g / (g + b) + 1.645e0 * sqrt(g / (g + b) * (1 - g / (g + b)) / (g + b + 1))) < 0.5e0),
ru AS (SELECT page_id, host, path, t.site, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN site IN (FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM ru
"""

ORACLES: dict[str, str] = {"op1_ngram_join": _OP1, "op4_embedding_dedup": _OP4, "op5_warc": _OP5, "op7_chat": _OP7, "op11_collocations": _OP11, "op13_url_filters": _OP13}
