"""Thin queries over the test tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html, media, mixing, pieces, pivots, sharding, simhash, toxicity, trie, urls, warc

TOKENIZER = "piece_bpe_32k.model"
RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "shards", "places")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, passages=True)
    return scored.select("doc_id", F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).drop("media")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(table(spark, sf_dir, "documents"), tokenizer())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, where, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_trie(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: host, path and rule."""
    return urls.judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: sizes and targets of the sources."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.word_count("text").alias("size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 4).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1,
    "op2_mix_sources": op2,
    "op3_sentencepiece": op3,
    "op4_toxicity": op4,
    "op5_url_filters": op5,
    "op6_sharding": op6,
    "op7_media_columns": op7,
    "op8_token_counts": op8,
    "op9_html_extraction": op9,
    "op10_embedding_near_dedup": op10,
    "op11_warc": op11,
    "op12_conversation_trie": op12,
    "op13_source_divergence": op13,
    "url_rules": url_rules,
    "mix_targets": mix_targets,
}

_RULE = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))

#: The hashes, models and tokenizers of the others cannot be written in SQL: they have tests against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_embedding_near_dedup": """WITH RECURSIVE good AS (SELECT vec_id, embedding::double[] AS e FROM embeddings
WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
near AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT near.v, reach.r FROM reach JOIN near ON reach.id = near.u),
component AS (SELECT id, min(r) AS r FROM reach GROUP BY id), degree AS (SELECT u, count(*) AS n FROM near GROUP BY u)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, r AS component_id, id = r AS kept FROM component LEFT JOIN degree ON u = id""",
    "op12_conversation_trie": r"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint),
lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT ids.c, 0 AS half, pos, role, text FROM ids JOIN own ON own.c = ids.c - ids.c % 20 WHERE pos < h UNION ALL SELECT ids.c, 1, pos, role, text FROM ids JOIN own ON own.c = ids.c WHERE pos >= h),
convs AS (SELECT ids.c, coalesce(list({'role': role, 'text': text} ORDER BY half, pos) FILTER (half IS NOT NULL), []) AS turns FROM ids LEFT JOIN rebuilt ON rebuilt.c = ids.c GROUP BY ids.c),
member AS (SELECT c, unnest(range(len(turns) + 1)) AS depth, turns FROM convs),
node AS (SELECT depth, turns[:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (len(turns) = depth), '')) AS ends_sha256 FROM member GROUP BY 1, 2),
cost AS (SELECT *, CASE depth WHEN 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM node),
child AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
below AS (SELECT path[:d] AS path, d AS depth, sum(saved)::bigint AS saved_tokens, (count(*) FILTER (leaf))::bigint AS n_leaves
FROM (SELECT cost.path, saved, child.n IS NULL AS leaf, unnest(range(cost.depth + 1)) AS d FROM cost LEFT JOIN child ON child.depth = cost.depth AND child.path = cost.path) GROUP BY 1, 2)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN below ON below.depth = node.depth AND below.path = node.path LEFT JOIN child ON child.depth = node.depth AND child.path = node.path LEFT JOIN node up ON up.depth = node.depth - 1 AND up.path = node.path[:node.depth - 1]""",
    "op13_source_divergence": r"""WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
used AS (SELECT i, lang, source, unnest(words) AS term FROM docs), kept AS (SELECT lang, term, count(*) AS total FROM used GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
grp AS (SELECT DISTINCT lang, source FROM docs), counted AS (SELECT lang, source, term, count(*) AS n FROM used GROUP BY 1, 2, 3),
grid AS (SELECT grp.lang, grp.source, kept.term, coalesce(n, 0)::hugeint AS n, total::hugeint AS total FROM grp JOIN kept ON kept.lang = grp.lang LEFT JOIN counted ON counted.lang = grp.lang AND counted.source = grp.source AND counted.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g)::hugeint AS p, 1 + (1000000000 * (total + 2)) // (sum(total) OVER g + 2 * count(*) OVER g)::hugeint AS q FROM grid WINDOW g AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::bigint AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op11_warc": """WITH held AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
seen AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, unhex(sha1(payload)) AS raw FROM held),
bits AS (SELECT *, list_aggregate(list_transform(range(20), lambda i: right('0000000' || bin(('0x' || substr(hex(raw), 2 * i::int + 1, 2))::int), 8)), 'string_agg', '') AS b FROM seen)
SELECT page_id, octet_length(payload)::bigint AS payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce([0::bigint] || list_transform(string_split(substr(b, 5 * k::int + 1, 5), ''), lambda x: x::bigint), lambda v, x: 2 * v + x)::int + 1, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM bits""",
    "url_rules": f"""WITH cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) SELECT page_id, host, path, CASE {_RULE} END AS rule FROM cut""",
    "mix_targets": r"""WITH size AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint AS source_size FROM documents GROUP BY source),
weighed AS (SELECT source, source_size, 2.0::double * source_size AS cap, [3.0::double, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM size),
level AS (SELECT k.cap / k.w AS ratio, ((SELECT 1.5::double * sum(source_size) FROM size) - coalesce(sum(o.cap) FILTER (o.cap / o.w < k.cap / k.w), 0)) / sum(o.w) FILTER (o.cap / o.w >= k.cap / k.w) AS l FROM weighed k, weighed o GROUP BY k.source, k.cap, k.w)
SELECT source, source_size, round(least(cap, coalesce((SELECT max(l) FROM level WHERE l <= ratio) * w, cap)), 4) AS target FROM weighed""",
}
