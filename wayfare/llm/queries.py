"""The registered queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import chat, decontaminate, dominance, fim, html_text, language, neardup, packing, quality, sharding, topk, toxicity, url_filter
from wayfare.llm.common import table

URL_RULES = [url_filter.Rule("block", "com/en/"), url_filter.Rule("allow", "example.com/en/7"), url_filter.Rule("allow", "net/de/"), url_filter.Rule("block", "example.net/de/8"), url_filter.Rule("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.exchanges(table(spark, sf_dir, "conversations")), [chat.SAY])


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.regular_tree(8), sharding.regular_tree(9))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    stats = quality.measured(table(spark, sf_dir, "documents"))
    return quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every sale, the sales of its hour or earlier whose total is a higher whole number."""
    return dominance.sales_above(table(spark, sf_dir, "sales"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-the-middle, as digests of the output and of what is restored from it."""
    return fim.transform(table(spark, sf_dir, "documents"), outputs=False)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_url_filter, op4_topk, op5_chat, op6_neardup, op7_sharding, op8_language, op9_packing, op10_decontaminate, op11_quality, op12_dominance, op13_fill_in_middle)}


def _url_sql() -> str:
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    strict, soft = (" + ".join(hit(t) for t in terms) for terms in (url_filter.STRICT_TERMS, url_filter.SOFT_TERMS))
    chain = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(URL_RULES, key=lambda r: -len(r.text)))
    verdicts = " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in URL_RULES)
    return f"""
WITH low AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM low),
ruled AS (SELECT *, CASE {chain} END AS rule, least({url_filter.REJECT_AT}, {url_filter.REJECT_AT} * ({strict}) + {soft}) AS term_weight FROM parted)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN term_weight >= {url_filter.REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict, CAST(term_weight AS INT) AS term_weight FROM ruled"""


_DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_CHAT_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(role = 'assistant', FALSE) AS reply, length(coalesce(text, '')) AS n FROM conversations),
said AS (SELECT *, 't' || (CASE WHEN reply THEN turn - 1 ELSE turn END) AS call_id, CASE WHEN NOT reply AND n % {chat.REACH} <> turn THEN n % {chat.REACH} END AS dep,
    CASE WHEN reply THEN '{{"content":' || to_json(text) || ',"id":"t' || (turn - 1) || '","role":' || to_json(role) || ',"type":"result"}}'
        ELSE '{{"arguments":{{"role":' || to_json(role) || (CASE WHEN text = '' THEN '' ELSE ',"text":' || to_json(text) END) || ',"turn":' || (CASE WHEN n % {chat.ODD} = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END) || '}},"id":"t' || turn || '","name":"say","role":' || to_json(role) || ',"type":"call"}}' END AS json FROM c),
calls AS (SELECT conv_id, turn, min(json) AS json, arg_min(coalesce(dep, -1), json) AS dep FROM said WHERE NOT reply GROUP BY conv_id, turn),
edges AS (SELECT a.conv_id, a.turn, a.dep FROM calls a JOIN calls b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.dep = b.turn),
odd AS (SELECT DISTINCT conv_id FROM edges WHERE dep >= turn),
todo AS (SELECT calls.* FROM calls JOIN odd ON calls.conv_id IS NOT DISTINCT FROM odd.conv_id),
staged AS (SELECT conv_id, turn, 0 AS stage FROM todo WHERE NOT EXISTS (FROM edges e WHERE e.conv_id IS NOT DISTINCT FROM todo.conv_id AND e.turn = todo.turn)
    UNION ALL SELECT e.conv_id, e.turn, stage + 1 FROM edges e JOIN staged s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.dep = s.turn JOIN odd ON odd.conv_id IS NOT DISTINCT FROM e.conv_id),
answers AS (SELECT conv_id, turn - 1 AS turn, min(json) AS json FROM said WHERE reply GROUP BY conv_id, turn),
told AS (SELECT said.*, calls.json AS call_json, answers.json AS result_json, todo.turn IS NOT NULL AND staged.turn IS NULL AS cycle, coalesce(staged.stage, 0) AS stage,
    array_to_string(list_filter([CASE WHEN coalesce(role NOT IN ('system', 'user'), FALSE) THEN 'role is not allowed' END, CASE WHEN text = '' THEN 'missing text' END, CASE WHEN n % {chat.ODD} = 0 THEN 'turn is not integer' END], lambda x: NOT reply AND x IS NOT NULL), '; ') AS problems
    FROM said LEFT JOIN calls ON calls.conv_id IS NOT DISTINCT FROM said.conv_id AND call_id = 't' || calls.turn LEFT JOIN answers ON answers.conv_id IS NOT DISTINCT FROM said.conv_id AND call_id = 't' || answers.turn
    LEFT JOIN todo ON todo.conv_id IS NOT DISTINCT FROM said.conv_id AND call_id = 't' || todo.turn LEFT JOIN staged ON staged.conv_id IS NOT DISTINCT FROM said.conv_id AND call_id = 't' || staged.turn)
SELECT conv_id, CAST(CASE WHEN cycle THEN NULL ELSE stage END AS INT) AS stage, turn, 0 AS nth, CASE WHEN reply THEN 'result' ELSE 'call' END AS kind, call_id,
    CASE WHEN reply THEN CASE WHEN call_json IS NULL THEN 'orphan' WHEN result_json < json THEN 'duplicate' ELSE 'ok' END
        WHEN call_json < json THEN 'duplicate' WHEN cycle THEN 'cycle' WHEN problems <> '' THEN 'invalid' WHEN result_json IS NULL THEN 'unanswered' ELSE 'ok' END AS status, problems, json
FROM told"""

def _sharding_sql() -> str:
    """The tables: leaves of both trees, and the bytes' table of crc32, from its polynomial."""
    places = ", ".join(f"({grown}, '/{x.region}/{x.rack}/{x.shard}', {x.weight!r}e0, {x.shard})" for grown, n in ((0, 8), (1, 9)) for x in sharding.regular_tree(n))
    return f"""
WITH leaf(grown, place, weight, shard) AS (VALUES {places}),
tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS body FROM documents),
drawn AS (SELECT row, grown, arg_min(shard, -ln((CAST('0x' || substr(md5(key || place), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0) / weight) AS shard FROM d, leaf GROUP BY row, grown),
placed AS (SELECT doc_id, octet_length(body) + 1 AS size, a.shard, b.shard AS grown_shard, CAST('0x' || substr(md5(key), 1, 3) AS BIGINT) % {sharding.SLOT_BUCKETS} AS bucket,
    xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(body), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS text_crc32
    FROM d JOIN drawn a ON a.row = d.row AND a.grown = 0 JOIN drawn b ON b.row = d.row AND b.grown = 1, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM placed"""


_DOMINANCE_SQL = """
WITH tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
s AS (SELECT sale_id, CAST(floor(epoch_us(sold_at) / 1000000 / 3600) AS BIGINT) AS slot, CAST(CASE WHEN isfinite(total) THEN floor(floor(100e0 * total + 0.5e0) / 100e0) END AS BIGINT) AS level,
    1 + xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(coalesce(CAST(sale_id AS VARCHAR), ''), '.'), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 2 AS weight FROM sales, tab),
cells AS (SELECT slot, level, count(*) AS n, sum(weight) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
above AS (SELECT a.slot, a.level, coalesce(sum(b.n), 0) AS n, coalesce(sum(b.w), 0) AS w FROM cells a LEFT JOIN cells b ON b.slot <= a.slot AND b.level > a.level GROUP BY a.slot, a.level)
SELECT sale_id, s.slot, s.level, CAST(n AS BIGINT) AS n_sales, CAST(w AS BIGINT) AS n_rows FROM s LEFT JOIN above ON s.slot = above.slot AND s.level = above.level"""

_FIM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS q,
    CASE WHEN t = '' OR contains(t, '{fim.PREFIX}') OR contains(t, '{fim.SUFFIX}') OR contains(t, '{fim.MIDDLE}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {fim.CUT_OF_100} THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {fim.SUFFIX_FIRST_OF_100} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(p, q) AS a, greatest(p, q) AS b FROM h),
parts AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""

ORACLE_SQL = {"op12_dominance": _DOMINANCE_SQL, "op13_fill_in_middle": _FIM_SQL, "op7_sharding": _sharding_sql(), "op4_topk": _TOPK_SQL, "op5_chat": _CHAT_SQL, "op3_url_filter": _url_sql(), "op10_decontaminate": _DECONTAMINATE_SQL}
