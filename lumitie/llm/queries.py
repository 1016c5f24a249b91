"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumitie.llm import (bpe, chat, chunks, decontaminate, divergence, jaccard, langid, neighbours, parsing, pii, secrets, urlfilter,
                         vafile)
from lumitie.llm.urlfilter import Rule
from lumitie.sources.stage import Stage


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs.select("doc_id", "text"), items, Stage(spark, "leaks"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(_read(spark, sf_dir, "documents"), Stage(spark, "chunks"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(_read(spark, sf_dir, "documents"), shared)


URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    stage = Stage(spark, "urls")
    hosts = stage.write(urlfilter.tracking_hosts(pages), "hosts")
    return urlfilter.judge(pages, URL_RULES, hosts, stage)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(turns.unionByName(extra)))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), Stage(spark, "neighbours"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_report(_read(spark, sf_dir, "documents"), Stage(spark, "jaccard"))


#: Key of the registered query; a real run passes its own secret.
PII_KEY = b"lumitie registered query"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, Stage(spark, "pii"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.report(_read(spark, sf_dir, "embeddings"), Stage(spark, "vafile"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.report(_read(spark, sf_dir, "documents"), Stage(spark, "parsing"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), Stage(spark, "divergence"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_substrings": op3_substrings,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_language": op6_language,
    "op7_chat": op7_chat,
    "op8_neighbours": op8_neighbours,
    "op9_jaccard": op9_jaccard,
    "op10_pii": op10_pii,
    "op11_clusters": op11_clusters,
    "op12_suffixes": op12_suffixes,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
dg AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS g
       FROM dw, k WHERE len(w) >= k),
ig AS (SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT)),
              lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS g FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n_item) AS INTEGER) AS n_item,
       count(*) / CAST(any_value(n_item) AS DOUBLE) AS containment
FROM dg JOIN ig USING (k, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)""",
    "op5_url_filter": r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
h AS (SELECT host FROM p WHERE host <> '' GROUP BY host
      HAVING 3 * count(*) FILTER (WHERE regexp_matches(url, '[?&](utm_[a-z]+|ref)=')) >= count(*)),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host IN (SELECT host FROM h) THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op9_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, unnest(list_distinct(list_transform(range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT)),
             lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT rid, doc_id AS root FROM w UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.rid),
c AS (SELECT rid, min(root) AS class_id FROM reach GROUP BY rid),
k AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, count(*) OVER (PARTITION BY class_id) AS class_size
FROM w JOIN c USING (rid) LEFT JOIN k USING (rid)""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
p AS (SELECT lang, source, term, m.n, 1 + CAST(1000000000 AS HUGEINT) * (m.n + 1) // (s.total + v.v) AS p,
             1 + CAST(1000000000 AS HUGEINT) * (m.lang_n + 1) // (v.total + v.v) AS q FROM m JOIN s USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
part AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
         UNION ALL
         SELECT lang, source, 'term', term, (p - q) * (p - q) // q,
                row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM part WHERE part = 'pair' OR rank <= 200""",
}
