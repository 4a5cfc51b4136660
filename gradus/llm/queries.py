"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify
from .mixing import mixture
from .mixing_lm import language_model_scores
from .near_dedup import near_dedup
from .neighbours import neighbours
from .pieces import encode_decode
from .prefix_trie import conversation_trie
from .secrets import secret_scan
from .sharding import shards
from .token_counts import token_counts
from .toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


#: The checksum is the bytewise table form of CRC-32, its table made from the polynomial.
OP2_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), t AS (
  SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
         list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d CROSS JOIN t
), p AS (
  SELECT *, CAST(sum(size) OVER w - size AS BIGINT) AS start, row_number() OVER w - 1 AS place, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM c WINDOW w AS (ORDER BY doc_id ASC NULLS LAST, text_crc32 ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, CAST(least(15, ((2 * start + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(normal) AS text_sha256
FROM n WINDOW w AS (PARTITION BY normal ORDER BY points DESC, doc_id)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':' || coalesce(source, '') AS name, md5(coalesce(text, '')) AS digest
  FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM n GROUP BY source
), l AS (
  SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS share
  FROM p WINDOW o AS (ORDER BY s / w ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(share, s / w) AS final FROM l WHERE w * share <= 3.0::DOUBLE * s
), t AS (
  SELECT source, s, least(3.0::DOUBLE * s, coalesce(w * final, 3.0::DOUBLE * s)) AS target FROM l CROSS JOIN f
), r AS (
  SELECT n.doc_id, n.size, t.s AS source_size, t.target,
         CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0.0::DOUBLE END AS rate,
         CAST(row_number() OVER (PARTITION BY n.source ORDER BY n.size, md5('gradus-mix:' || n.name), n.digest) AS DOUBLE) AS place,
         CAST('0x' || substr(md5('gradus-mix:' || coalesce(n.source, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) + floor((rate - floor(rate)) * place + u) - floor((rate - floor(rate)) * (place - 1) + u) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?
-
]')) AS s
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(s, '[^ 	]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), f AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM places CROSS JOIN range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), size AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inside AS (
  SELECT lang, k, a, unnest([array_to_string(w[2:], ' '), array_to_string(w[:-2], ' ')]) AS phrase FROM c
), cut AS (
  SELECT lang, phrase, a, unnest(range(1, k)) AS j, w FROM c
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, j, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * cut.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN size ON size.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least
QUALIFY rank <= 2000
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node")


#: Prefixes are lists of digests; the checksum of an id is the bytewise table form of CRC-32.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8
), said AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'d': d, 'w': w} ORDER BY turn ASC NULLS FIRST, d) AS t,
         list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes
  FROM said GROUP BY conv_id
), headed AS (
  SELECT conv_id, t, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM own CROSS JOIN tab
), rebuilt AS (
  SELECT x.conv_id, list_concat(coalesce(list_slice(b.t, 1, x.h), []), list_slice(x.t, x.h + 1, len(x.t))) AS t
  FROM headed x LEFT JOIN own b ON b.conv_id = x.conv_id - x.conv_id % 20
), prefix AS (
  SELECT conv_id, t, unnest(range(len(t) + 1)) AS depth FROM rebuilt
), node AS (
  SELECT list_transform(list_slice(t, 1, depth), lambda x: x.d) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN t[depth].w ELSE 0 END) AS w,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len(t)), '')) AS ends_sha256
  FROM prefix GROUP BY path, depth
), child AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), above AS (
  SELECT n.path, (n.n_convs - 1) * n.w AS saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, coalesce(c.n, 0) AS n_children, unnest(range(n.depth + 1)) AS up
  FROM node n LEFT JOIN child c ON c.path = n.path
), sums AS (
  SELECT list_slice(path, 1, up) AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON s.path = n.path LEFT JOIN child c ON c.path = n.path
LEFT JOIN node p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_secret_scan": op6_secret_scan,
        "op7_near_dedup": op7_near_dedup,
        "op8_mixing": op8_mixing,
        "op9_neighbours": op9_neighbours,
        "op10_language_model": op10_language_model,
        "op11_language_id": op11_language_id,
        "op12_collocations": op12_collocations,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op12_collocations": OP12_SQL, "op13_conversation_trie": OP13_SQL}
