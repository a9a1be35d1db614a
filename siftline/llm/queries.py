"""The named queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    decontaminate, licences, merkle, near_vectors, pieces, quality, resampling, seeds, shards, simhash, suffixes,
    token_files, warc,
)
from siftline.llm.slices import ready
from siftline.session import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"), new_path(spark, "archives"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.found_licences(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_texts(_table(spark, sf_dir, "documents"), shards=40)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(_table(spark, sf_dir, "documents"), model)


def op8_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_texts(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer, folder, end_id=1)
    return token_files.read_digests(spark, folder)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"), passage=50)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.kept_digests(_table(spark, sf_dir, "documents"), window=50)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_round_trip, op2_near_vectors, op3_licences, op4_quality, op5_contained_items, op6_shards, op7_pieces,
        op8_near_texts, op9_token_files, op10_repeated_passages, op11_merkle_manifest, op12_importance_draw,
        op13_kept_words,
    )
}

ORACLES: dict[str, str] = {
    "op1_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op2_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op3_licences": licences.licence_sql(),
    "op5_contained_items": """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'),
                                       lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'),
                                   lambda w: w <> '') AS w FROM benchmark),
short AS (SELECT DISTINCT len(w) AS k FROM iw WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)),
                                            lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
       FROM dw WHERE len(w) > 0
       UNION SELECT doc_id, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' ')))
       FROM dw, short WHERE len(w) >= k),
it AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(len(w) - 4, 1)),
                                                      lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
       FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM it GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN it USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8""",
    "op11_merkle_manifest": """
WITH RECURSIVE c0 AS (
  SELECT list(list_reduce([i::UINTEGER, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END)::UINTEGER) ORDER BY i) AS c
  FROM range(256) t(i)),
d AS (SELECT doc_id, lang, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n0,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS n1,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS b,
    xor(list_reduce(list_concat([4294967295::UINTEGER], list_transform(string_split(doc_id::VARCHAR, ''),
      lambda x: ascii(x)::UINTEGER)),
      lambda r, x: xor(r >> 8, c0.c[(xor(r, x) & 255) + 1])::UINTEGER), 4294967295::UINTEGER) % 7 = 0 AS hit
  FROM documents, c0),
leaf AS (SELECT doc_id, lang, sha256(a || n0 || b) AS leaf, CASE WHEN hit THEN sha256(a || n1 || b) END AS changed FROM d),
node AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaf),
up AS (SELECT 0 AS k, tree, idx, leaf AS h, n FROM node
       UNION ALL
       SELECT k + 1, tree, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
       FROM up WHERE n > 1 GROUP BY k, tree, idx // 2),
sub AS (SELECT tree, h FROM up WHERE n = 1),
top AS (SELECT 0 AS k, tree AS idx, h, (SELECT count(*) FROM sub) AS n FROM sub
        UNION ALL
        SELECT k + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
        FROM top WHERE n > 1 GROUP BY k, idx // 2),
steps AS (SELECT node.doc_id, node.leaf, up.k, (node.idx >> up.k) & 1 AS side, s.h
          FROM node JOIN up ON up.tree = node.tree AND up.idx = node.idx >> up.k AND up.n > 1
          LEFT JOIN up s ON s.k = up.k AND s.tree = up.tree AND s.idx = xor(up.idx, 1)
          UNION ALL
          SELECT node.doc_id, node.leaf, 1000 + top.k, (node.tree >> top.k) & 1, s.h
          FROM node JOIN top ON top.idx = node.tree >> top.k AND top.n > 1
          LEFT JOIN top s ON s.k = top.k AND s.idx = xor(top.idx, 1)),
proof AS (SELECT doc_id, leaf, sha256(string_agg(coalesce(h, ''), '' ORDER BY k)) AS proof_sha256,
            list(CASE WHEN side = 1 THEN h ELSE '' END ORDER BY k) AS l, list(CASE WHEN side = 0 THEN coalesce(h, '') ELSE '' END ORDER BY k) AS r
          FROM steps GROUP BY doc_id, leaf),
fold AS (SELECT node.doc_id, node.leaf, node.tree, 0 AS k, coalesce(changed, node.leaf) AS h, l, r, proof_sha256
         FROM node LEFT JOIN proof ON node.doc_id IS NOT DISTINCT FROM proof.doc_id AND node.leaf = proof.leaf
         UNION ALL
         SELECT doc_id, leaf, tree, k + 1, sha256(l[k + 1] || h || r[k + 1]), l, r, proof_sha256 FROM fold WHERE k < len(l))
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root,
  fold.h = root.h AS verified
FROM fold JOIN sub USING (tree), (SELECT h FROM top WHERE n = 1) root WHERE k = coalesce(len(l), 0)""",
    "op12_importance_draw": """
WITH RECURSIVE c0 AS (
  SELECT i, list_reduce([i::UINTEGER, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END)::UINTEGER) AS c
  FROM range(256) t(i)),
words AS (SELECT 0 AS target, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
          UNION ALL
          SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT target, id, feature, count(*) AS n FROM (
        SELECT target, id, unnest(w) AS feature FROM words
        UNION ALL SELECT target, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT target, id, unnest(list_transform(range(1, len(w) - 1),
          lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words) GROUP BY ALL),
kinds AS (SELECT DISTINCT feature FROM f),
part AS (SELECT 0 AS d, i, c FROM c0
         UNION ALL
         SELECT d + 1, part.i, xor(c0.c, part.c >> 8)::UINTEGER FROM part JOIN c0 ON c0.i = part.c & 255
         WHERE d < (SELECT max(strlen(feature)) FROM kinds)),
init AS (SELECT 0 AS n, 4294967295::UINTEGER AS r
         UNION ALL
         SELECT n + 1, xor(c0.c, r >> 8)::UINTEGER FROM init JOIN c0 ON c0.i = r & 255
         WHERE n < (SELECT max(strlen(feature)) FROM kinds)),
bytes AS (SELECT feature, strlen(feature) AS size, hex(feature) AS x, unnest(range(strlen(feature))) AS pos FROM kinds),
crc AS (SELECT feature, any_value(size) AS size, bit_xor(c) AS c
        FROM bytes JOIN (SELECT d, c, upper(printf('%02x', i)) AS x FROM part) p
          ON p.d = size - 1 - pos AND p.x = substr(bytes.x, 2 * pos + 1, 2) GROUP BY feature),
bucket AS (SELECT feature, xor(xor(c, r), 4294967295::UINTEGER) % 10000 AS bucket FROM crc JOIN init ON init.n = size),
counts AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM f JOIN bucket USING (feature) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight
            FROM f JOIN bucket USING (feature) JOIN gain USING (bucket) WHERE target = 0 GROUP BY 1),
h AS (SELECT doc_id, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
scored AS (SELECT h.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score,
             coalesce(len(w), 0) >= 20 AS enough
           FROM h LEFT JOIN weights USING (doc_id) LEFT JOIN words ON words.id = h.doc_id AND target = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN enough AND place <= 5 * (SELECT count(*) FROM scored WHERE enough) // 100 THEN place END AS rank
FROM placed""",
    "op13_kept_words": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
runs AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s FROM w, unnest(range(1, len(w) - 48)) t(i)),
old AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM runs) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM old),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) FILTER (gone.pos IS NOT NULL) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL) AS text
         FROM word LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
