"""The queries of this subpackage: name -> callable, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import capfilter, cotrain, lm, media, minhash, packing, pieces, suffix, toxicity, urlfilter
from .common import crc_class, table


def op8_minhash_bottomk(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_in_shingle=4)


def op1_capfilter_embeddings(spark, sf_dir):
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_urlfilter_temporal(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") * 37 % 366).cast("int"))
    return urlfilter.judged(captures, urlfilter.dated_lists(pages))


def op3_pieces_sampled(spark, sf_dir):
    return pieces.encoded(table(spark, sf_dir, "documents"), sharpness=1.0, seed=1)


def op4_suffix_runlength(spark, sf_dir):
    return suffix.deduplicated(table(spark, sf_dir, "documents"), size=100)


def op5_toxicity_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model, score_col="score")
    return out.select("doc_id", (crc_class("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_lm_bilinear(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_media_sniffing(spark, sf_dir):
    return media.read_back(media.stored(table(spark, sf_dir, "documents")))


def op9_packing_hilbert(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), length=2048)


def op10_quality_cotraining(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    out = cotrain.scored(docs, model, ("score", "text_score", "meta_score"))
    return out.select("doc_id", (crc_class("doc_id", 3) == 1).alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_capfilter_embeddings": op1_capfilter_embeddings,
    "op2_urlfilter_temporal": op2_urlfilter_temporal,
    "op3_pieces_sampled": op3_pieces_sampled,
    "op4_suffix_runlength": op4_suffix_runlength,
    "op5_toxicity_segments": op5_toxicity_segments,
    "op6_lm_bilinear": op6_lm_bilinear,
    "op7_media_sniffing": op7_media_sniffing,
    "op8_minhash_bottomk": op8_minhash_bottomk,
    "op9_packing_hilbert": op9_packing_hilbert,
    "op10_quality_cotraining": op10_quality_cotraining,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_minhash_bottomk"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, r.c FROM r JOIN both_ways ON r.id = u)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT id AS doc_id, min(c) AS m FROM r GROUP BY id) LEFT JOIN n USING (doc_id)
"""

ORACLE_SQL["op1_capfilter_embeddings"] = r"""
WITH RECURSIVE raw AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM raw
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(v, v) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM raw UNION SELECT e.v, r.c FROM r JOIN e ON r.id = e.u),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept
FROM (SELECT id AS vec_id, min(c) AS m FROM r GROUP BY id) LEFT JOIN n ON u = vec_id
"""

ORACLE_SQL["op2_urlfilter_temporal"] = urlfilter.ORACLE_SQL
