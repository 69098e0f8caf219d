"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import new_path
from . import alignment, covers, divergence, exact, forest, langid, logbilinear, mixing, packing, resampling, simhash, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents."""
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file of a public tokenizer lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that stand in more than one document."""
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT s, list_sort(list(DISTINCT doc_id)) AS ids FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT g.doc_id, i, CASE WHEN ids[1] = g.doc_id THEN ids[2] ELSE ids[1] END AS other FROM g JOIN f ON g.s = f.s),
r AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM m),
x AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r)
SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start_word, CAST(max(i) + 49 AS INTEGER) AS end_word, CAST(max(i) - min(i) + 50 AS INTEGER) AS n_words,
       min(other) AS other_doc_id, min(other) < doc_id AS repeats_earlier
FROM x GROUP BY doc_id, run
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors over all embeddings."""
    return forest.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
rc(node, component) USING KEY (node) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT p.a, min(rc.component) FROM rc JOIN p ON rc.node = p.b JOIN recurring.rc AS me ON me.node = p.a WHERE rc.component < me.component GROUP BY p.a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM v JOIN rc ON vec_id = node LEFT JOIN n ON vec_id = n.a
"""


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read the archives back; a gap in them fails the query."""
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    found = warc.read_archives(spark, path, with_payload=False)
    broken = F.raise_error(F.concat(F.lit("archive "), "archive", F.lit(" has a gap at "), F.col("position").cast("string"), F.lit(": "), "gap"))
    found = found.where(F.when(F.col("gap").isNull(), True).otherwise(broken.cast("boolean")))
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT page_id, h, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), 'string_agg', '') AS d
  FROM p
), m AS (SELECT h, max(page_id) AS top FROM b GROUP BY h)
SELECT page_id, CAST(strlen(b.h) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b JOIN m ON b.h = m.h
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no document with a smaller id repeats in 13-word windows."""
    return covers.without_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
c AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT g.doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f ON g.s = f.s WHERE first_doc < g.doc_id)
), x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
k AS (
  SELECT x.doc_id, count(*) AS kept, string_agg(w[x.k], ' ' ORDER BY x.k) AS t
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k WHERE c.k IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the scheduled blocks take of each document, and the slots of its first and
    last block."""
    found = mixing.mix_sources(_table(spark, sf_dir, "documents")).taken()
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w
), l AS (SELECT min(lev) FILTER (WHERE rn = 1) AS lev FROM (
  SELECT lev, row_number() OVER (ORDER BY cap / weight, sid) AS rn FROM r WHERE lev <= cap / weight)
), t AS (
  SELECT source, source_size, least(cap, coalesce(l.lev * weight, cap)) AS target FROM r CROSS JOIN l
), p AS (
  SELECT doc_id, size, d.source, sid, source_size, target, least(CAST(round(target) AS BIGINT), 2 * source_size) AS lim,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a
  FROM d JOIN (SELECT t.*, s.sid FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source) t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, CAST(sum(blocks) OVER (ORDER BY sid) AS BIGINT) - blocks AS first_block
  FROM (SELECT DISTINCT sid, CAST(ceil(lim / 4096.0::DOUBLE) AS BIGINT) AS blocks FROM p) WHERE blocks > 0
), b AS (SELECT greatest(length(bin(CAST(sum(blocks) AS BIGINT) - 1)), 1) AS bits FROM n),
v AS (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block, slot FROM (
    SELECT sid, CAST(list_sum(list_transform(range(CAST(bits AS BIGINT)), lambda i: ((point >> i) & 1) << CAST(bits - 1 - i AS BIGINT))) AS BIGINT) AS slot
    FROM (SELECT sid, unnest(range(first_block, first_block + blocks)) AS point FROM n), b)
), x AS (
  SELECT doc_id, a, sid, q, a + q * source_size AS low, least(a + q * source_size + size, lim) AS high
  FROM p CROSS JOIN (SELECT unnest([0, 1]) AS q) WHERE size > 0
), c AS (
  SELECT y.sid, y.a, min(slot) AS first_slot, max(slot) AS last_slot FROM (
    SELECT sid, a, unnest(range(low // 4096, (high - 1) // 4096 + 1)) AS block FROM x WHERE low < high) y
  JOIN v ON y.sid = v.sid AND y.block = v.block GROUP BY y.sid, y.a
)
SELECT doc_id, size, source_size, target,
       greatest(least(p.a + size, lim) - p.a, 0) + greatest(least(source_size + p.a + size, lim) - source_size - p.a, 0) AS taken,
       first_slot, last_slot
FROM p LEFT JOIN c ON p.sid = c.sid AND p.a = c.a AND p.size > 0
"""


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and sampling decision of every document."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.aligned(_table(spark, sf_dir, "documents"), *paths).documents


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by unigrams and by a log-bilinear model."""
    return logbilinear.scored(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each apart."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, CAST(sum(all_n) AS HUGEINT) AS all_total, CAST(count(*) AS HUGEINT) AS terms FROM k GROUP BY lang),
s AS (
  SELECT g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), z AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM s GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, s.term, s.n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (CAST(s.n AS HUGEINT) + 5)) // (z.total + 5 * l.terms) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (CAST(s.all_n AS HUGEINT) + 5)) // (l.all_total + 5 * l.terms) AS BIGINT) AS q
  FROM s JOIN z ON s.lang = z.lang AND s.source = z.source JOIN l ON s.lang = l.lang
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_pack_sequences": op4_pack_sequences,
        "op5_warc": op5_warc,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_mix_sources": op7_mix_sources,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_simhash_dedup": op9_simhash_dedup,
        "op10_quality_resampling": op10_quality_resampling,
        "op11_token_alignment": op11_token_alignment,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_mix_sources": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op13_source_divergence": OP13_SQL}
