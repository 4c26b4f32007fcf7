"""The queries of this subpackage's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, importance, merkle, mixing, neighbours, quality, quality_rules, sharding, simhash, token_counts, token_store, toxicity
from .common import fresh_path, table, text_bytes

#: Where the vocabulary files of public tokenizers are; a parameter of the operators.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{VOCABULARIES}/{name}"
    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector; neighbours.nearest() says what becomes of odd vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(rows, rows.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def toxic_categories() -> dict[str, Column]:
    """The last is what documents are judged by; those before it tell a toxic text in prose from one in junk."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic_prose": toxic & good, "toxic_junk": toxic & ~good, "toxic": toxic}


def toxic_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_on: DataFrame | None = None) -> DataFrame:
    """keep, the chain's probabilities and toxic (0/1); the chain learns from the labelled rows of train_on (docs, if none)."""
    chain = toxicity.train((docs if train_on is None else train_on).select("doc_id", "text"), labels, toxic_categories())
    return toxicity.score(docs, chain, keep).withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and toxic of every document, from its whole text; null texts count as empty."""
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the rows that are not held out; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law `rows`; groups of equal texts are told by text_crc32."""
    dealt = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    size, crc = text_bytes() + 1, F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return dealt.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text; null texts count as empty."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what decodes from them; null texts count as empty."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), reread=True)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; a null source is the last, null texts have size 0."""
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector at a cosine of 0.9; unusable vectors stand alone."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and meet there."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the store's files give it back; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_and_read(docs, vocabulary("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a tenth towards `benchmark`; undrawn ones have no rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Where tampering is tried on: one document in so many.
TAMPER = 7


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of every document in the Merkle tree of its lang's, and what tampered ones fold to."""
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf(FIELDS, {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", merkle.leaf(FIELDS).alias("leaf"), F.when(hit, tampered).alias("tampered"))
    proven = merkle.proofs(leaves, ("tampered",))
    folded = merkle.fold(proven, F.coalesce("tampered", "leaf"))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: What a document's leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document: the ledger is written, then read under the policy in force. failures
    are its bits, sole_rule the one rule without which a document would be kept."""
    path = fresh_path(spark, "ledger")
    quality_rules.write_ledger(table(spark, sf_dir, "documents"), path)
    base, policy = quality_rules.POLICIES["base"], quality_rules.POLICIES["v2"]
    rows, passes = spark.read.parquet(path), quality_rules.passes
    measures = [m for m in quality_rules.MEASURES if m != "n_lines"]
    return rows.select("doc_id", *measures, (~passes(base)).alias("base_failed"), (passes(base) & passes(policy)).alias("kept"), "failures", quality_rules.sole_rule(policy).alias("sole_rule"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_nearest_neighbours, op2_toxicity_chain, op3_quality_ranking, op4_external_shuffle, op5_token_counts, op6_bpe_round_trip, op7_source_mix, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_token_store, op11_importance_resampling, op12_merkle_manifest, op13_quality_rules)
}

#: DuckDB has no crc32: its table, then the CRC of a list of bytes.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, over crc(t)."""
    code = f"hex(encode({text}))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length({code}) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr({code}, 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: DuckDB SQL, where SQL can express a query and is not too slow over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_nearest_neighbours": """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT q.vec_id AS query_id, o.vec_id AS vec_id, list_distance(q.v, o.v) AS score FROM ok q JOIN ok o ON q.vec_id % 100 = 0 AND q.vec_id <> o.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM near
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op7_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), o AS (
  SELECT *, lim <= w * level AS filled FROM l
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN lim ELSE w * (SELECT first(level ORDER BY lim / w, source IS NULL, source) FROM o WHERE NOT filled) END AS target,
    CAST(CAST('0x' || substr(md5('offset:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u FROM o
), r AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, key, doc_id) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(u + pos * rate) - floor(u + (pos - 1) * rate), ceil(rate)) AS BIGINT) AS taken FROM r
""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
""",
    "op11_importance_resampling": f"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, unnest(coalesce(nullif(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []), [NULL])) AS word FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark
), w AS MATERIALIZED (
  SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM d UNION SELECT word FROM b) x, crc WHERE word IS NOT NULL
), s AS (SELECT bucket, count(*) AS n FROM d JOIN w USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM b JOIN w USING (word) GROUP BY 1
), g AS (
  SELECT w.bucket, floor(1000 * ln(CAST(coalesce(max(t.n), 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(coalesce(max(s.n), 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS gain
  FROM w LEFT JOIN s ON s.bucket = w.bucket LEFT JOIN t ON t.bucket = w.bucket GROUP BY 1
), m AS (
  SELECT doc_id, count(word) AS n_features, CAST(coalesce(floor(sum(gain) / nullif(count(word), 0)), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (word) LEFT JOIN g USING (bucket) GROUP BY doc_id
), c AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_features >= 20 AS may FROM m
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(10 * count(*) OVER () / 100) AS want FROM c WHERE may)
SELECT c.doc_id, n_features, weight, score, rank FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND rank <= want
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, lang, {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents, crc
), leaves AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    sha256(head || chars || tail) AS leaf, CASE WHEN hit THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS now FROM d
), low AS MATERIALIZED (
  SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, level, i // 2
), subroots AS MATERIALIZED (SELECT g, node AS subroot, max(level) OVER () AS base FROM low WHERE n = 1
), high AS MATERIALIZED (
  SELECT 0 AS level, g AS i, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2
), path AS MATERIALIZED (
  SELECT doc_id, level, (i >> level) & 1 AS right_side, (SELECT node FROM low o WHERE o.g = x.g AND o.level = x.level AND o.i = xor(x.i >> x.level, 1)) AS sibling
  FROM (SELECT doc_id, leaves.g, leaves.i, level FROM leaves JOIN (SELECT DISTINCT g, level FROM low WHERE n > 1) l ON l.g = leaves.g) x
  UNION ALL
  SELECT doc_id, 1000 + level, (g >> level) & 1, (SELECT node FROM high o WHERE o.level = x.level AND o.i = xor(x.g >> x.level, 1))
  FROM (SELECT doc_id, leaves.g, level FROM leaves, (SELECT DISTINCT level FROM high WHERE n > 1) l) x
), steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM path
), fold AS (
  SELECT doc_id, 0::BIGINT AS k, now FROM leaves
  UNION ALL
  SELECT f.doc_id, s.k, sha256(CASE WHEN sibling IS NULL THEN now WHEN right_side = 1 THEN sibling || now ELSE now || sibling END) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1
), ends AS (SELECT doc_id, arg_max(now, k) AS folded_root FROM fold GROUP BY 1
), proof AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY 1
), root AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (g) JOIN ends USING (doc_id) LEFT JOIN proof USING (doc_id), root
""",
    "op13_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM (
    SELECT doc_id, pos, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) x WHERE third IS NOT NULL
), repeats AS (SELECT doc_id, CAST(count(DISTINCT pos + k) AS BIGINT) AS n FROM windows, range(3) r(k) WHERE n > 1 GROUP BY 1
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN repeats USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 3 * n_words)::BIGINT + 8 * (word_chars > 10 * n_words)::BIGINT
    + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (n_words > 100000)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 63 = 0 AS kept, failures,
  CASE failures & 63 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'short_words' WHEN 8 THEN 'long_words' WHEN 16 THEN 'symbols' WHEN 32 THEN 'repeated_lines' END AS sole_rule
FROM f
""",
}
