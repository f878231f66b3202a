"""One query per operator of this package, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    bloom_cascade, chat_format, lexical, license_scan, merkle, mixing, multi_index, ngram_join, order_minhash, packing, quality_model, string_kernel, training_order,
)
from tabloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if it can be said in SQL, its check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_training_order")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "training-order")
    return training_order.write_training_order(table(spark, sf_dir, "documents"), tokenizer_path(), folder)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_on(docs, quality_model.grades_of(table(spark, sf_dir, "labels")), 3)
    return quality_model.score(docs, model).drop("text")


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op2_chat_format")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"),
    )
    chats = chat_format.format_chats(turns.unionByName(two)).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.learnt_text(F.col("segments")).alias("learnt")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op2_chat_format"] = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), runs AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 0 ELSE 1 END AS fresh FROM told
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))
    + CASE WHEN fresh = 1 THEN length('<turn >') + length('</turn>') + 1 + length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', ''))
      ELSE length('<next>') END)::BIGINT AS formatted_chars
FROM runs GROUP BY conv_id
"""

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPAM = "(^|[.])spam-"


@query("op9_url_filter", r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), told AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM told
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.])spam-') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(bloom_cascade.host_of(F.col("url")).alias("host")).filter(F.col("host").rlike(SPAM)).distinct()
    return bloom_cascade.judge_urls(pages, hosts, RULES)


def domain_of(source):
    """Domain of a source, from its number: a made-up tree over the given sources."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(
        F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number.cast("long") % 3 + 1).cast("int"))
    )


DOMAINS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def mixed(docs: DataFrame, share: float, epochs: int) -> DataFrame:
    """Documents by domain, language and source, with the weights above; other domains and languages weigh 0.05, sources alike."""

    def weigh(level: str, told: dict[str, float]):
        pairs = F.create_map(*[F.lit(x) for pair in told.items() for x in pair])
        return lambda nodes: F.coalesce(F.try_element_at(pairs, nodes[level]), F.lit(0.05))

    return mixing.mix(
        docs, {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")},
        [weigh("domain", DOMAINS), weigh("lang", LANGUAGES), lambda nodes: F.lit(1.0)], mixing.word_count(F.col("text")), share, epochs, seed=17,
    )


@query("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, 0.8, 3).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1))
    ) % 2 = 1, false) AS even
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS later, head FROM fields
), placed AS (
  SELECT *, sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), nodes AS (
  SELECT 0 AS level, tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (min(size) + 2) // 3 FROM nodes WHERE size > 1 GROUP BY level, tree, pos // 3
), subroots AS (
  SELECT tree, digest, level FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (min(size) + 2) // 3 FROM tops WHERE size > 1 GROUP BY level, pos // 3
), steps AS (
  SELECT level, tree, pos // 3 AS run, pos, digest FROM nodes WHERE size > 1
), top_steps AS (
  SELECT t.level + s.level AS level, s.tree, t.pos // 3 AS run, t.pos, t.digest, t.level AS above FROM tops t CROSS JOIN subroots s WHERE t.size > 1
), paths AS (
  SELECT p.tree, p.pos AS leaf_pos, s.level, s.pos, s.digest, p.pos // (3 ** s.level)::BIGINT AS own
  FROM placed p JOIN steps s ON s.tree = p.tree AND s.run = p.pos // (3 ** (s.level + 1))::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, s.level, s.pos, s.digest, p.tree // (3 ** s.above)::BIGINT
  FROM placed p JOIN top_steps s ON s.tree = p.tree AND s.run = p.tree // (3 ** (s.above + 1))::BIGINT
), sides AS (
  SELECT tree, leaf_pos, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS after
  FROM paths GROUP BY tree, leaf_pos, level
), proofs AS (
  SELECT tree, leaf_pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM sides GROUP BY tree, leaf_pos
), folds AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, other AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.level + 1, sha256(s.before || f.digest || s.after)
  FROM folds f JOIN sides s ON s.tree = f.tree AND s.leaf_pos = f.leaf_pos AND s.level = f.level
), ends AS (
  SELECT tree, leaf_pos, arg_max(digest, level) AS digest FROM folds GROUP BY tree, leaf_pos
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.digest AS folded_root,
  e.digest = r.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree CROSS JOIN (SELECT digest FROM tops WHERE size = 1) r
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_pos = p.pos JOIN ends e ON e.tree = p.tree AND e.leaf_pos = p.pos
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, {"text": merkle.without_line_ends(F.col("doc_id"), F.col("text"))})


@query("op13_ranked_search", r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), counted AS (
  SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term
), sizes AS (
  SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
), scored AS (
  SELECT a.item_id, c.r, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * k.docs) // k.total))))::BIGINT AS score
  FROM asked a JOIN counted c ON c.term = a.term JOIN weights w ON w.term = a.term JOIN sizes s ON s.r = c.r CROSS JOIN corpus k
  GROUP BY a.item_id, c.r, c.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(string_kernel.crc_of(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(string_kernel.crc_of(F.col("doc_id")) % 5 != 0)
    model = string_kernel.fit_on(docs.filter("not held_out"), labels)
    return string_kernel.score(docs, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
