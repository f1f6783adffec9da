"""Named queries of the pipeline's operators, with production parameters over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import (
    ann,
    chat,
    decontaminate,
    language,
    minhash,
    mixing,
    periodic_runs,
    prefix_trie,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    warc,
)
from trafficlens.llm.parameters import DOMAINS, MIX, SHARDS
from trafficlens.session import shared_path, written

NEIGHBOURS = 20
TOKEN_LIMIT = 4096
TOKENIZER = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op3_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.scored(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_nearest_neighbours(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0, k=NEIGHBOURS)


@query
def op5_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    mix = mixing.mixed(docs, _table(spark, sf_dir, "labels"), DOMAINS, [MIX[d] for d in DOMAINS])
    shares = [F.col("memberships")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)]
    return mix.select("doc_id", "tokens", *shares, "rate", "copies")


@query
def op6_suffix_array_dedup(spark, sf_dir):
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return found.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


@query
def op7_chat_formatting(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    records = chat.records_of_rows(rows.unionByName(extra), key="conv_id", turn="turn", role="role", text="text")
    return chat.digests(chat.formatted(chat.canonical(records, "record")), "conv_id")


ORACLE["op7_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS inner_text,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS inner_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(inner_role) + 2 + length(inner_text) + 9) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query
def op8_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)


@query
def op9_token_counts(spark, sf_dir):
    import public_tokenizers  # the other queries do without it

    path = public_tokenizers.path(TOKENIZER)
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path, limit=TOKEN_LIMIT)


@query
def op10_warc(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    warc.write_warc(warc.captures(pages, id_col="page_id", url_col="url", payload_col="html"), path)
    # Files are parsed once; the joins read the records.
    records = written(warc.read_warc(spark, path), "warc-records")
    found = warc.transactions(records)
    answer = F.col("answer")
    return found.select(
        warc.page_of(answer["record_id"]).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        answer["record_type"].alias("record_type"),
        warc.page_of(answer["refers_to"]).alias("refers_to"),
        answer["target_uri"].alias("target_uri"),
        warc.without_number(F.col("request")["record_id"]).alias("request_id"),
        warc.without_number(F.col("metadata")["record_id"]).alias("metadata_id"),
    )


ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), h AS (SELECT digest, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to,
       url AS target_uri,
       '<urn:page:request:' || page_id || '>' AS request_id,
       '<urn:page:metadata:' || page_id || '>' AS metadata_id
FROM p LEFT JOIN h USING (digest)
"""


@query
def op11_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tail = periodic_runs.repeated_tail(F.col("text"), F.floor(number / 10).cast("long"))
    given = docs.withColumn("text", F.when(number % 10 == 0, tail).otherwise(F.col("text")))
    found = periodic_runs.periodic_runs(given).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = prefix_trie.conversations_of_rows(rows, key="conv_id", turn="turn", role="role", text="text")
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    rebuilt = prefix_trie.with_shared_starts(own, conv - conv % 100, shared)
    return prefix_trie.prefix_trie(rebuilt).drop("node")


ORACLE["op12_prefix_trie"] = """
WITH polynomial AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)
), ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 6 AS h
  FROM ids, polynomial
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'said': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, sha256(concat(len(coalesce(role, '')), ':', role, text))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM own o JOIN hashed USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), member AS (
  SELECT conv_id, d, len(turns) AS n, len(turns[d].said) AS chars,
         min(conv_id) OVER (PARTITION BY d, turns[1:d]) AS node
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, count(*) AS n_convs, coalesce(any_value(chars), 0) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM member GROUP BY node, d
), linked AS (
  SELECT nodes.*, p.node AS parent FROM nodes LEFT JOIN member p ON p.conv_id = nodes.node AND p.d = nodes.d - 1
), children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT m.node, m.d, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM nodes n JOIN member m ON m.conv_id = n.node AND m.d <= n.d LEFT JOIN children c ON c.node = n.node AND c.d = n.d
  GROUP BY m.node, m.d
)
SELECT l.node AS conv_id, CAST(l.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN below b USING (node, d) LEFT JOIN children c USING (node, d)
"""


@query
def op13_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline  # the operators do without it

    return corpus_pipeline.run(spark, sf_dir)
