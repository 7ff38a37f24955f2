"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import chat, exact_dedup, jaccard, langid, mixing, packing, pii, topk, toxicity, url_filter
from foliospark.llm.url_filter import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares: the largest source is held down, two curated ones are raised, all others count alike.
MIX_WEIGHTS, MIX_DEFAULT, MIX_EPOCHS, MIX_SEED = {"src0": 2.0, "src3": 3.0, "src7": 1.5}, 1.0, 1.0, 17

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: A conversation that consists of control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in their target mixture, repeated and shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, MIX_EPOCHS, MIX_SEED)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the owner of its text."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Place of the byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of links at four-word shingles and 85 of 100."""
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return chat.read_back(chat.format_chats(chat.as_events(rows.union(extra))))


#: DuckDB's lower() folds all letters; translate folds A-Z alone.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULE_CASE = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name))
) + " END"
_ROLE_HEAD = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 17 + length(role) + length(regexp_replace(role, '[^<|\\\\[]', '', 'g')) END"

SQL = {
    "op1_mix_sources": f"""
        WITH RECURSIVE w AS (
            SELECT source, sum(coalesce(length(text), 0)) AS chars,
                   CASE source {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sorted(MIX_WEIGHTS.items()))} ELSE {MIX_DEFAULT}::DOUBLE END AS weight
            FROM documents GROUP BY source),
        r AS (SELECT source, CASE WHEN chars > 0 THEN weight * ({MIX_EPOCHS}::DOUBLE * (SELECT sum(chars) FROM w)) / (chars * (SELECT sum(weight) FROM w WHERE chars > 0)) ELSE 1.0 END AS rate FROM w),
        p AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.PART}))::INT AS parts FROM r),
        t(source, mean, k, p, c) AS (
            SELECT source, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM p
            UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM t WHERE k < {mixing.TERMS}),
        terms AS (SELECT source, list(c) AS cs FROM t GROUP BY source),
        d AS (SELECT doc_id, source, unnest(range(1, parts + 1)) AS draw FROM documents JOIN p USING (source)),
        u AS (SELECT doc_id, source, ('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
        n AS (SELECT doc_id, sum(len(list_filter(cs, lambda c: c <= u)))::INT AS n FROM u JOIN terms USING (source) GROUP BY doc_id),
        x AS (SELECT doc_id, unnest(range(1, n + 1))::INT AS copy FROM n)
        SELECT doc_id, text, lang, source, n_chars, copy, md5('s{MIX_SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM documents JOIN x USING (doc_id)""",
    "op7_exact_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_url_filter": f"""
        WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, url, html FROM pages),
        v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u)
        SELECT page_id, host, path, {_RULE_CASE.replace('{}', '')} AS rule,
               CASE {' '.join(f"WHEN ({_RULE_CASE.replace('{}', '')}) = '{r.name}' THEN '{r.verdict}'" for r in RULES)} ELSE 'allow' END AS verdict
        FROM v""",
    "op10_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(length(text) + length(regexp_replace(text, '[^<|\\\\[]', '', 'g')) + {_ROLE_HEAD}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_url_filter": op9_url_filter,
    "op10_chat_format": op10_chat_format,
}
