"""One query per operator, on its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from odflow.llm import automaton, bpe, chat, fingerprint, jaccard, language, mixing, phrases, pii, quality, spelling, suffix, topk
from odflow.llm.tables import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts, digest of the base spans, and all spans."""
    docs = read(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.learn(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken(*mixing.mix(read(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that a smaller document holds."""
    found = suffix.remove_repeated_strings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; documents with remainder 2 are held out of the training."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    docs = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def tokenizer() -> tuple[bytes, str]:
    """The rank file of the vocabulary, and the pattern that cuts texts before its merges."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of what they decode to."""
    coded = bpe.encode(read(spark, sf_dir, "documents"), *tokenizer(), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Both turns of the added conversation say this.
TRICKY = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted examples."""
    own = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    back = chat.read_back(chat.chat_examples(own.unionByName(added)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word sequences that a smaller document holds."""
    found = automaton.remove_repeated_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they and the next document's are."""
    found = fingerprint.with_edits(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, at a Jaccard similarity of 0.8."""
    return jaccard.components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word that occurs at least twice."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; documents with remainder 0 are held out of the training."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    weights = quality.learn(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    found = quality.scored(docs.withColumn("held_out", quality.held_out(F.col("doc_id"))), weights)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of every language that hold together best."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mix": op2_mix,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_topk": op4_topk,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_substring": op8_substring,
    "op9_fingerprint": op9_fingerprint,
    "op10_jaccard": op10_jaccard,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}

SQL = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""",
    "op7_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    13 + length(replace(replace(replace(replace(role, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t'), chr(10), '\\n'))
      + length(replace(replace(replace(text, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op13_phrases": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p
), g AS (
  SELECT lang, k, unnest([ws[i : i + k - 1] FOR i IN range(1, CAST(len(ws) - k + 2 AS BIGINT))]) AS gram
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k
), f AS (SELECT lang, k, gram, count(*) AS n FROM g GROUP BY lang, k, gram),
c AS (SELECT * FROM f WHERE k >= 2 AND n >= 30),
cuts AS (SELECT lang, k, gram, n, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.lang, cuts.k, cuts.gram, cuts.n AS a, cut, x.n AS l, y.n AS r,
    (CAST(2000000 AS HUGEINT) * cuts.n) // (CAST(x.n AS HUGEINT) + y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.gram = cuts.gram[1 : cut]
  JOIN f y ON y.lang = cuts.lang AND y.gram = cuts.gram[cut + 1 : cuts.k]
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS nth FROM s),
parts AS (
  SELECT lang, n, unnest([gram[i : i + m - 1] FOR i IN range(1, CAST(k - m + 2 AS BIGINT))]) AS gram
  FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k
), longer AS (SELECT lang, gram, max(n) AS n FROM parts GROUP BY lang, gram),
kept AS (
  SELECT b.lang, array_to_string(b.gram, ' ') AS phrase, a, l, r, score
  FROM b LEFT JOIN longer o ON o.lang = b.lang AND o.gram = b.gram
  WHERE nth = 1 AND NOT coalesce(CAST(100 AS HUGEINT) * o.n >= CAST(80 AS HUGEINT) * a, false)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = ranked.lang WHERE rank <= 2000
""",
}
