"""The registered query of every corpus operator, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, conversations, curve, embeddings, importance, langid, licenses, near_dup, negatives, packing, pii, quality_rules, warc, work


def vocabulary_path() -> str:
    """The public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    path = vocabulary_path()
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = documents.select("doc_id", bpe.round_trip(F.col("text"), path).alias("r")).select("doc_id", "r.*")
    return texts.select(
        "doc_id",
        bpe.token_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def packed_documents(documents: DataFrame) -> DataFrame:
    """All pieces of all documents with their places in the packed sequences."""
    ids = documents.select("doc_id", bpe.encoded(F.col("text"), vocabulary_path()).alias("ids"))
    pieces = packing.pieces(ids).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.packed(pieces)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    return packed_documents(_table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents, on shingles of two words."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dup.near_duplicates(documents, near_dup.Settings(shingle=2))
    return found.drop("text_hash")


_OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+')] AS words
  FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
      ELSE [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] END) AS shingle
    FROM w)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b USING (shingle) GROUP BY ALL HAVING count(*) > 0
),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
),
reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
),
low AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    documents = _table(spark, sf_dir, "documents")
    found = documents.select("doc_id", licenses.scanned(F.col("text")).alias("s")).select("doc_id", "s.*")
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of the quality rules for every document."""
    judged = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), lang="lang")
    return judged.select("doc_id", "quality.*").drop("failed")


# Columns of the statement that tell where a rule does not apply.
_UNLESS = {quality_rules.other_language: "other_language", quality_rules.unspaced_script: "unspaced_script"}


def _bound(rule: quality_rules.Rule) -> str:
    of = rule.per or "1"
    tests = [f"{rule.scale} * {rule.metric} < {rule.low} * {of}"] if rule.low is not None else []
    tests += [f"{rule.scale} * {rule.metric} > {rule.high} * {of}"] if rule.high is not None else []
    failed = "(" + " OR ".join(tests) + ")"
    return f"({failed} AND NOT {_UNLESS[rule.unless]})" if rule.unless else failed


def _letters(but: str) -> str:
    """Number of a text's letters that are not among ``but``."""
    return f"length(regexp_replace(text, '[\\P{{L}}{but}]+', '', 'g'))"


_FAMILIAR = quality_rules.LETTERS + quality_rules.LETTERS.upper()
_SPACED = _letters("")
_UNSPACED = _SPACED + " - " + _letters("".join(f"\\p{{{s}}}" for s in quality_rules.UNSPACED_SCRIPTS))


def _any(rules) -> str:
    return " OR ".join(_bound(rule) for rule in rules)


_OP5_SQL = f"""
WITH texts AS (SELECT doc_id, lower(trim(lang)) AS lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM texts
),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS shown
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
twins AS (SELECT doc_id, shown FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows JOIN twins USING (doc_id, shown))
  GROUP BY doc_id
),
m AS (
  SELECT doc_id,
    len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^{quality_rules.SYMBOLS}]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len([x FOR x IN words IF lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)})])
      AS n_stop_words,
    lang IS NOT NULL AND lang NOT IN ({", ".join(f"'{x}'" for x in quality_rules.UNNAMED)})
        AND NOT regexp_matches(lang, '{quality_rules.COVERED}')
      OR ({_letters(_FAMILIAR)} > 0 AND 100 * {_letters(_FAMILIAR)} >= 3 * {_SPACED}) AS other_language,
    ({_UNSPACED}) > 0 AND 100 * ({_UNSPACED}) >= 33 * {_SPACED} AS unspaced_script
  FROM w LEFT JOIN repeated USING (doc_id)
)
SELECT * EXCLUDE (other_language, unspaced_script), ({_any(quality_rules.BASE_RULES)}) AS base_failed,
  NOT ({_any([*quality_rules.BASE_RULES, *quality_rules.RULES])}) AS kept
FROM m
"""


#: Labelled documents that the target model is fitted on, and the share of all documents to sample.
TARGET_DOCUMENTS = 20_000
SAMPLED = 0.85


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and draw of every document, and whether it is sampled.

    The target are at most ``TARGET_DOCUMENTS`` documents labelled as good and not toxic, chosen by hash; that
    bound makes their ids small enough to broadcast.  The raw model counts all documents.
    """
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCUMENTS)
    target = documents.join(F.broadcast(ids), "doc_id", "left_semi")
    return importance.resampled(documents, importance.fit(target, documents), SAMPLED)


#: Key of the queries' surrogates; a real run takes its own from a secret store.
SURROGATE_KEY = "cohortlens example key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many entities that were."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(documents, SURROGATE_KEY, count="n_entities")


#: WARC-Date of the records that the query writes: the test pages have no date of their own.
CRAWLED = "1999-01-01T00:00:00Z"


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages into packages, then read all their records back."""
    made = warc.written_packages(_table(spark, sf_dir, "pages"), work.folder(spark, "warc"), CRAWLED)
    return warc.read_packages(made).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


def identified_documents(
    documents: DataFrame, into: str = "language", held_out: str = "held_out"
) -> DataFrame:
    """``documents`` with ``held_out`` and the struct ``into``; learnt from the rows not held out."""
    third = langid.is_held_out(F.col("doc_id"))
    model = langid.fit(documents.where(~third & F.col("doc_id").isNotNull()))
    return documents.withColumns({held_out: third, into: langid.identified(F.col("text"), model)})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified_documents(documents).select("doc_id", "held_out", "language.*")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98 or more."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


_OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b USING (label)
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
),
low AS (SELECT x AS vec_id, least(min(y), x) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents, neighbours on the curve together, into sequences without padding."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = curve.packed(curve.encoded(documents, vocabulary_path()))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all, on whole components and partly changed labels."""
    table = _table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = table.select("vec_id", changed.alias("label"), whole.alias("embedding"))
    return negatives.mined(rows, F.col("vec_id") % 100 == 0)


_OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
    CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation, then repair it: faults, cheapest edits and the digest of the result."""
    table = _table(spark, sf_dir, "conversations")
    found = conversations.repaired(conversations.damaged(table))
    report = found.report.withColumnRenamed("conv_id", "c")
    shown = conversations.digests(found.turns).withColumnRenamed("conv_id", "d")
    ids = table.select("conv_id").distinct()
    rows = ids.join(report, ids.conv_id.eqNullSafe(report.c), "left").join(shown, ids.conv_id.eqNullSafe(shown.d), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_near_dup": op3_near_dup,
    "op4_licenses": op4_licenses,
    "op5_quality_rules": op5_quality_rules,
    "op6_importance": op6_importance,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_embeddings": op10_embeddings,
    "op11_curve_packing": op11_curve_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_dup": _OP3_SQL,
    "op5_quality_rules": _OP5_SQL,
    "op8_warc": _OP8_SQL,
    "op10_embeddings": _OP10_SQL,
    "op12_hard_negatives": _OP12_SQL,
}
