"""The registered queries of the operators: thin wrappers that read whole tables and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import (
    bpe, filter_audit, jaccard, line_runs, matrices, merkle, mtree, packing, pii, quality, sharding, tokens, toxicity, urls,
)
from twinfold.llm.common import pick, stored, table
from twinfold.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.spans_text("spans", pii.BASE_KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.spans_text("spans").alias("spans"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure every whole text, certify the cutoffs on the labelled rows, judge all rows."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    rows = stored(quality.with_counts(docs).drop("text"), "quality")  # read twice: for the cutoffs and for the verdicts
    verdicts = quality.judged(rows, quality.certified_cutoffs(rows, table(spark, sf_dir, "labels")))
    counts = [F.col(f"_counts.{c}").alias(c) for c in quality.COUNTS[:5]]
    return verdicts.select("doc_id", *counts, "base_failed", "kept")


def _quality_sql(config: quality.RiskConfig = quality.RiskConfig()) -> str:
    ratios = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{rule}' AS rule, CASE WHEN {base} > 0 THEN {top}::DOUBLE / {base} ELSE 0 END AS ratio FROM measured"
        for rule, (top, base) in quality.RULES.items()
    )
    grid = ", ".join(f"{c}::DOUBLE" for c in config.grid)
    stratum = " + ".join(f"(n_words >= {edge})::INT" for edge in config.bands)
    share, chance = config.max_false_share, config.chance_per_test
    learning = ", ".join(f"'{x}'" for x in quality.LEARNING)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
under AS (SELECT doc_id, count(DISTINCT i + d.d) AS n FROM twice, (VALUES (0), (1), (2)) AS d(d) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper,
         len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks
  FROM split LEFT JOIN under USING (doc_id)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {stratum} AS stratum FROM counted),
ratios AS ({ratios}),
levels AS (SELECT doc_id, stratum, rule, len(list_filter([{grid}], lambda c: ratio > c)) AS level FROM ratios),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT *, substr(md5(doc_id::VARCHAR), 1, 1) IN ({learning}) AS learning FROM levels
         WHERE doc_id IN (SELECT doc_id FROM good) AND doc_id IN (SELECT doc_id FROM measured WHERE NOT base_failed)),
learned AS (SELECT stratum, rule, max(level) AS least FROM held WHERE learning GROUP BY ALL),
tested AS (
  SELECT doc_id, stratum, max(CASE WHEN level > coalesce(least, 0) THEN level ELSE 0 END) AS level
  FROM held LEFT JOIN learned USING (stratum, rule) WHERE NOT learning GROUP BY ALL),
tests AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (WHERE level > step) AS k
  FROM tested, (SELECT unnest(range(0, {len(config.grid)})) AS step) GROUP BY ALL),
certified AS (
  SELECT stratum, min(step) AS step
  FROM tests WHERE k <= {share} * n AND {chance} >= (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))
    FROM (SELECT unnest(range(0, k + 1)) AS i))
  GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM levels l JOIN certified USING (stratum) LEFT JOIN learned USING (stratum, rule)
         WHERE l.doc_id = m.doc_id AND level > greatest(step, coalesce(least, 0))) AS kept
FROM measured m
"""


ORACLES["op3_quality_rules"] = _quality_sql()


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 4096 tokens."""
    vocabulary = tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)


@query
def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the packed id matrices of all documents, then digest the files row by row."""
    vocabulary = tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    path = scratch_path(spark, "matrices")
    matrices.write_matrices(matrices.token_matrices(table(spark, sf_dir, "documents"), vocabulary), path)
    return spark.read.schema(matrices.MATRIX_SCHEMA).parquet(path).select(
        "sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"),
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows that are not held out, score every whole text."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, machine)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", predicted)


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 80 % of their five-word shingles."""
    return jaccard.linked_groups(table(spark, sf_dir, "documents"))


ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id")
    return sharding.place_on_shards(docs, "doc_id", sharding.shard_names(sharding.SHARDS))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url by the rules, else by the reputation of its host."""
    return urls.judged_urls(table(spark, sf_dir, "pages"))


def _urls_sql(config: urls.RankConfig = urls.RankConfig()) -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in urls.RULES)
    d = config.damping
    return rf"""
WITH RECURSIVE rules(by_rule, rule_host, rule_path, rule) AS (VALUES {rules}),
rest AS (
  SELECT row_number() OVER () AS row, page_id, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT row, rule, by_rule FROM parts JOIN rules
  ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC) = 1),
ruled AS (SELECT parts.*, rule, by_rule FROM parts LEFT JOIN fits USING (row)),
edges AS (
  SELECT src, dst, count(*) AS w FROM (
    SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{urls.LINK.replace("'", "''")}', 1))), '{urls.UPPER}', '{urls.LOWER}') AS dst
    FROM parts WHERE host <> '')
  WHERE src <> dst GROUP BY ALL),
links AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share_out, w / sum(w) OVER (PARTITION BY dst) AS share_in FROM edges),
ranks0 AS (
  SELECT host, {1 - d} * count(*) FILTER (WHERE by_rule = 'allow') AS trust, {1 - d} * count(*) FILTER (WHERE by_rule = 'block') AS distrust
  FROM ruled WHERE host <> '' AND rule IS NOT NULL GROUP BY host),
walk AS (
  SELECT host, 0 AS round, trust, distrust FROM ranks0
  UNION ALL
  SELECT CASE WHEN host = src THEN dst ELSE src END, round + 1,
         sum(CASE WHEN host = src THEN {d} * trust * share_out ELSE 0 END),
         sum(CASE WHEN host = dst THEN {d} * distrust * share_in ELSE 0 END)
  FROM walk JOIN links ON host = src OR host = dst
  WHERE trust + distrust > 1e-18 AND round < 300 GROUP BY ALL),
ranks AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM walk GROUP BY host),
bad AS (SELECT host FROM ranks WHERE round(distrust / (trust + distrust), {urls.DIGITS}) >= {config.block_share})
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


ORACLES["op9_url_filter"] = _urls_sql()


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop lines of 40 code points or more that five documents hold, except in the largest doc_id."""
    found = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, line, place,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, line, place, last IS NOT NULL AND doc_id < last AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, with the proofs checked on tampered rows."""
    found = merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_chars())
    return found.drop("proof")


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text of digits: byte by byte, eight shifts each."""
    value = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: %s)"
    step = "xor(a, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda s: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    return f"xor({value % step}, 4294967295)"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, {{0}} AS head, {{1}} AS tail,
         CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || {{2}} || tail) AS leaf, sha256(head || {{3}} || tail) AS seen,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM fields),
tree AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
path AS (
  SELECT doc_id, l.lang, t.level, l.i >> t.level AS place, s.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, level, n FROM tree WHERE n > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.i = xor(l.i >> t.level, 1)
  UNION ALL
  SELECT doc_id, l.lang, height + t.level, r.i >> t.level, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT level, n FROM top WHERE n > 1) t
  LEFT JOIN top s ON s.level = t.level AND s.i = xor(r.i >> t.level, 1)),
proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, max(level) + 1 AS steps
  FROM path GROUP BY doc_id),
folded AS (
  SELECT doc_id, 0 AS level, seen AS h FROM leaves
  UNION ALL
  SELECT doc_id, f.level + 1,
         sha256(CASE WHEN sibling IS NULL THEN h WHEN place & 1 = 1 THEN sibling || h ELSE h || sibling END)
  FROM folded f JOIN path p USING (doc_id, level))
SELECT doc_id, leaf, subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       folded.h AS folded_root, folded.h = root.h AS verified
FROM leaves JOIN subroots r ON leaves.lang IS NOT DISTINCT FROM r.lang
     JOIN (SELECT h FROM top WHERE n = 1) root ON true
     LEFT JOIN proofs USING (doc_id) JOIN folded USING (doc_id)
WHERE folded.level = coalesce(steps, 0)
""".format(
    *(" || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in fields) for fields in (("doc_id", "source", "lang"), ("text",), ("n_chars",), ("told",)))
)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all orders of five filters, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT doc_id, part, {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS f FROM words),
told AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (f.A::INT + 2 * f.B::INT + 4 * f.C::INT + 8 * f.D::INT + 16 * f.E::INT) AS mask, count(*) AS n,
         count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM failing LEFT JOIN told USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS name, (1 << (ascii(filter_order[step]) - 65)) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counts AS (
  SELECT part, filter_order, step, name,
         coalesce(sum(n) FILTER (WHERE mask & (bit | coalesce(earlier, 0)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM counts
"""
