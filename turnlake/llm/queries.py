"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bm25, bpe, chat_format, counts, decontaminate, divergence, jaccard, lines, merkle, neighbours, token_files, toxicity, urls
from turnlake.llm.common import read, text_of

Query = Callable[[SparkSession, str], DataFrame]

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def ids_digests() -> list[Column]:
    """Number and digests of ``ids`` and ``decoded``."""
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", *ids_digests())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.deduplicated_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("_lines.lines").alias("n_lines"), F.col("_lines.kept").alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, itself among them."""
    docs = read(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where(F.col("doc_id") % 20 == 0))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(more)
    made = chat_format.format_turns(rows)
    back = made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), RULES)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, held against texts that lost their line ends where 2 divides the id's checksum."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = merkle.leaf_digest(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf_digest(*fields).alias("leaf"), F.when(altered, tampered).alias("tampered"))
    manifest = merkle.build_manifest(rows, "source", ["doc_id"], "leaf")
    root, seen = F.lit(manifest.root), F.coalesce("row.tampered", "leaf")
    found = merkle.proofs(manifest).select(
        F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), merkle.folded(seen, F.col("siblings"), F.col("turns")).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == root)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_decontamination, op2_bpe, op3_line_dedup, op4_token_counts, op5_bm25, op6_chat_format, op7_toxicity, op8_url_filter, op9_token_files, op10_jaccard, op11_merkle, op12_neighbours, op13_source_divergence)
}

_TURNS = """
WITH rows AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)"""

# Components by repeated minima over links, from every document's own id.
_JACCARD = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM sizes
    UNION
    SELECT y, seen FROM reach JOIN both_ways ON x = node
)
SELECT doc_id, n AS n_shingles, (SELECT min(seen) FROM reach WHERE node = doc_id) AS component_id FROM sizes
"""

# Trees level by level; the checksum byte by byte with its table of 256 remainders.
_MERKLE = """
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, CAST(i AS UBIGINT) AS v FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM bits WHERE k < 8
), remainders AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS (
    SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text,
           xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                           lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) AS crc
    FROM documents, remainders
), leaves AS (
    SELECT doc_id, source AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
    FROM rows
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
    SELECT grp, 0 AS lvl, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
), subroots AS (
    SELECT grp, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS lvl, pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n
), sides AS (
    SELECT p.grp, p.pos, x.lvl AS step, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < p.pos // CAST(3 ** x.lvl AS BIGINT)), '') AS l,
           coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > p.pos // CAST(3 ** x.lvl AS BIGINT)), '') AS r
    FROM placed p JOIN nodes x ON p.grp IS NOT DISTINCT FROM x.grp AND x.n > 1 AND x.pos // 3 = (p.pos // CAST(3 ** x.lvl AS BIGINT)) // 3 GROUP BY ALL
    UNION ALL
    SELECT p.grp, p.pos, s.height + x.lvl, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < s.pos // CAST(3 ** x.lvl AS BIGINT)), ''),
           coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > s.pos // CAST(3 ** x.lvl AS BIGINT)), '')
    FROM placed p JOIN subroots s ON p.grp IS NOT DISTINCT FROM s.grp JOIN tops x ON x.n > 1 AND x.pos // 3 = (s.pos // CAST(3 ** x.lvl AS BIGINT)) // 3
    GROUP BY p.grp, p.pos, s.height, x.lvl
), folds AS (
    SELECT grp, pos, 0 AS step, coalesce(tampered, leaf) AS digest FROM placed
    UNION ALL
    SELECT f.grp, f.pos, f.step + 1, sha256(l || digest || r) FROM folds f JOIN sides s ON f.grp IS NOT DISTINCT FROM s.grp AND f.pos = s.pos AND f.step = s.step
), ends AS (SELECT grp, pos, arg_max(digest, step) AS folded_root FROM folds GROUP BY grp, pos),
proofs AS (SELECT grp, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY grp, pos),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p CROSS JOIN root JOIN subroots s ON p.grp IS NOT DISTINCT FROM s.grp JOIN ends e ON p.grp IS NOT DISTINCT FROM e.grp AND p.pos = e.pos
LEFT JOIN proofs q ON p.grp IS NOT DISTINCT FROM q.grp AND p.pos = q.pos
"""

# Exact integers of 128 bits throughout.
_DIVERGENCE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
              FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30),
counted AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
own AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
priced AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 5) // (sum(c) OVER w + 5 * count(*) OVER w) AS p FROM own WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c) AS c FROM own GROUP BY ALL),
langs AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 5) // (sum(c) OVER w + 5 * count(*) OVER w) AS q FROM whole WINDOW w AS (PARTITION BY lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN priced x ON x.lang = g.lang AND x.source = g.source LEFT JOIN priced y ON y.lang = h.lang AND y.source = h.source AND y.term = x.term
          GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM priced JOIN langs USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

CHECKS: dict[str, str] = {
    "op10_jaccard": _JACCARD,
    "op11_merkle": _MERKLE,
    "op13_source_divergence": _DIVERGENCE,
    "op6_chat_format": _TURNS
    + """
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### : </turn>' || chr(10)) + length(role) + length(text)
           + length(text) - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', ''))
       ) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""",
}
