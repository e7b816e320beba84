"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import conversation_trie
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .packing import pack
from .piece_fst import piece_codes
from .pii import pii
from .quality_rules import quality_rules
from .signature_join import jaccard_components
from .source_divergence import source_divergence
from .store import documents
from .suffix_dedup import suffix_dedup
from .toxicity import held_out, toxicity
from .unit_dedup import unit_dedup
from .vector_graph import vector_graph

Query = Callable[[SparkSession, str], DataFrame]


def tokenizers_dir() -> str:
    """The folder of the public tokenizers: WAYGLASS_TOKENIZERS, or where the module public_tokenizers is."""
    named = os.environ.get("WAYGLASS_TOKENIZERS")
    if named:
        return named
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unit_dedup(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("row.doc_id", F.length("row.text").cast("long").alias("n_chars"), "n_units_removed", "n_chars_removed", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(documents(spark, sf_dir), os.path.join(tokenizers_dir(), "piece_bpe_32k.model"), ids=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), os.path.join(tokenizers_dir(), "byte_bpe_50k.json"), digest=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii(documents(spark, sf_dir))
    return out.select("row.doc_id", *[f"found.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir), keep=False)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "subtree_end")


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, source, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                     length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM g WHERE c >= 2) GROUP BY 1),
        b AS (SELECT m.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
                     CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
              FROM m LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 100 * n_words AS f2, 100 * n_dup_lines > 60 * n_lines AS f3 FROM b),
        h AS (SELECT source, count(*) AS n, [count(*) FILTER (base_failed), count(*) FILTER (f2), count(*) FILTER (f3)] AS k FROM f GROUP BY source),
        x AS (SELECT source, n, unnest(k) AS k, unnest([1, 2, 3]) AS rule FROM h),
        a AS (SELECT rule, sum(k) / sum(n) AS p, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v FROM x GROUP BY rule),
        s AS (SELECT rule, p, CASE WHEN v > 0 THEN least(greatest(p * (1 - p) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM a),
        j AS (SELECT source, max(CASE WHEN (k + p * s) / (n + s) > 0.5 THEN 1 ELSE 0 END) AS gone FROM x JOIN s USING (rule) GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone = 0 AS kept
        FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
    "op2_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
        k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        y AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM y GROUP BY doc_id""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS g FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_conversation_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                          substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT c, max(p) + 1 AS n FROM t GROUP BY c),
        h AS (SELECT c, n, c - c % 5 AS b, (xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
                     lambda a, y: list_reduce(list_transform(range(8), lambda z: 0::BIGINT), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END, xor(a, y)), 4294967295::BIGINT))) % 9 AS h FROM n),
        k AS (SELECT h.*, least(h.h, coalesce(n.n, 0)) AS kept FROM h LEFT JOIN n ON n.c = h.b),
        s AS (SELECT k.c, t.p - k.h + k.kept AS q, r, x FROM k JOIN t ON t.c = k.c AND t.p >= k.h UNION ALL SELECT k.c, t.p, r, x FROM k JOIN t ON t.c = k.b AND t.p < k.kept),
        m AS (SELECT k.c, coalesce(max(q) + 1, 0) AS m FROM k LEFT JOIN s USING (c) GROUP BY k.c),
        e AS (SELECT c, q, strlen(x) AS len, sha256(string_agg(strlen(r)::VARCHAR || ':' || sha256(r || x), ',') OVER (PARTITION BY c ORDER BY q)) AS node FROM s),
        f AS (SELECT c, q + 1 AS d, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY q), '') AS above, len FROM e UNION ALL SELECT c, 0, '', NULL, 0 FROM m),
        g AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(len) AS len,
                     coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m.m = d), '') AS ends FROM f JOIN m USING (c) GROUP BY d, node),
        ch AS (SELECT above AS node, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
        l AS (SELECT g.*, coalesce(ch.n, 0) AS n_children FROM g LEFT JOIN ch USING (node)),
        mem AS (SELECT DISTINCT f.node AS top, u.node AS below FROM f JOIN f u ON u.c = f.c AND u.d >= f.d),
        a AS (SELECT top AS node, count(*) FILTER (l.n_children = 0) AS n_leaves, sum((l.n_convs - 1) * l.len) AS saved FROM mem JOIN l ON l.node = mem.below GROUP BY 1)
        SELECT l.conv_id, l.d AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(l.ends) AS ends_sha256
        FROM l JOIN a USING (node) LEFT JOIN l u ON u.node = l.above AND l.d > 0""",
    "op12_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        u AS (SELECT i, vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.label = b.label AND a.i <> b.i AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT r.a, min(v.vec_id) AS least FROM r JOIN v ON v.i = r.b GROUP BY r.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
        FROM v LEFT JOIN n ON n.a = v.i LEFT JOIN c ON c.a = v.i""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM x GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
        c AS (SELECT x.lang, source, x.term, count(*)::HUGEINT AS n FROM x SEMI JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY x.lang, source, x.term),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
        p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
              FROM t JOIN v ON v.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
