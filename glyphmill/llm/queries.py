"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.chat_format import format_chats, loss_text, read_back
from glyphmill.llm.decontaminate import contained_items
from glyphmill.llm.jaccard_join import jaccard_components
from glyphmill.llm.language_id import identify_languages
from glyphmill.llm.lexical_search import best_documents
from glyphmill.llm.license_scan import scan_licenses
from glyphmill.llm.merkle import COLUMNS, digest, fold, leaf_content, merkle_manifest, proof_digest
from glyphmill.llm.piece_dropout import encode_pieces
from glyphmill.llm.pii import find_personal_data
from glyphmill.llm.quality_classifier import score_quality
from glyphmill.llm.quality_rules import apply_rules
from glyphmill.llm.token_counts import count_tokens
from glyphmill.llm.token_files import token_files

#: The public piece vocabulary that the registered queries use.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def piece_model(name: str = PIECE_MODEL) -> bytes:
    """Bytes of a public vocabulary file (up to two megabytes), read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("rule")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), piece_model())


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], rows.schema)
    made = format_chats(rows.unionByName(more))
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(_table(spark, sf_dir, "documents"), piece_model())
    return found.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "lossless")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), piece_model(BYTE_MODEL).decode(), end_id=2)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = digest(leaf_content([text if c == "text" else F.col(c) for c in COLUMNS]))
    made = merkle_manifest(_table(spark, sf_dir, "documents"), tampered=tampered)
    folded = made.withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", verified)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_classifier,
        op3_quality_rules,
        op4_license_scan,
        op5_token_counts,
        op6_benchmark_decontamination,
        op7_chat_format,
        op8_language_id,
        op9_personal_data,
        op10_piece_dropout,
        op11_token_files,
        op12_merkle_manifest,
        op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
        ), q AS (SELECT item_id, t, count(*) AS qtf FROM i GROUP BY ALL
        ), s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0
        ), p AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, len(w), t
        ), v AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
        ), c AS (
            SELECT item_id, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
            FROM q JOIN p USING (t) JOIN v USING (t), s GROUP BY item_id, doc_id
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c WHERE score > 0
        ) WHERE rank <= 10
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || source, '-') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
                coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 2 = 0, false) AS tampered
            FROM documents
        ), h AS (
            SELECT uid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS changed
            FROM (SELECT *, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS t FROM d)
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h
        ), low(tree, k, pos, node, n) AS (
            SELECT tree, 0, pos, leaf, n FROM leaves UNION ALL
            SELECT tree, k + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, k, pos // 3, n
        ), subs AS (
            SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree <> '-', encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
        ), up(k, pos, node, n) AS (
            SELECT 0, pos, subroot, n FROM subs UNION ALL
            SELECT k + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY k, pos // 3, n
        ), depth AS (SELECT tree, max(k) AS top FROM low GROUP BY tree
        ), low_steps AS (
            SELECT l.uid, s.k, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (3 ** s.k)::BIGINT), '') AS before,
                coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (3 ** s.k)::BIGINT), '') AS after
            FROM leaves l JOIN low s ON s.tree = l.tree AND s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.k + 1))::BIGINT GROUP BY l.uid, s.k
        ), high_steps AS (
            SELECT l.tree, s.k, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (3 ** s.k)::BIGINT), '') AS before,
                coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (3 ** s.k)::BIGINT), '') AS after
            FROM subs l JOIN up s ON s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.k + 1))::BIGINT GROUP BY l.tree, s.k
        ), steps AS (
            SELECT uid, k, before, after FROM low_steps UNION ALL
            SELECT l.uid, p.top + s.k, s.before, s.after FROM leaves l JOIN depth p USING (tree) JOIN high_steps s USING (tree)
        ), folding(uid, k, node) AS (
            SELECT uid, 0, changed FROM leaves UNION ALL
            SELECT f.uid, f.k + 1, sha256(s.before || f.node || s.after) FROM folding f JOIN steps s ON s.uid = f.uid AND s.k = f.k
        ), folded AS (SELECT uid, max_by(node, k) AS folded_root FROM folding GROUP BY uid
        ), proofs AS (SELECT uid, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY uid
        ), root AS (SELECT node AS root FROM up WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subs USING (tree) JOIN folded USING (uid) LEFT JOIN proofs USING (uid), root
    """,
    "op7_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
        ), e AS (SELECT *, length(text) + length(regexp_replace(text, '[^~<\[\]]', '', 'g')) AS n FROM t
        ), m AS (SELECT *, n + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
            ELSE 14 + length(role) + length(regexp_replace(role, '[^~<\[\]]', '', 'g')) END AS chars FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op6_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
        ), si AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
                lambda p: array_to_string(list_slice(w, p, p + least(len(w), 5) - 1), ' '))) AS s FROM i WHERE len(w) > 0
        ), ni AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY 1
        ), sd AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS s
                FROM d, (SELECT DISTINCT k FROM si) WHERE len(w) >= k)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM sd JOIN si USING (k, s) JOIN ni USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
    """,
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
        ), links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
            JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
        ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) m ON m.a = d.doc_id
    """,
}
