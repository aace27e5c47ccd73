"""The numbered queries over the shared tables, and the SQL that agrees with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import (
    bestfit,
    bpe,
    exact_dedup,
    jaccard,
    merkle,
    quality,
    repair,
    repeats,
    retrieval,
    secrets,
    sharding,
    toxicity,
    vocab,
    warc,
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe_encoder():
    return vocab.rank_encoder(
        vocab.public_path("byte_bpe_50k.tiktoken"), vocab.public_path(vocab.BYTE_BPE), vocab.public_pattern()
    )


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.check_round_trip(
        read(spark, folder, "documents"), vocab.public_path(vocab.MULTI), vocab.public_pattern()
    )


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.pack_documents(read(spark, folder, "documents"), byte_bpe_encoder())


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(read(spark, folder, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(read(spark, folder, "documents"), n=4, percent=85)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, folder, "documents"), length=200)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"), shards=8)


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, folder, "documents"))


def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(read(spark, folder, "conversations"))


def op12_lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.pack_by_retrieval(
        read(spark, folder, "documents"), vocab.word_encoder(vocab.public_path(vocab.WORD_BPE))
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(read(spark, folder, "documents"))


OP3_SQL = """
WITH records AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
),
placed AS (
    SELECT *, CASE WHEN payload_bytes >= 100
                   THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
    FROM records
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM placed
"""

OP10_SQL = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
),
heads AS (
    SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
    FROM texts GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM texts JOIN heads USING (text_sha256)
"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


def repair_sql() -> str:
    """SQL of ``op11_structure_repair``: the cheapest, then least way to each state, row after row."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def way(state: str, cost: str, letter: str, line: str | None = None, when: str = "TRUE") -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        made = f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {lines})"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {made} END"

    def best(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    def inserted(source: str) -> str:
        """Up to three insertions in a row; more come back to a state that was cheaper before."""
        u1 = best("u", *[way(x, "2", "I", "'user:'") for x in ("e", "s", "a")])
        return f"""
            SELECT * EXCLUDE (u1, u, a1), a1 AS a, {best("u1", way("a1", "2", "I", "'user:'"))} AS u
            FROM (SELECT * EXCLUDE (a), {best("a", way("u1", "2", "I", "'assistant:'"))} AS a1
                  FROM (SELECT *, {u1} AS u1 FROM {source}))"""

    def kept(state: str, initial: str) -> str:
        return way(state, "extra", "K", "role || ':' || text", f"NOT gone AND initial = '{initial}'")

    def reroled(state: str, role: str) -> str:
        return way(state, "2 + extra", "R", f"'{role}:' || text", "NOT gone")

    users = [f(x, y) for f, y in ((kept, "u"), (reroled, "user")) for x in ("e", "s", "a")]
    new = {
        "e": way("e", "3", "D"),
        "s": best(way("s", "3", "D"), kept("e", "s")),
        "u": best(way("u", "3", "D"), *users),
        "a": best(way("a", "3", "D"), kept("u", "a"), reroled("u", "assistant")),
    }
    crc = crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")
    way_type = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return f"""
WITH RECURSIVE marked AS (SELECT *, {crc} % 20 AS k FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
           unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM marked WHERE k <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn FROM damaged
),
looked AS (
    SELECT *, rtrim(text, {white}) = '' AS blank, right(rtrim(text, {white}), 1) NOT IN ('.', '!', '?') AS cut_off,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair
    FROM placed
),
judged AS (
    SELECT conv_id, turn, role, text, rn, left(role, 1) AS initial, pair, blank, NOT blank AND seen AS duplicate,
           NOT blank AND NOT seen AND cut_off AS truncated, blank OR seen AS gone,
           CASE WHEN NOT blank AND NOT seen AND cut_off THEN 1 ELSE 0 END AS extra
    FROM looked
),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
           count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
           count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n
    FROM judged GROUP BY conv_id
),
ways AS (
    SELECT conv_id, 0::BIGINT AS at, struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])::{way_type} AS e,
           NULL::{way_type} AS s, NULL::{way_type} AS u, NULL::{way_type} AS a
    FROM counts
    UNION ALL
    SELECT conv_id, rn AS at, {", ".join(f"({x})::{way_type} AS {name}" for name, x in new.items())}
    FROM ({inserted("(SELECT w.conv_id, w.e, w.s, w.u, w.a, j.rn, j.role, j.text, j.initial, j.gone, j.extra FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.rn = w.at + 1)")})
),
ended AS (
    SELECT conv_id, {best("e", "a")} AS w
    FROM ({inserted("(SELECT w.* FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.at = c.n)")})
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def merkle_sql(source_levels: int, top_levels: int) -> str:
    """SQL of ``op13_merkle_manifest``, for at most 16^levels leaves of a source and sources."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}) END"
    before = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = crc32_sql("doc_id::VARCHAR")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves AS (
            SELECT doc_id, coalesce('=' || source, '-') AS tree,
                   sha256({before} || {field.format("text")}) AS leaf,
                   CASE WHEN {crc} % 5 = 0 THEN sha256({before} || {field.format(lower)}) END AS touched
            FROM documents
        )""",
        """s0 AS (
            SELECT doc_id, tree, leaf, coalesce(touched, leaf) AS fold, leaf AS node, '' AS proof,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
            FROM leaves
        )""",
    ]

    def climb(name: str, levels: int, key: str, kept: str) -> None:
        # A node and the leaves below it share i; every leaf carries its own node, proof and fold.
        for k in range(levels):
            parts.append(
                f"""{name}n{k} AS (SELECT DISTINCT {key}, i, node FROM {name}{k}),
        {name}r{k} AS (
            SELECT {key}, i // 16 AS run, list(node ORDER BY i) AS nodes,
                   sum(count(*)) OVER (PARTITION BY {key}) > 1 AS more
            FROM {name}n{k} GROUP BY {key}, i // 16
        ),
        {name}w{k} AS (
            SELECT s.*, r.nodes, r.more,
                   array_to_string(r.nodes[1 : s.i % 16], '') AS lefts, array_to_string(r.nodes[s.i % 16 + 2 :], '') AS rights
            FROM {name}{k} s JOIN {name}r{k} r ON s.{key} = r.{key} AND s.i // 16 = r.run
        ),
        {name}{k + 1} AS (
            SELECT {kept}, i // 16 AS i,
                   CASE WHEN more THEN sha256(array_to_string(nodes, '')) ELSE node END AS node,
                   CASE WHEN more THEN proof || lefts || rights ELSE proof END AS proof,
                   CASE WHEN more THEN sha256(lefts || fold || rights) ELSE fold END AS fold
            FROM {name}w{k}
        )"""
            )

    climb("s", source_levels, "tree", "doc_id, tree, leaf")
    parts.append(
        f"""t0 AS (
            SELECT doc_id, leaf, node AS subroot, fold, node, proof, 'root' AS tree,
                   dense_rank() OVER (ORDER BY tree) - 1 AS i
            FROM s{source_levels}
        )"""
    )
    climb("t", top_levels, "tree", "doc_id, leaf, subroot, tree")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified
        FROM t{top_levels}"""


OP11_SQL = repair_sql()
OP13_SQL = merkle_sql(source_levels=4, top_levels=2)


def queries():
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_warc": op3_warc,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_sharding": op6_sharding,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_structure_repair": op11_structure_repair,
        "op12_lexical_packing": op12_lexical_packing,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_structure_repair": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
