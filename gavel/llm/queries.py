"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from gavel.llm.common import n_words, table, tuned
from gavel.llm.exact_dedup import exact_dedup
from gavel.llm.hard_negatives import hard_negatives, usable_vectors
from gavel.llm.licences import scan_licences
from gavel.llm.merkle import COLUMNS, manifest
from gavel.llm.mixing import mix, taken
from gavel.llm.near_dedup import near_dedup
from gavel.llm.packing import added_tokens, pack
from gavel.llm.pii import find_personal_data, joined_spans
from gavel.llm.quality import rate_quality, trusted_ids
from gavel.llm.sharding import shard_documents
from gavel.llm.suffix_dedup import remove_repeats
from gavel.llm.tool_calls import link_tool_calls
from gavel.llm.warc import archive_pages

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(tuned(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op2_exact_dedup",
    r"""
    WITH normal AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM normal WINDOW same AS (PARTITION BY t)
    """,
)
def op2(spark, folder) -> DataFrame:
    found = exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_minhash_near_dedup")
def op3(spark, folder) -> DataFrame:
    found = near_dedup(table(spark, folder, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_best_fit_packing")
def op4(spark, folder) -> DataFrame:
    packed = pack(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )
    return packed.drop("ids")


@query("op6_source_mixing")
def op6(spark, folder) -> DataFrame:
    queue, served = mix(table(spark, folder, "documents"))
    return taken(queue, served).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_quality_rules")
def op7(spark, folder) -> DataFrame:
    rated = rate_quality(
        table(spark, folder, "documents"), trusted_ids(table(spark, folder, "labels"))
    )
    return rated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("score", 9).alias("score"),
    )


@query("op5_personal_data")
def op5(spark, folder) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


@query(
    "op8_warc_archives",
    """
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS body FROM pages
    ), digests AS (
        SELECT page_id, octet_length(encode(body)) AS payload_bytes, body,
               max(page_id) OVER (PARTITION BY body) AS response
        FROM payloads
    )
    SELECT page_id, payload_bytes,
           CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> response THEN response END AS refers_to,
           (SELECT string_agg(
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + list_sum(list_transform(range(5), lambda k: CASE
                           WHEN (instr('0123456789abcdef', sha1(body)[1 + (5 * g + k) // 4]) - 1)
                                & (8 >> ((5 * g + k) % 4)) > 0 THEN 16 >> k ELSE 0 END))::INT, 1),
                '' ORDER BY g)
            FROM range(32) AS t(g)) AS payload_digest
    FROM digests
    """,
)
def op8(spark, folder) -> DataFrame:
    read = archive_pages(table(spark, folder, "pages"))
    return read.select(
        F.col("source_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.col("refers_to_id").alias("refers_to"),
    )


TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False), "after": ("object", False)},
    "read": {"query": ("string", True), "after": ("object", True)},
}


def tool_dialogues(conversations: DataFrame) -> DataFrame:
    """Conversations in which every assistant turn made a tool call, whose result is its text.

    Calls refer to the assistant turn two turns earlier; some have faulty arguments, no result, or
    two, by the number of words. In some conversations the first call refers ahead to the second,
    and in some those two refer to each other.
    """
    words = n_words(F.col("text"))
    call_id = F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turn, way = F.col("turn"), F.coalesce(F.pmod(F.col("conv_id"), F.lit(10)), F.lit(0))
    ahead = (turn == 1) & way.isin(3, 7)
    other = F.when(ahead, turn + 2).when((turn > 2) & ~((turn == 3) & (way == 3)), turn - 2)
    needed = F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), other.cast("string"))
    arguments = F.to_json(
        F.struct(
            F.col("text").alias("query"),
            F.when(words % 13 == 0, words.cast("string")).alias("limit"),
            F.when(other.isNotNull(), F.struct(needed.alias("$ref"))).alias("after"),
        )
    )
    named = F.struct(
        call_id.alias("id"),
        F.when(words % 2 == 0, F.lit("search")).otherwise(F.lit("read")).alias("name"),
        arguments.alias("arguments"),
    )
    none = F.lit(None).cast("string")
    assistant = F.col("role") == "assistant"
    spoken = conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(assistant, F.array(named)).alias("calls"),
        none.alias("call_id"),
    )
    times = F.when(words % 5 == 0, 0).when(words % 7 == 0, 2).otherwise(1)
    returned = (
        conversations.filter(assistant)
        .withColumn("_times", F.explode(F.array_repeat(F.lit(1), times)))
        .select(
            "conv_id",
            "turn",
            F.lit("tool").alias("role"),
            "text",
            F.lit(None).cast(spoken.schema["calls"].dataType).alias("calls"),
            call_id.alias("call_id"),
        )
    )
    return spoken.unionAll(returned)


@query("op10_tool_call_linking")
def op10(spark, folder) -> DataFrame:
    events = link_tool_calls(tool_dialogues(table(spark, folder, "conversations")), TOOLS)
    return events.withColumn("errors", F.array_join("errors", "; "))


@query("op1_suffix_array_dedup")
def op1(spark, folder) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_licence_scan")
def op9(spark, folder) -> DataFrame:
    found = scan_licences(table(spark, folder, "documents"))
    listed = F.transform(
        "found",
        lambda x: F.concat_ws(
            ":", x["family"], x["paragraph"].cast("string"), x["start"].cast("string")
        ),
    )
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("bigint").alias("n_licences"),
        F.array_join(listed, ",").alias("licences"),
        F.array_min(F.transform("found", lambda x: x["probability"])).alias("least_probability"),
        F.array_join(
            F.transform(
                "unknown",
                lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["start"].cast("string")),
            ),
            ",",
        ).alias("unknown"),
    )


@query(
    "op11_hard_negatives",
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               list_inner_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (
               PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11(spark, folder) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = usable_vectors(table(spark, folder, "embeddings"), noisy)
    return hard_negatives(vectors, vec_id % 100 == 0)


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _: {step})"
    every = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {every}), lambda c, b: {byte}), 4294967295)"


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """Levels of trees over ``leaves`` (tree, idx, d); a level has left and right siblings, and
    whether its trees go on growing."""
    parts, below = [], leaves
    for k in range(levels + 1):
        parts.append(f"""
    {name}{k} AS MATERIALIZED (
        SELECT tree, idx, d, count(*) OVER (PARTITION BY tree) > 1 AS grows,
               coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {below}
    )""")
        below = f"""(
            SELECT tree, idx // 16 AS idx, CASE WHEN any_value(grows)
                   THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d
            FROM {name}{k} GROUP BY tree, idx // 16)"""
    return ",".join(parts)


def _sql_manifest(levels: int = 6, source_levels: int = 4) -> str:
    def leaf(text: str) -> str:
        values = [c if c != "text" else text for c in COLUMNS]
        coded = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values]
        return f"sha256({' || '.join(coded)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [(f"n{k}", f"n{k}.idx = rank // {16 ** k} AND n{k}.tree = base.tree") for k in range(levels)]
    steps += [(f"u{k}", f"u{k}.idx = place // {16 ** k}") for k in range(source_levels)]
    joins = " ".join(f"JOIN {t} ON {on}" for t, on in steps)
    proof = [f"CASE WHEN {t}.grows THEN {t}.l || {t}.r ELSE '' END" for t, _ in steps]
    chain, now = [], "now"
    for k, (t, _) in enumerate(steps):
        chain.append(f"CASE WHEN {t}.grows THEN sha256({t}.l || {now} || {t}.r) ELSE {now} END AS f{k}")
        now = f"f{k}"
    return f"""
    WITH base AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
        FROM (
            SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf("text")} AS leaf,
                   CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 5 = 0
                        THEN {leaf(lowered)} ELSE {leaf("text")} END AS now
            FROM documents)
    ), first AS (SELECT tree, rank AS idx, leaf AS d FROM base),
    {_sql_tree("n", "first", levels)},
    sources AS MATERIALIZED (
        SELECT tree AS key, d, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{levels}
    ), subroots AS (SELECT 0 AS tree, place AS idx, d FROM sources),
    {_sql_tree("u", "subroots", source_levels)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM (
        SELECT doc_id, leaf, sources.d AS subroot, (SELECT d FROM u{source_levels}) AS root,
               sha256({" || ".join(proof)}) AS proof_sha256, {", ".join(chain)}, {now} AS folded_root
        FROM base JOIN sources ON sources.key = base.tree {joins})
    """


@query("op12_merkle_manifest", _sql_manifest())
def op12(spark, folder) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(table(spark, folder, "documents"), touched)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        "folded_root",
        "verified",
    )


@query("op13_balanced_sharding")
def op13(spark, folder) -> DataFrame:
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
