"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, played over and over up to
``max_repeats`` times. A document's virtual finish time is the number of tokens its source has sent
up to its end, divided by the source's target. All queues together are sorted by finish time and cut
at the total budget, which every source reaches at virtual time 1, having sent its target.

The service is by the token, as in the fluid form of the discipline: the one document of a source
that is being sent when the budget ends is taken up to there, so a source meets its target to less
than one token, however long its documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import WORD, n_words, stored, unused
from gavel.operators.ordering import row_numbers, running_totals

#: Weights in the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2


def source_targets(
    sources: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(source, source_size) to the same with weight and target, in tokens.

    Sources in code-point order, null last, take the weights in turn. They share ``budget`` times
    all tokens by weight; what a source would get over ``max_repeats`` times its size is shared
    again among the others, until none is above. Each round is one aggregate of two numbers.
    """
    ranked = row_numbers(
        sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank", 0
    )
    turn = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    weighted = stored(
        ranked.select(
            "source",
            "source_size",
            F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
            (F.lit(float(max_repeats)) * F.col("source_size")).alias("most"),
        ),
        "mix-sources",
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level never falls, so a source at its most stays there
        full = F.col("most") < F.col("weight") * F.lit(level)
        at_most, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        raised = (budget * total - at_most) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    share = F.least("most", F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", "weight", share.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
    seed: str = "0",
    row: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(queue, served)`` for documents (doc_id, text, source).

    *queue*, one row per document: row_id, doc_id, source, size, source_size, target.
    *served*, one row per document and repeat that the mix takes, tokens over 0: row_id, doc_id,
    source, repeat, finish (virtual time), tokens (from the start of the document), before (tokens
    of the mix before it). Its order is (finish, source, repeat, row_id) and it is range-sorted.

    The size defaults to the words of the text. ``row`` names a column that numbers the rows; without
    it their place in the input does. Shuffles are by MD5 of seed and id, so reruns
    agree. Defined cases: null texts and empty ones have size 0 and are never taken; null sources
    are one source, the last; rows with the same id are told apart by text, and full copies of a
    row by any order, as they are alike; an empty table gives empty frames; other columns are not
    read.
    """
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (n_words(F.col("text")) if size is None else size.cast("bigint")).alias("size"),
            F.md5(key.cast("binary")).alias("_shuffle"),
            F.xxhash64("text").alias("_text"),
            (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row_id"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, weights, budget, max_repeats), "mix-targets")

    order = ["_shuffle", "doc_id", "_text", "row_id"]
    queued = running_totals(sized, order, {"_start": F.col("size")}, keys=["source"])
    queue = stored(
        queued.join(
            targets.withColumnRenamed("source", "_source"),
            F.col("source").eqNullSafe(F.col("_source")),
        ).select("row_id", "doc_id", "source", "size", "_start", "source_size", "target"
        ),
        "mix-queue",
    )
    # Tokens of the source sent before this repeat of the document.
    sent = F.col("_start") + F.col("repeat") * F.col("source_size")
    tokens = F.least(F.col("size"), F.floor("target").cast("bigint") - sent)
    turns = (
        queue.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("tokens", tokens)
        .filter("tokens > 0")
        .withColumn("finish", (sent + F.col("tokens")) / F.col("target"))
        .select("row_id", "doc_id", "source", "repeat", "finish", "tokens")
    )
    served = running_totals(
        turns, ["finish", "source", "repeat", "row_id"], {"before": F.col("tokens")}
    )
    total = F.floor(F.lit(float(budget)) * (sized.agg(F.sum("size")).first()[0] or 0))
    return queue.drop("_start"), served.filter(F.col("before") < total)


def taken(queue: DataFrame, served: DataFrame) -> DataFrame:
    """The queue with the tokens that the mix takes of every document, repeats counted."""
    sums = served.groupBy("row_id").agg(F.sum("tokens").alias("_taken"))
    return queue.join(sums, "row_id", "left").select(
        *queue.columns, F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: each repeat of a document is a row.

    The document that is being sent when the budget ends, one for each source at most, becomes its
    taken words, joined by single spaces; ``n_chars``, where there is one, is then its new length.
    """
    row, tokens, size = (unused(docs, name) for name in ("_row", "_tokens", "_size"))
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    queue, served = mix(numbered, row=row, **options)
    turns = served.select("row_id", F.col("tokens").alias(tokens)).join(
        queue.select("row_id", F.col("size").alias(size)), "row_id"
    )
    joined = numbered.join(turns.withColumnRenamed("row_id", row), row)
    cut = F.col(tokens) < F.col(size)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(tokens).cast("int"))
    text = F.when(cut, F.array_join(words, " ")).otherwise(F.col("text"))
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(text.alias(name))
        elif name == "n_chars":
            columns.append(
                F.when(cut, F.length(text)).otherwise(F.col(name)).cast(kind).alias(name)
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return joined.select(*columns)
