"""Quality rules: counted features, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hash buckets of n-grams are counted: of the whole corpus, and of
its trusted documents. A document's score is the log of the ratio of its likelihoods under the two,
divided by its number of n-grams, so that it doesn't grow with the length. Every document is held
against one fixed threshold.

The n-grams are the words, and pairs of neighbouring word shapes, in which runs of letters are one
character; shapes tell prose from tables, shouting and symbols in any language. All of it is DataFrame functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import WORD, unused

BUCKETS = 1 << 13
#: The trusted multinomial is fitted on at most so many labelled documents (by hash of the id).
TRUSTED_ROWS = 20_000
#: Nats per n-gram; documents below it are rejected.
THRESHOLD = -0.4
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def _words(text: Column) -> Column:
    """Words of a text; cutting at one plain character is much faster than by a pattern."""
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _without_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def _without_first(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with the text, null as empty, its words and their shapes.

    Each is a column of its own, so that functions over them are compiled and run once.
    """
    text = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    shape = F.regexp_replace(F.col("_text"), r"\p{L}+", "a")
    return text.withColumn("_words", _words(F.col("_text"))).withColumn("_shapes", _words(shape))


def _base(rated: DataFrame) -> DataFrame:
    """Adds the counted features.

    Words of repeated 3-word windows: the windows' hashes, their last bits replaced by their places,
    are sorted as plain numbers; then equal windows are neighbours, and the low bits tell where
    they are. A hash keeps at least 43 bits in texts of up to a million words.
    """
    text, words = F.col("_text"), F.col("_words")
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    n = F.size(words)
    span = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    bits = F.col("_bits")
    placed = F.transform(
        span,
        lambda i: F.call_function(
            "shiftleft",
            F.call_function(
                "shiftright", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits
            ),
            bits,
        ).bitwiseOR(i.cast("bigint")),
    )
    sorted_ = F.col("_sorted")
    places = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    again = F.zip_with(
        _without_last(sorted_),
        _without_first(sorted_),
        lambda a, b: F.when(
            F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0, F.array(a, b)
        ),
    )
    starts = F.array_distinct(F.flatten(F.array_compact(again)))
    covered = F.flatten(
        F.transform(
            starts,
            lambda x: F.transform(
                F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: x.bitwiseAND(F.col("_places")) + k
            ),
        )
    )
    width = F.when(n > 0, F.length(F.bin(n))).otherwise(F.lit(1)).cast("int")
    return (
        rated.withColumn("_bits", width)
        .withColumn("_places", places)
        .withColumn("_lines", with_word)
        .withColumn("_sorted", F.sort_array(placed))
        .withColumns(
            {
                "n_words": n.cast("bigint"),
                "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
                "n_symbols": (
                    F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
                ).cast("bigint"),
                "n_dup_lines": (
                    F.size("_lines") - F.size(F.array_distinct("_lines"))
                ).cast("bigint"),
                "n_repeat_words": F.size(F.array_distinct(covered)).cast("bigint"),
            }
        )
    )


def _bucket(buckets: int, *parts: Column) -> Column:
    """A bucket number; ``buckets`` is a power of two."""
    return F.hash(*parts).bitwiseAND(F.lit(buckets - 1))


def log_ratios(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS
) -> np.ndarray:
    """Log of trusted over corpus probability for every bucket.

    Counts cover all of ``docs``. Add-one smoothing keeps empty buckets finite. Without any trusted
    document there is nothing to compare with, and all ratios are 0.
    """
    chosen = (
        trusted.select(F.col("doc_id").cast("long").alias("_trusted"))
        .filter("_trusted is not null")
        .distinct()
        .orderBy(F.xxhash64("_trusted"), "_trusted")
        .limit(trusted_rows)
    )
    # At most trusted_rows numbers.
    marked = _prepared(docs.select("doc_id", "text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_trusted"), "left"
    )
    grams = F.concat(
        F.transform("_words", lambda w: _bucket(buckets, w)),
        F.zip_with(
            _without_last(F.col("_shapes")),
            _without_first(F.col("_shapes")),
            lambda a, b: _bucket(buckets, a, b),
        ),
    )
    counts = (
        marked.select(
            F.explode(grams).alias("bucket"),
            F.col("_trusted").isNotNull().cast("long").alias("trusted"),
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("corpus"), F.sum("trusted").alias("trusted"))
        .collect()  # one row per bucket
    )
    corpus, target = np.ones(buckets), np.ones(buckets)
    for row in counts:
        corpus[row.bucket] += row.corpus
        target[row.bucket] += row.trusted
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(corpus / corpus.sum())


def rate_quality(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
    buckets: int = BUCKETS,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept; columns of ``docs`` that have one of these names are replaced.

    ``trusted`` holds the doc_id of trusted documents. Rejected are documents with fewer than
    ``min_words`` words or over ``max_repeated_percent`` of words in repeated windows, and those
    with a score under ``threshold``. Defined cases: a null text has no words, all counts 0 and
    fails; a null id is rated like others but never trusted; repeated rows are rated each; an
    empty table, or no trusted document, gives scores of 0, which pass.
    """
    table = F.lit(log_ratios(docs, trusted, buckets, trusted_rows))
    # Columns that begin as the working columns below do are out of the way meanwhile.
    docs = docs.drop(*_RATINGS)
    aside = {c: f"in{n}" for n, c in enumerate(docs.columns) if c.startswith("_")}
    aside = {c: unused(docs, name) for c, name in aside.items()}
    kept = docs.withColumnsRenamed(aside)
    n_grams = F.size("_words") + F.greatest(F.size("_shapes") - 1, F.lit(0))
    single = F.aggregate(
        "_words", F.lit(0.0), lambda total, w: total + F.get(table, _bucket(buckets, w))
    )
    pairs = F.zip_with(
        _without_last(F.col("_shapes")),
        _without_first(F.col("_shapes")),
        lambda a, b: F.get(table, _bucket(buckets, a, b)),
    )
    both = F.aggregate(pairs, single, lambda total, x: total + x)
    rated = _base(_prepared(kept)).withColumn(
        "score", F.when(n_grams > 0, both / n_grams).otherwise(F.lit(0.0))
    )
    # A filter on ratings would be pushed below and take a copy of all they are made of along; it
    # isn't pushed below a generator (outer, as an inner one gets a filter of its own).
    made = F.explode_outer(F.array(F.struct(*_RATINGS[:6]))).alias("_made")
    rated = rated.select(*[f"`{c}`" for c in kept.columns], made)
    rated = rated.select(*[f"`{c}`" for c in kept.columns], "_made.*")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")
    )
    return (
        rated.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .withColumnsRenamed({name: c for c, name in aside.items()})
    )


def good_documents(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`rate_quality` keeps, unchanged, whatever their columns are called."""
    names = {c.lower() for c in _RATINGS}
    aside = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    rated = rate_quality(docs.withColumnsRenamed(aside), trusted, **options)
    return rated.filter("kept").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


_RATINGS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words score base_failed kept".split()
)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")
