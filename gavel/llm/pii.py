"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

All of it is Spark SQL functions within a row. A kind's matches and the text between them come from
the same pattern, by ``regexp_extract_all`` and ``split``; their lengths add up to the places. The
patterns are the contract's, made safe for long texts: quantifiers that never need to give back are
possessive, so that nothing recurses, and a match may only start where one could be leftmost,
so that a long run of letters or digits isn't tried again from each of its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of context on either side of a match.
CONTEXT = 40
#: Added kinds need this score; base kinds are always reported.
MIN_SCORE = 0.6
#: Prefix sums are taken in blocks of so many lengths, to stay near linear.
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    quick: str  # a pattern that every text with a match has, and most texts don't
    prior: float
    checked: bool  # has a checksum
    context: str
    base: bool


# The patterns that texts are held against, in the order of the kinds.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@[A-Za-z0-9-]",
        0.9,
        False,
        r"mail|contact|write|reach",
        True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        0.6,
        False,
        r"\bip\b|address|host|server|login",
        True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?+[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){13}",
        0.4,
        True,
        r"card|visa|master|credit|debit|pay",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        0.6,
        False,
        r"phone|call|tel|mobile|fax",
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        0.4,
        True,
        r"iban|bank|account|transfer",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]{2}-[0-9]",
        0.4,
        False,
        r"\bssn\b|social|security|tax",
        False,
    ),
)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, as a lambda's argument is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("int"), lambda n, x: n + x)


def _upto(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _sums_before(lengths: Column) -> Column:
    """For every length the sum of those before it."""
    n_blocks = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    blocks = F.transform(_upto(n_blocks), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, _total)
        return _once(
            sums,
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda block, b: _once(
                        _total(F.slice(sums, F.lit(1), b)),
                        lambda start: F.transform(
                            block, lambda _, i: start + _total(F.slice(block, F.lit(1), i))
                        ),
                    ),
                )
            ),
        )

    return _once(blocks, joined)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits of a string have the checksum of payment cards."""

    def value(i: Column) -> Column:  # i-th digit from the right, from 1
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(
            F.when(doubled > 9, doubled - 9).otherwise(doubled)
        )

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda n, i: n + value(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        value = F.ascii(char)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise(
            (rest * 10 + value - 48) % 97
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(match, "[.]"),
            lambda part: _once(
                F.regexp_replace(part, "^0+(?=[0-9])", ""),
                lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)),
            ),
        )
    if kind == "card":
        return _once(
            _digits(match),
            lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)),
        )
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


_NO_SPANS = (
    "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double,base:boolean>>"
)


def _spans(text: Column, rank: int, kind: Kind, context: int) -> Column:
    parts = F.struct(
        F.split(text, kind.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"),
    )

    def found(s: Column) -> Column:
        between, matches = s["between"], s["matches"]
        lengths = F.transform(
            matches, lambda m, i: F.length(F.get(between, i)) + F.length(m)
        )

        def span(before: Column, i: Column) -> Column:
            match = F.get(matches, i)
            start = before + F.length(F.get(between, i))
            near = F.concat_ws(
                " ",
                F.right(F.get(between, i), F.lit(context)),
                F.left(F.get(between, i + 1), F.lit(context)),
            )
            bonus = F.when(F.lower(near).rlike(kind.context), F.lit(0.2)).otherwise(F.lit(0.0))
            score = F.lit(kind.prior + (0.4 if kind.checked else 0.0)) + bonus
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(match)).alias("end"),
                F.lit(kind.name).alias("kind"),
                match.alias("text"),
                F.least(score, F.lit(1.0)).alias("score"),
                F.lit(kind.base).alias("base"),
            )

        spans = F.transform(_sums_before(lengths), span)
        confirmed = F.filter(spans, lambda x: _valid(kind.name, x["text"]))
        if kind.base:
            return confirmed
        return F.filter(confirmed, lambda x: x["score"] >= MIN_SCORE - 1e-9)

    return F.when(text.rlike(kind.quick), _once(parts, found)).otherwise(
        F.array().cast(_NO_SPANS)
    )


def find_personal_data(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id and spans: array of (start, rank, end, kind, text, score, base), by start and kind.

    Places count code points, the end is exclusive. E-mail addresses, IP addresses, payment cards
    (Luhn) and phone numbers are base kinds and always reported. Bank accounts (mod-97) and
    social security numbers are added when their score reaches ``MIN_SCORE``: a prior, more for a
    checksum, more for a word of their context within ``context`` code points. Matches of one kind
    don't overlap; those of different kinds may. Defined cases: a null text has no spans; null ids
    and repeated rows are searched like others; an empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(*[_spans(text, rank, kind, context) for rank, kind in enumerate(KINDS)])
    return docs.select("doc_id", F.array_sort(spans).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
