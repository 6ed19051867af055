"""Secret scans with a battery of randomness tests, DataFrame operations only.

Three fixed patterns give base spans (kinds assign, access, hex).  Beyond them every token of ``LEAST``
or more token characters that no base span touches is a candidate (kind random).  Its encoding is
inferred from the characters it uses: hex, base32, base36 or base64.  The battery asks how surely a
candidate is random, against the hypothesis that it departs from randomness as natural tokens do:

* chi-squared uniformity over the alphabet: natural characters repeat, so the statistic is noncentral
  with ``n * (K * REPEATS - 1)``; the lower tail is taken by the normal law of the same mean and
  variance, which is too large as the true law leans to the right;
* runs: natural tokens change character class (small, capital, digit, mark) at ``SWITCH`` of their
  neighbour pairs at most; the chance of as many runs is bounded by Chernoff;
* serial correlation: of at least ``CORRELATION`` at lag 1 either way, by Fisher's transformation.

All three have to reject, so a candidate's p-value is the largest one, whatever the dependence between
the tests.  Each falls with the length of the candidate: a short token has to look the more random.
Benjamini-Hochberg at ``FDR`` over all candidates of the document decides.

Positions count code points, the end is exclusive.  NULL and empty texts have no spans, repeated rows
get equal spans, an empty table gives no rows.  All steps are projections of one row: no shuffle, and a
very long text is scanned whole, with work that grows as the power 1.5 of its matches at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, with the least length of the match (or of group 2).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

LEAST = 12
#: Stands for characters of base spans when candidates are looked for; longer tokens that hold it touch one.
MASK, OTHER = "\x01", "\x02"
CANDIDATE = r"(?<![A-Za-z0-9+/_=\x01-])[A-Za-z0-9+/_=\x01-]{12,}"
#: Needed for two changes of class, without which no candidate passes the runs test.
CHANGES = r"[a-z0-9][+/_=-]*[A-Z]|[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[a-z]"
LIKELY = rf"(?=[A-Za-z0-9+/_=-]{{12}})[A-Za-z0-9+/_=-]*?(?:{CHANGES})"
#: Chance that two characters of a natural token are equal, by alphabet; changes of class for each pair of
#: neighbours in one case and in mixed case; lag-1 correlation of what is not random.
REPEATS, HEX_REPEATS = 0.066, 0.1
SWITCH, MIXED_SWITCH, CORRELATION = 0.1, 0.25, 0.8
FDR = 0.01
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks_of(items: Column) -> Column:
    """An array cut in blocks of about the square root of its size."""

    def dealt(x: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(x))
        return let(F.ceil(F.sqrt(n)).cast("int"), lambda m: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / m).cast("int")), lambda b: F.slice(x, b * m + 1, m)))

    return let(items, dealt)


def before_each(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each block of ``items`` what the fold was before it: one integer for each block."""
    start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, block: F.struct(F.aggregate(block, s["at"], add).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(items, start, step, lambda s: s["out"])


def pieces(text: Column, pattern: str, group: int | None = None) -> Column:
    """``gap, found, inner`` of the leftmost non-overlapping matches, and the rest of the text as a last gap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), inner.alias("inner"))


def located(cut: Column, kind: int) -> Column:
    """``start, kind, end, inner`` of the matches of ``pieces``, by sums of lengths in two levels."""
    # lengths of strings are taken once
    sized = F.transform(cut, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["found"]), F.lit(0)).alias("size"), p["inner"].alias("inner")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,inner:string>>")

    def walk(block: Column, head: Column) -> Column:
        def step(s, p):
            at = s["at"] + p["gap"]
            one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + p["size"]).alias("end"), p["inner"].alias("inner"))
            return F.struct((at + p["size"]).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(head.alias("at"), none.alias("out")), step, lambda s: s["out"])

    blocks = lambda b: F.flatten(F.zip_with(b, before_each(b, F.lit(0), lambda s, p: s + p["gap"] + p["size"]), walk))
    return F.filter(let(blocks_of(sized), blocks), lambda s: s["inner"].isNotNull())


def masked(cut: Column, keep: Callable[[Column], Column]) -> Column:
    """The text of ``pieces`` with the matches that ``keep`` admits covered by masks of equal length."""
    return F.array_join(F.transform(cut, lambda p: F.concat(p["gap"], F.when(p["found"].isNull(), "").when(keep(p), F.repeat(F.lit(MASK), F.length(p["found"]))).otherwise(p["found"]))), "")


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def when_found(text: Column, pattern: str, spans: Column, kind: str = SPAN) -> Column:
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


#: Pattern, what is asked first, group that ``keep`` looks at, and what is kept, of each base kind.
BASE = [
    (ASSIGN, ASSIGN, 2, lambda inner: F.length(inner) >= ASSIGN_LEAST),
    (ACCESS, r"AKIA[A-Z0-9]{14}", None, lambda inner: F.length(inner) >= ACCESS_LEAST),
    (HEX, HEX, None, lambda inner: F.lit(True)),
]


def base_spans(text: Column) -> Column:
    def of(kind: int, pattern: str, first: str, group: int | None, keep) -> Column:
        spans = let(pieces(text, pattern, group), lambda cut: plain(F.filter(located(cut, kind), lambda s: keep(s["inner"]))))
        return when_found(text, first, spans)

    return F.array_sort(F.concat(*[of(kind, *x) for kind, x in enumerate(BASE)]))


def without_base(text: Column) -> Column:
    """The text with all characters of base spans masked."""

    def of(out: Column, pattern: str, first: str, group: int | None, keep) -> Column:
        covered = lambda t: let(pieces(t, pattern, group), lambda cut: masked(cut, lambda p: keep(p["inner"])))
        return let(out, lambda t: F.when(t.rlike(first), covered(t)).otherwise(t))

    out = F.translate(text, MASK, OTHER)
    for x in BASE:
        out = of(out, *x)
    return out


def upper_tail(z: Column) -> Column:
    """P(N > z) by a rational approximation of absolute error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def inferred(s: Column) -> Column:
    """Size of the alphabet of a token's encoding."""
    return F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(s.rlike("^[A-Z2-7]+=*$"), 32).when(s.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).otherwise(64).cast("double")


def kind_of(code: Column) -> Column:
    return F.when((code >= 97) & (code <= 122), 0).when((code >= 65) & (code <= 90), 1).when((code >= 48) & (code <= 57), 2).otherwise(3)


def neighbours(items: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of every item and the next one."""
    return F.zip_with(F.slice(items, F.lit(1), F.size(items) - 1), F.slice(items, F.lit(2), F.size(items) - 1), pair)


def battery(s: Column) -> Column:
    """``chi, runs, serial``: for each test the chance that a token at the margin of what is natural looks as random."""

    def statistics(codes: Column) -> Column:
        counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
        classes = F.transform(codes, kind_of)
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / F.size(codes)
        dev = F.transform(codes, lambda c: c - mean)
        r = let(dev, lambda d: F.aggregate(neighbours(d, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1e-9), F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)))
        return F.struct(
            F.size(codes).cast("double").alias("n"), inferred(s).alias("k"),
            F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            F.size(F.filter(neighbours(classes, lambda a, b: a != b), lambda x: x)).cast("double").alias("moves"),
            F.least(F.lit(0.999), F.abs(r)).alias("r"),
        )

    def values(x: Column) -> Column:
        n, k = x["n"], x["k"]
        df, far = k - 1.0, n * (k * F.when(k == 16, HEX_REPEATS).otherwise(REPEATS) - 1.0)
        chi = upper_tail((df + far - (x["squares"] * k / n - n)) / F.sqrt(2.0 * (df + 2.0 * far)))
        rate = F.when(k == 64, MIXED_SWITCH).otherwise(SWITCH)
        f = F.least(F.lit(1.0 - 1e-9), F.greatest(x["moves"] / (n - 1.0), F.lit(1e-9)))
        runs = F.when(f <= rate, F.lit(1.0)).otherwise(F.exp(-(n - 1.0) * (f * F.ln(f / rate) + (1.0 - f) * F.ln((1.0 - f) / (1.0 - rate)))))
        serial = upper_tail((F.atanh(F.lit(CORRELATION)) - F.atanh(x["r"])) * F.sqrt(n - 3.0))
        return F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))

    return let(let(F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("double")), statistics), values)


def p_value(s: Column) -> Column:
    """All tests have to reject: the largest of their p-values; 1 for tokens of one class."""
    return F.when(s.rlike(CHANGES), let(battery(s), lambda b: F.greatest(b["chi"], b["runs"], b["serial"]))).otherwise(F.lit(1.0))


def random_spans(text: Column) -> Column:
    """Candidates that Benjamini-Hochberg keeps among all of the text."""

    def decided(tested: Column) -> Column:
        m = F.size(tested).cast("double")
        passing = F.transform(tested, lambda s, i: F.when(s["p"] <= FDR * (i + 1).cast("double") / m, s["p"]))
        least = F.array_max(F.filter(passing, lambda p: p.isNotNull()))
        return let(F.coalesce(least, F.lit(-1.0)), lambda most: F.transform(F.filter(tested, lambda s: s["p"] <= most), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))))

    tokens = let(pieces(without_base(text), CANDIDATE), lambda cut: F.filter(located(cut, 3), lambda s: ~F.contains(s["inner"], F.lit(MASK))))
    tested = F.transform(tokens, lambda s: F.struct(p_value(s["inner"]).alias("p"), s["start"].alias("start"), s["end"].alias("end")))
    return let(F.array_sort(tested), decided)


def scan(df: DataFrame, column: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, kind, end), kinds as in ``KINDS``, sorted by start and kind.
    Columns that have these two names already are replaced; others pass."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    found = df.withColumn(base, base_spans(text))
    return found.withColumn(spans, F.array_sort(F.concat(F.col(f"`{base}`"), when_found(text, LIKELY, random_spans(text)))))


def redact(df: DataFrame, mark: str = "[SECRET]", column: str = "text", spans: str = "spans") -> DataFrame:
    """Replace the text of all spans of a scanned frame; overlapping spans are replaced once.

    The text is cut at blocks of spans first and inside the blocks next."""
    text, listed = F.col(f"`{column}`"), F.col(f"`{spans}`")
    most = lambda s, x: F.greatest(s, x["end"])

    def inside(block: Column, head: Column) -> Column:
        own = F.substr(text, head + 1, F.aggregate(block, head, most) - head)
        none = F.struct(head.alias("at"), F.array().cast("array<string>").alias("out"))

        def walk(part: Column) -> Column:
            def step(s, x):
                kept = F.concat(F.substr(part, s["at"] - head + 1, F.greatest(F.lit(0), x["start"] - s["at"])), F.lit(mark))
                return F.struct(most(s["at"], x).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(kept))).alias("out"))

            return F.aggregate(block, none, step, lambda s: F.array_join(s["out"], ""))

        return let(own, walk)

    made = let(blocks_of(listed), lambda b: F.array_join(F.zip_with(b, before_each(b, F.lit(0), most), inside), ""))
    clean = F.concat(made, F.substr(text, F.aggregate(listed, F.lit(0), most) + 1, F.length(text)))
    return df.withColumn(column, F.when(F.size(listed) > 0, clean).otherwise(text))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def documents_query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
