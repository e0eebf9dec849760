"""Secret scans: three patterns, and a battery of randomness tests with length-aware false-discovery control.

Everything is built-in functions: patterns give the matches, splitting by the same pattern gives the text between
them, and running sums over both give positions in code points. Running values are folded in parts of about the
square root of an array's length, as a fold copies the array it builds at every step.

Long tokens that look like an encoding (hex, base32, base36, base64) are turned into symbol numbers and tested
against uniform random symbols: chi-squared over the alphabet, runs above and below the middle, and serial
correlation. The smallest of the three p-values, times three, is small for structured tokens and spread evenly
for random ones. Per stratum (encoding and length class) the even part above one half tells how many tokens are
random, and the cut is the smallest p-value above which the estimated share of structured tokens is at most ``q``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import id_and_text
from rillmeter.session import materialise

# The patterns of the three base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
SHORTEST_VALUE = 6

#: Tokens that may be random, and the alphabets they are read in (name, pattern, symbols). "=" is padding at the end of a
#: token and no letter of it, so a name and its value are tokens apart; a padded token or a value may be shorter.
_LETTER = "[A-Za-z0-9+/_-]"
CANDIDATE = f"{_LETTER}{{20,}}={{0,2}}|{_LETTER}{{14,19}}=+(?![A-Za-z0-9+/_=-])|(?<==){_LETTER}{{14,19}}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", _LOWER + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
)
LEAST_BITS = 80
BINS = 50


def with_running(df: DataFrame, name: str, items: str, zero: Column, value, combine, emit) -> DataFrame:
    """``df`` with an array column ``name``: for each element x of the array column ``items``, ``emit(before, x)``, where
    ``before`` combines ``value`` of all earlier elements, from ``zero`` on."""
    parts = f"{name} in parts"
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.slice(items, i * width + 1, width))
    df = df.withColumn(parts, F.when(n > 0, cut))

    def fold(array: Column, start: Column, of, put, kind: str) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(put(s["at"], x))).alias("out"))
        return F.aggregate(array, first, step, lambda s: s["out"])

    one = df.limit(0).select(F.transform(items, lambda x: emit(zero, x)).alias("a"), F.array(zero).alias("z")).schema
    totals = F.transform(parts, lambda part: F.aggregate(part, zero, lambda s, x: combine(s, value(x))))
    starts = fold(totals, zero, lambda t: t, lambda s, _: s, one["z"].dataType.simpleString())
    spread = F.zip_with(parts, starts, lambda part, start: fold(part, start, value, emit, one["a"].dataType.simpleString()))
    return df.withColumn(name, F.coalesce(F.flatten(spread), F.array().cast(one["a"].dataType.simpleString()))).drop(parts)


def with_places(df: DataFrame, name: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with the array column ``name`` (all matches of ``pattern``) turned into their start, end (code points, end
    exclusive) and value."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(name))
    df = df.withColumn(f"{name} and gaps", F.arrays_zip(F.col(name).alias("m"), between.alias("b")))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["b"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    placed = with_running(df, f"{name} placed", f"{name} and gaps", F.lit(0), lambda x: F.length(x["b"]) + F.length(x["m"]), lambda s, v: s + v, span)
    return placed.drop(name, f"{name} and gaps").withColumnRenamed(f"{name} placed", name)


def with_apart(df: DataFrame, name: str, spans: str, others: str) -> DataFrame:
    """``df`` with an array column ``name``: the start and end of those in ``spans`` that overlap none of ``others``."""

    def events(backwards: bool) -> Column:
        def event(s: Column, is_span: bool) -> Column:
            order = -s["start"] if backwards else s["start"]
            return F.struct(order.alias("order"), F.lit(int(is_span)).alias("is_span"), s["start"].alias("start"), s["end"].alias("end"))

        return F.array_sort(F.concat(F.transform(others, lambda s: event(s, False)), F.transform(f"{name} left", lambda s: event(s, True))))

    kept = lambda at, x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["is_span"].alias("is_span"), at.alias("at"))
    pair = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    df = df.withColumn(f"{name} left", F.transform(spans, pair)).withColumn(f"{name} events", events(False))
    # Forwards: no other begins at or before a span and reaches into it. Backwards: none begins inside it.
    reach = lambda x: F.when(x["is_span"] == 0, x["end"]).otherwise(-1)
    df = with_running(df, f"{name} met", f"{name} events", F.lit(-1), reach, F.greatest, kept)
    free = F.filter(f"{name} met", lambda x: (x["is_span"] == 1) & (x["at"] <= x["start"]))
    df = df.withColumn(f"{name} left", F.transform(free, pair)).withColumn(f"{name} events", events(True))
    far = F.lit((1 << 31) - 1)
    begins = lambda x: F.when(x["is_span"] == 0, x["start"]).otherwise(far)
    df = with_running(df, f"{name} met", f"{name} events", far, begins, F.least, kept)
    free = F.filter(f"{name} met", lambda x: (x["is_span"] == 1) & (x["end"] <= x["at"]))
    return df.withColumn(name, F.array_sort(F.transform(free, pair))).drop(*[f"{name} {x}" for x in ("left", "events", "met")])


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (a logistic approximation, good to 2e-4)."""
    z = F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _two_sided(z: Column) -> Column:
    return 2 * _tail(F.abs(z))


def _choose(pick) -> Column:
    """CASE over the encodings; null where a token is in none."""
    found = F.lit(None)
    for name, pattern, symbols in reversed(ENCODINGS):
        found = pick(name, pattern, symbols, found)
    return found


def randomness(tokens: Column) -> Column:
    """For spans of tokens: start, end, stratum and p, for those that are in an encoding and long enough.

    Letters of one case alone are words and not an encoding.
    """

    def read(t: Column) -> Column:
        value = F.translate(F.regexp_replace(t["value"], "^[=_+/-]+|[=_-]+$", ""), "-_", "+/")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), value.alias("value"))

    def infer(t: Column) -> Column:
        value = t["value"]
        name = F.when(value.rlike("^([a-z+/]+|[A-Z+/]+)$"), F.lit(None)).otherwise(
            _choose(lambda n, pattern, _, other: F.when(value.rlike(pattern), n).otherwise(other))
        )
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), value.alias("value"), name.alias("encoding"))

    def code(t: Column) -> Column:
        one_case = F.when(t["encoding"] == "base64", t["value"]).otherwise(F.lower(t["value"]))
        symbols = _choose(lambda n, _, s, other: F.when(t["encoding"] == n, s).otherwise(other))
        letters = F.filter(F.split(one_case, ""), lambda c: c != "")
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"),
            F.length(symbols).cast("double").alias("k"),
            F.transform(letters, lambda c: (F.instr(symbols, c) - 1).cast("double")).alias("codes"),
        )

    def measure(t: Column) -> Column:
        codes, k, n = t["codes"], t["k"], F.size(t["codes"]).cast("double")
        total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
        squares = total(
            F.transform(F.array_distinct(codes), lambda s: F.pow(F.size(F.filter(codes, lambda x: x == s)).cast("double"), F.lit(2.0)))
        )
        ahead, behind = F.slice(codes, 2, F.size(codes)), F.slice(codes, 1, F.size(codes) - 1)
        half, middle = k / 2, (k - 1) / 2
        changes = total(F.zip_with(behind, ahead, lambda x, y: ((x >= half) != (y >= half)).cast("double")))
        products = total(F.zip_with(behind, ahead, lambda x, y: (x - middle) * (y - middle)))
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), k.alias("k"), n.alias("n"),
            (squares * k / n - n).alias("chi"),
            F.size(F.filter(codes, lambda x: x >= half)).cast("double").alias("high"),
            (changes + 1).alias("runs"),
            (products / ((k * k - 1) / 12) / F.sqrt(n - 1)).alias("serial"),
        )

    def judge(t: Column) -> Column:
        n, free = t["n"], t["k"] - 1
        spread = 2 / (9 * free)
        chi = (F.cbrt(t["chi"] / free) - (1 - spread)) / F.sqrt(spread)
        mean = 2 * t["high"] * (n - t["high"]) / n
        variance = mean * (mean - 1) / (n - 1)
        runs = F.when(variance > 0, _two_sided((t["runs"] - mean - 1) / F.sqrt(variance))).otherwise(0.0)
        p = F.least(F.lit(1.0), 3 * F.least(_two_sided(chi), runs, _two_sided(t["serial"])))
        stratum = F.concat_ws(":", t["encoding"], F.floor(F.log2(n)).cast("string"))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), stratum.alias("stratum"), p.alias("p"))

    known = F.filter(F.transform(F.transform(tokens, read), infer), lambda t: t["encoding"].isNotNull())
    coded = F.filter(F.transform(known, code), lambda t: F.size(t["codes"]) * F.log2(t["k"]) >= LEAST_BITS)
    return F.transform(F.transform(coded, measure), judge)


def cuts(scanned: DataFrame, q: float) -> dict[str, float]:
    """Per stratum the least p-value of a token that is taken for random.

    Read from a histogram of at most (encodings x length classes x BINS) rows. Above one half nearly all tokens
    are random and evenly spread, so twice their number is the number of random ones.
    """
    p = scanned.select(F.explode("tokens").alias("t")).select(
        F.col("t.stratum").alias("stratum"), F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).alias("bin")
    )
    table: dict[str, list[int]] = {}
    for stratum, b, n in p.groupBy("stratum", "bin").count().collect():
        table.setdefault(stratum, [0] * BINS)[b] = n
    out = {}
    for stratum, counts in table.items():
        random = 2 * sum(counts[BINS // 2 :]) / BINS
        for b in range(BINS):
            taken = sum(counts[b:])
            if taken and 1 - random * (BINS - b) / taken <= q:
                out[stratum] = max(b / BINS, q)
                break
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """For every row of ``docs``: doc_id, found (array of start, rank, end, kind: all spans in order) and the counts
    n_assign, n_access, n_hex, n_random.

    ``rank`` is the kind's place in KINDS. Null and empty texts hold nothing. Random tokens that overlap a span of
    another kind are not added again. Repeated rows are scanned each on its own; a null doc_id is carried along.
    """
    matched = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("r", CANDIDATE))],
    )
    placed = matched
    for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("r", CANDIDATE)):
        placed = with_places(placed, name, pattern)
    long_enough = F.filter("a", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= SHORTEST_VALUE)
    placed = placed.withColumn("a", long_enough).drop("text")

    def ranked(name: str, rank: int) -> Column:
        return F.transform(
            F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"))
        )

    scanned = placed.select(
        "doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))],
        F.array_sort(F.concat(ranked("a", 0), ranked("k", 1), ranked("h", 2))).alias("base"),
        randomness(F.col("r")).alias("tokens"),
    )
    scanned = materialise(scanned, "scanned")
    cut = cuts(scanned, q)
    least = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]) if cut else F.create_map().cast("map<string,double>")
    likely = F.filter("tokens", lambda t: t["p"] >= F.element_at(least, t["stratum"]))
    scanned = with_apart(scanned.withColumn("likely", likely), "apart", "likely", "base")
    random = F.transform("apart", lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end"), F.lit(KINDS[3]).alias("kind")))
    return scanned.withColumn("random", random).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"), "base",
        F.array_sort(F.concat("base", "random")).alias("found"),
    )


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
