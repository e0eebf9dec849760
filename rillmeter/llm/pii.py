"""Personal data: four checked patterns, and bootstrapped extraction by the contexts they stand in.

A scan finds the base spans (addresses of mail and machines, cards, phones) and, besides, everything that looks like an
identifier: long numbers, words with digits, words with an at sign. Each occurrence yields lexical patterns: the one,
two and three words before it, and the word before with the word after it.

Patterns and instances (distinct values) form a bipartite graph, stored as edges. Base values are seeds and believed.
A round scores every pattern and kind by the believed share of the distinct values it stands by, and every other value
by the patterns it stands by (noisy or); values that are believed now support patterns in the next round. A value
stands for one instance however often it is copied, so repeated texts make no pattern. What has the form of a kind but
fails its check (a card number with a wrong digit) counts against the patterns and is never found. Every other value a
trusted pattern leads to is added wherever it occurs, if it could be of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import id_and_text
from rillmeter.session import materialise

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"more_{kind}" for kind in KINDS)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: the same matches as the plain patterns, in time linear in the text.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile("[0-9@]++")
_NUMBER = re.compile(r"[0-9]++(?:[().\x20/-]{1,2}[0-9]++)*+(?![A-Za-z0-9@_])")
_JOINED = frozenset(_LOCAL + "@:/")
_RUN = re.compile("[A-Za-z0-9._%+@:/-]++")
_IPV6 = re.compile("(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}")
_CUE = re.compile("[^\\W\\d_]+|[0-9]+|[:#=@]")
#: Code points before and after a value in which its context is read.
REACH = 96
#: Least number of distinct believed values of a kind that a pattern stands by, least share of them, weight of the
#: doubt (distinct values added to the denominator), least belief of a value, and most rounds.
SUPPORT, CONFIDENCE, DOUBT, TRUST, ROUNDS = 5, 0.7, 1.0, 0.7, 5

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """From at sign to at sign: the local part is the run of its letters before one."""
    out, begin = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[begin:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if local else None
        if found:
            out.append((at - local, found.end()))
        begin = found.end() if found else at + 1
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> tuple[list[list[Span]], list[Span]]:
    """Spans of each of KINDS, and spans that have the form of a kind and fail its check."""
    ips, cards, phones, failed = [], [], [], []
    for found in _DOTTED.finditer(text):
        parts, at = found.group().split("."), found.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            right = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            (ips if right else failed).append((at, end))
            at = end + 1
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _digits(found.group())
            if 14 <= len(digits) <= 19:
                (cards if luhn(digits) else failed).append(found.span())
    for found in _PHONE.finditer(text):
        (phones if 10 <= len(_digits(found.group())) <= 15 else failed).append(found.span())
    return [emails(text), ips, cards, phones], failed


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Spans that look like identifiers and overlap none of ``taken`` (sorted, apart)."""
    out, end, k = [], 0, 0
    for hint in _HINT.finditer(text):
        at = hint.start()
        if at < end:
            continue
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        if k < len(taken) and taken[k][0] <= at:
            end = taken[k][1]
            continue
        start = at
        while start > end and text[start - 1] in _JOINED:
            start -= 1
        number = _NUMBER.match(text, at) if not any("A" <= c <= "z" for c in text[start:at]) else None
        if number and len(_digits(number.group())) >= 7:
            start, end = at, number.end()
        else:
            end = _RUN.match(text, at).end()
        shown = text[start:end].strip("._%+:/-")
        start = text.index(shown, start) if shown else start
        span = (start, start + len(shown))
        if (sum("0" <= c <= "9" for c in shown) >= 4 or "@" in shown.strip("@")) and not (k < len(taken) and taken[k][0] < span[1]):
            if not (k and taken[k - 1][1] > span[0]):
                out.append(span)
    return out


def forms(value: str) -> list[str]:
    """Kinds that an identifier could be of."""
    low, digits = value.lower(), _digits(value)
    plain = not any(c.isalpha() for c in value) and "@" not in value
    could = (
        "@" in value, bool(_IPV6.fullmatch(low)) and len(digits) < len(low),
        plain and 12 <= len(digits) <= 19 and luhn(digits), plain and ":" not in value and 7 <= len(digits) <= 15,
    )
    return [kind for kind, yes in zip(KINDS, could) if yes]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Contexts of a value: one, two, three words before it, and the word before with the word after."""
    left = [_sign(c) for c in _CUE.findall(text[max(0, start - REACH) : start].lower())[-3:]]
    found = _CUE.search(text, end, end + REACH)
    right = _sign(found.group().lower()) if found else ""
    out = [" ".join(left[-n:]) + " _" for n in range(1, len(left) + 1)]
    if left and right:
        out.append(f"{left[-1]} _ {right}")
    return [p for p in out if any(c.isalpha() for c in p)]


def _sign(cue: str) -> str:
    return "0" if "0" <= cue[0] <= "9" else cue


def value_of(text: str) -> str:
    """One spelling for a value: letters and digits in lower case, and the at sign."""
    return "".join(c for c in text.lower() if c.isalnum() or c == "@")


def _apart(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans in order, and every occurrence of a value with its contexts, seed kind and possible kinds."""
    base, failed = base_spans(text)
    spans = sorted((a, rank, b) for rank, some in enumerate(base) for a, b in some)
    found = [{"start": a, "rank": r, "end": b, "kind": KINDS[r]} for a, r, b in spans]
    seen = [(a, b, KINDS[r], []) for a, r, b in spans] + [(a, b, None, []) for a, b in failed]
    for a, b in candidates(text, _apart([(a, b) for a, _, b in spans] + failed)):
        seen.append((a, b, None, forms(text[a:b])))
    return found, [
        {"start": a, "end": b, "value": value_of(text[a:b]), "kind": kind, "forms": could, "patterns": patterns(text, a, b)}
        for a, b, kind, could in seen
    ]


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_SEEN = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("kind", pa.string()),
               ("forms", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))])
)
SCANNED = (
    "doc_id long, base array<struct<start:int,rank:int,end:int,kind:string>>, "
    "seen array<struct<start:int,end:int,value:string,kind:string,forms:array<string>,patterns:array<string>>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            base, seen = zip(*(scan(text) for text in part["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(base, _BASE), pa.array(seen, _SEEN)], names=["doc_id", "base", "seen"])


def _noisy_or(confidence: str) -> Column:
    return 1 - F.exp(F.sum(F.log1p(-F.least(F.col(confidence), F.lit(1 - 1e-9)))))


def learn(
    scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, doubt: float = DOUBT, trust: float = TRUST, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, confidence, n) and believed values beyond the seeds (value, kind, belief).

    Tables of the graph stay in the shared folder; the driver sees one count a round.
    """
    met = scanned.select(F.explode("seen").alias("s")).select("s.value", "s.kind", "s.forms", F.explode("s.patterns").alias("pattern"))
    edges = materialise(met.groupBy("pattern", "value", "kind", "forms").agg(F.lit(1).alias("one")).drop("one"), "edges")
    total = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n"))
    totals = materialise(total, "totals")
    seeds = materialise(seeds, "seed-support")
    open_edges = edges.where("kind IS NULL AND size(forms) > 0")
    believed = edges.select("value", F.lit("").alias("kind"), F.lit(0.0).alias("belief")).limit(0)
    known = -1
    for _ in range(rounds):
        more = open_edges.select("pattern", "value").distinct().join(believed.hint("merge"), "value").groupBy("pattern", "kind").agg(
            F.sum("belief").alias("weight"), F.count(F.lit(1)).alias("n")
        )
        both = seeds.select("pattern", "kind", F.col("n").cast("double").alias("weight"), "n").union(more.select("pattern", "kind", "weight", "n"))
        scored = both.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).where(F.col("n") >= support)
        good = scored.join(totals.hint("merge"), "pattern").select("pattern", "kind", (F.col("weight") / (F.col("total") + doubt)).alias("confidence"), "n")
        good = materialise(good.where(F.col("confidence") >= confidence), "patterns")
        leads = open_edges.drop("kind").join(good.hint("merge"), "pattern").where(F.array_contains("forms", F.col("kind")))
        led = leads.select("value", "kind", "pattern", "confidence").distinct().groupBy("value", "kind").agg(_noisy_or("confidence").alias("belief"))
        best = led.groupBy("value").agg(F.max_by(F.struct("kind", "belief"), F.struct("belief", "kind")).alias("b")).select("value", "b.kind", "b.belief")
        believed = materialise(best.where(F.col("belief") >= trust), "believed")
        now = believed.count()
        if now == known:
            break
        known = now
    return good, believed


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """For every row of ``docs``: doc_id, found (array of start, rank, end, kind: all spans in order), base (those of the
    four patterns) and n_email, n_ip, n_card, n_phone (base spans) and n_more (added ones).

    ``learning`` goes to ``learn``. Added kinds are named more_ and the kind their contexts belong to, ranked after the
    base kinds. Null and empty texts hold nothing; repeated rows are scanned each on its own and count once as context; a null doc_id is
    carried along.
    """
    found = id_and_text(docs, id_col, text_col).mapInArrow(_scan, SCANNED)
    scanned = materialise(found.withColumn("row", F.monotonically_increasing_id()), "scanned")
    _, believed = learn(scanned, **learning)
    occurring = scanned.select("row", F.explode("seen").alias("s")).where("s.kind IS NULL AND size(s.forms) > 0").select(
        "row", "s.start", "s.end", "s.value", "s.forms"
    )
    met = occurring.join(believed.hint("merge"), "value").where(F.array_contains("forms", F.col("kind")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") + len(KINDS) - 1
    span = F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("more_"), "kind").alias("kind"))
    more = materialise(met.groupBy("row").agg(F.collect_list(span).alias("more")), "more-spans")  # spans of one text
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return scanned.select("row", "doc_id", "base").join(more.hint("merge"), "row", "left").select(
        "doc_id", *[of(kind) for kind in KINDS], F.size(F.coalesce("more", none)).cast("long").alias("n_more"), "base",
        F.array_sort(F.concat("base", F.coalesce("more", none))).alias("found"),
    )
