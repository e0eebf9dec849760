"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored by context.

The lexicon (words, and stems that stand for all words they begin) is learned from a bounded sample of labelled
rows: terms far more frequent in toxic than in clean texts, near copies counted once. Its trie is intersected with
the Levenshtein automata of its entries (a swap of neighbours is one edit) and made deterministic; the table of the
product automaton is broadcast and run over all words of a batch at once, one character a step; most words drop out
after two or three. A lexicon too large for one table is dealt over several. A word at a distance from an entry that
is itself common in clean texts is no misspelling of it.

Each match has its own evidence (the log odds of its entry at that edit distance) and counts as quoted when it
stands between quotation marks or next to a reporting verb. A logistic regression over direct, misspelled and
quoted evidence, density and length gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmeter.llm.common import col, id_and_text
from rillmeter.llm.tokens import slices
from rillmeter.llm.wordhash import mix
from rillmeter.session import materialise

#: Most labelled rows of each class the model is fitted on (those with the smallest hash of their doc_id).
MAX_TOXIC, MAX_CLEAN = 6_000, 10_000
#: Terms a task counts in Python before it hands them on to be summed.
HELD_TERMS = 100_000
#: Most states of one product automaton; a lexicon that needs more has several.
MAX_STATES = 20_000
FOLDS = 5
SHORTEST, LONGEST_STEM = 4, 9
LEAST_TEXTS, LEAST_ODDS = 5, 2.0
#: Least log likelihood ratio of an entry against an equal spread over both classes (about one in ten million by chance).
LEAST_RATIO = 14.0
#: A text is a near copy of an earlier one if at least AGREE of SKETCH minima over its words are equal.
SKETCH, BAND, AGREE = 64, 4, 52
#: A misspelling in so many clean texts, with log odds below this, is a word of its own.
COMMON_TEXTS, COMMON_ODDS = 3, 1.0
#: Words to each side of a match that are looked at for a reporting verb.
CONTEXT = 4

# Quotation marks, and reporting verbs in four languages.
QUOTES = "\"'“”„«»‘’‹›"
REPORTING = frozenset(
    "said says called wrote quoted quote word term insult sagte nannte schrieb zitat wort dit appelé écrit cite mot dijo llamó escribió cita palabra".split()
)
_SYMBOLS = frozenset("@$*!|+€")


def allowed_errors(length: int, stem: bool) -> int:
    """Edits accepted for an entry: one from four letters (five for stems), two for words of ten and more."""
    return int(length >= 5) if stem else 0 if length < 4 else 1 if length < 10 else 2


@dataclass
class Automaton:
    """Product of a lexicon trie and the Levenshtein automata of its entries, as a transition table.

    State 0 is dead, state 1 the start. ``entry`` and ``errors`` tell what a state accepts (-1: nothing).
    """

    classes: np.ndarray
    moves: np.ndarray
    entry: np.ndarray
    errors: np.ndarray


class TooManyStates(ValueError):
    pass


#: What a state of the automaton is at: a trie node; the end of a stem, reached by an edit; a node one letter after
#: the first of two swapped ones; a stem already read.
_AT, _LOOSE, _SWAP, _STEM = range(4)


def compile_lexicon(entries: list[tuple[str, bool]], max_states: int = MAX_STATES, edits: int = 2) -> Automaton:
    """``entries``: (lower-case letters, is it a stem). Raises TooManyStates if the table would pass ``max_states``.

    A stem's last letter must be read as it is or swapped with the one before: an edit there would let any word that
    shares the letters before it pass.
    """
    letters = sorted({c for word, _ in entries for c in word})
    classes = np.zeros(1 << 16, np.int32)
    for i, c in enumerate(letters):
        if ord(c) < 1 << 16:
            classes[ord(c)] = i + 1
    children: list[dict[str, int]] = [{}]
    room, ends, awaited = [0], [[]], [""]
    for number, (word, stem) in enumerate(entries):
        node, errors, before = 0, min(edits, allowed_errors(len(word), stem)), ""
        room[0] = max(room[0], errors)
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                room.append(0)
                ends.append([])
                awaited.append(before)
            node, before = children[node][c], c
            room[node] = max(room[node], errors)
        ends[node].append((number, errors, stem))

    def edited(node: int) -> tuple[int, int]:
        return (_LOOSE if any(stem for *_, stem in ends[node]) else _AT), node

    def close(states: dict[tuple[int, int], int]) -> tuple:
        """With skipped lexicon letters; per place only the fewest errors."""
        todo = deque((place, e) for place, e in states.items() if place[0] in (_AT, _LOOSE))
        while todo:
            place, e = todo.popleft()
            if states[place] < e:
                continue
            for child in children[place[1]].values():
                to = edited(child)
                if e + 1 <= room[child] and states.get(to, 99) > e + 1:
                    states[to] = e + 1
                    todo.append((to, e + 1))
        return tuple(sorted(states.items()))

    def accepted(state: tuple) -> tuple[int, int]:
        best = (99, -1)
        for (kind, node), e in state:
            if kind == _STEM:
                best = min(best, (e, node))
            elif kind != _SWAP:
                best = min([best, *((e, n) for n, most, stem in ends[node] if e <= most and (kind == _AT or not stem))])
        return (-1, 0) if best[1] < 0 else (best[1], best[0])

    def step(state: tuple, c: str | None) -> tuple:
        found: dict[tuple[int, int], int] = {}

        def put(place: tuple[int, int], e: int) -> None:
            if found.get(place, 99) > e:
                found[place] = e

        for (kind, node), e in state:
            if kind == _STEM:
                put((kind, node), e)
                continue
            if kind == _SWAP:
                if c == awaited[node]:
                    put((_AT, node), e)
                continue
            if kind == _AT:
                for n, most, stem in ends[node]:
                    if stem and e <= most:
                        put((_STEM, n), e)
            if e + 1 <= room[node]:
                put(edited(node), e + 1)
            for letter, child in children[node].items():
                if letter == c:
                    if e <= room[child]:
                        put((_AT, child), e)
                    continue
                if e + 1 <= room[child]:
                    put(edited(child), e + 1)
                after = children[child].get(c)
                if after is not None and e + 1 <= room[after]:
                    put((_SWAP, after), e + 1)
        return close(found)

    start = close({(_AT, 0): 0})
    numbers, order, rows = {(): 0, start: 1}, [(), start], []
    place = {c: k + 1 for k, c in enumerate(letters)}
    i = 0
    while i < len(order):
        row = np.zeros(len(letters) + 1, np.int32)
        if order[i]:
            # Only letters the trie has hereabouts lead elsewhere than all others.
            near = {awaited[node] for (kind, node), _ in order[i] if kind == _SWAP}
            for (kind, node), _ in order[i]:
                if kind in (_AT, _LOOSE):
                    near.update(children[node])
                    for child in children[node].values():
                        near.update(children[child])
            for c in [None, *sorted(near)]:
                to = step(order[i], c)
                if to not in numbers:
                    if len(order) >= max_states:
                        raise TooManyStates(f"the lexicon needs more than {max_states} states")
                    numbers[to] = len(order)
                    order.append(to)
                if c is None:
                    row[:] = numbers[to]
                else:
                    row[place[c]] = numbers[to]
        rows.append(row)
        i += 1
    taken = [accepted(s) for s in order]
    return Automaton(classes, np.array(rows), np.array([a for a, _ in taken]), np.array([e for _, e in taken]))


def compile_shards(entries: list[tuple[str, bool]], max_states: int = MAX_STATES, first: int = 0) -> list[Automaton]:
    """As many automata as it takes for all entries, numbered through. An entry that alone passes ``max_states`` (a
    word of hundreds of letters) is looked for without edits."""
    if not entries:
        return []
    try:
        built = compile_lexicon(entries, max_states)
    except TooManyStates:
        half = len(entries) // 2
        if half:
            return compile_shards(entries[:half], max_states, first) + compile_shards(entries[half:], max_states, first + half)
        built = compile_lexicon(entries, len(entries[0][0]) + 3, edits=0)
    built.entry = np.where(built.entry >= 0, built.entry + first, -1)
    return [built]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    alnum = np.array([chr(i).isalnum() for i in range(1 << 16)])
    return alnum, np.array([chr(i) in _SYMBOLS for i in range(1 << 16)])


_ALNUM, _SYMBOL = _letters()


def find_words(texts: list[str], automata: list[Automaton]) -> tuple[np.ndarray, ...]:
    """Matches in lower-cased texts: text number, first and end character in it, entry, errors; and words per text.

    A word has one match, that with the fewest errors. A word is a run of letters and digits; a symbol between two of them belongs to it ("tr@sh").
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, (1 << 16) - 1).astype(np.uint16)
    alnum = _ALNUM[points]
    word = alnum.copy()
    word[1:-1] |= _SYMBOL[points[1:-1]] & alnum[:-2] & alnum[2:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.searchsorted(begin, starts, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    hits = [(np.zeros(0, np.int64),) * 3]
    for automaton in automata:
        live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        while len(live):
            state = automaton.moves[state, automaton.classes[points[at]]]
            at = at + 1
            done = at == ends[live]
            found = done & (automaton.entry[state] >= 0)
            hits.append((live[found], automaton.entry[state[found]], automaton.errors[state[found]]))
            on = ~done & (state > 0)
            live, state, at = live[on], state[on], at[on]
    which, entry, errors = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((entry, errors, which))
    which, entry, errors = which[order], entry[order], errors[order]
    best = np.concatenate([[True], which[1:] != which[:-1]])[: len(which)]
    which, entry, errors = which[best], entry[best], errors[best]
    return owner[which], starts[which] - begin[owner[which]], ends[which] - begin[owner[which]], entry, errors, words


def is_quoted(text: str, start: int, end: int) -> bool:
    """A match between quotation marks within a short window, or next to a reporting verb."""
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    if left[-1:] and left[-1] in QUOTES and right[:1] and right[0] in QUOTES:
        return True
    opened, closed = (re.split(r"[.!?\n]", x)[i] for x, i in ((left, -1), (right, 0)))
    marks = [c for c in opened if c in QUOTES and c != "'"]
    if len(marks) % 2 and any(c in QUOTES and c != "'" for c in closed):
        return True
    near = re.findall(r"[^\W\d_]+", left)[-CONTEXT:] + re.findall(r"[^\W\d_]+", right)[:CONTEXT]
    return any(w in REPORTING for w in near)


def _lowered(texts: list[str]) -> list[str]:
    """In lower case, with as many characters as before."""
    lowered = [t.lower() for t in texts]
    return [low if len(low) == len(t) else "".join(c.lower()[:1] for c in t) for low, t in zip(lowered, texts)]


@dataclass
class Model:
    """What scoring needs: the automata, words that are no misspellings, evidence by entry and distance, the regression."""

    automata: list[Automaton] = field(default_factory=list)
    common: frozenset[str] = frozenset()
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    bias: float = 0.0

    def hits(self, texts: list[str]) -> tuple[list[list[tuple[int, int, bool, int, int]]], np.ndarray]:
        """Per text its matches (entry, errors, quoted, start, end), and its number of words."""
        out: list[list[tuple[int, int, bool, int, int]]] = [[] for _ in texts]
        if not self.automata:
            return out, np.array([len(t.split()) for t in texts])
        lowered = _lowered(texts)
        owner, start, end, entry, errors, words = find_words(lowered, self.automata)
        if len(self.evidence):  # once fitted, matches that tell nothing are left out
            telling = self.evidence[entry, errors] > 0
            owner, start, end, entry, errors = (x[telling] for x in (owner, start, end, entry, errors))
        for k, a, b, n, e in zip(owner.tolist(), start.tolist(), end.tolist(), entry.tolist(), errors.tolist()):
            if not e or lowered[k][a:b] not in self.common:
                out[k].append((n, e, is_quoted(lowered[k], a, b), a, b))
        return out, words

    def features(self, hits: list[list], words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hits), 6))
        for i, found in enumerate(hits):
            if found:
                value = [self.evidence[n, e] for n, e, *_ in found]
                direct = sum(v for v, h in zip(value, found) if not h[2] and not h[1])
                spelt = sum(v for v, h in zip(value, found) if not h[2] and h[1])
                quoted = sum(v for v, h in zip(value, found) if h[2])
                kinds = len({h[0] for h, v in zip(found, value) if v > 0 and not h[2]})
                out[i, :5] = np.log1p(direct), np.log1p(spelt), np.log1p(quoted), 100 * (direct + spelt) / max(1, words[i]), kinds
            out[i, 5] = np.log1p(words[i])
        out[:, 3] = np.log1p(out[:, 3])
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list]]:
        hits, words = self.hits(texts)
        z = (self.features(hits, words) - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), hits


def _terms(text: str) -> set[str]:
    """Words ("idiot$") and stems ("idio*") of a text."""
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        if len(w) >= SHORTEST:
            out.update(w[:k] + "*" for k in range(SHORTEST, min(len(w), LONGEST_STEM) + 1))
            out.add(w + "$")
    return out


_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))


def sketch(text: str) -> list[int]:
    """Minima of SKETCH hashes over the words of a text; zeros if it has none."""
    words = [zlib.crc32(w.encode()) for w in set(re.findall(r"[^\W\d_]+", text.lower()))]
    least = np.full(SKETCH, np.iinfo(np.uint64).max if words else 0, np.uint64)
    for i in range(0, len(words), 4096):
        some = np.array(words[i : i + 4096], np.uint64)
        least = np.minimum(least, mix(some[:, None] ^ _SEEDS).min(0))
    return (least >> np.uint64(33)).astype(np.int32).tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([sketch(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held"], batch["toxic"], made], names=["doc_id", "held", "toxic", "sketch"])


def without_copies(sample: DataFrame) -> DataFrame:
    """Rows of a bounded sample (doc_id, text, toxic) less near copies of a row of the same class before it.

    Of rows that share BAND minima at one place, the one with the smallest (doc_id, hash of the text) is compared with
    each of the others; those that equal it in AGREE of SKETCH minima go. A row that is no such copy always stays.
    """
    keyed = sample.withColumn("held", F.xxhash64("text")).dropDuplicates(["doc_id", "held", "toxic"])
    kind = "doc_id long, held long, toxic int, sketch array<int>"
    made = materialise(keyed.select("doc_id", "text", "held", F.col("toxic").cast("int")).mapInArrow(_sketches, kind), "sketches")
    bands = F.transform(F.sequence(F.lit(0), F.lit(SKETCH // BAND - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * BAND + 1, F.lit(BAND))))
    dealt = made.select("*", F.explode(bands).alias("band"))
    first = F.min(F.struct("doc_id", "held", "sketch")).alias("first")
    leaders = dealt.groupBy("toxic", "band").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # At most SKETCH / BAND / 2 rows per row of the sample, whose size is bounded.
    met = dealt.join(F.broadcast(leaders), ["toxic", "band"]).where("struct(first.doc_id, first.held) < struct(doc_id, held)")
    equal = F.size(F.filter(F.zip_with("sketch", "first.sketch", lambda x, y: x == y), lambda same: same))
    copies = met.where(equal >= AGREE).select("doc_id", "held", "toxic").distinct()
    return keyed.join(F.broadcast(copies), ["doc_id", "held", "toxic"], "left_anti")


def _counted_terms(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    names = [t for t in counts[1]] + [t for t in counts[0] if t not in counts[1]]
    for i in range(0, len(names), 50_000):
        some = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), pa.array([counts[1][t] for t in some], pa.int64()), pa.array([counts[0][t] for t in some], pa.int64())],
            names=["term", "toxic", "clean"],
        )


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each term, by class; a term comes again whenever HELD_TERMS were counted, so a task holds no more."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            counts[toxic].update(_terms(text))
            if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                yield from _counted_terms(counts)
                counts = {0: Counter(), 1: Counter()}
    yield from _counted_terms(counts)


def term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: in how many texts of each class a term is. Every row counts."""
    spread = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_term_counts, "term string, toxic long, clean long")
    return spread.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, bool]]:
    """The terms with enough evidence, strongest first; none that another chosen one covers. Of equal ones the longest word."""
    scored = []
    for term, t, c in rows:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        share = toxic / (toxic + clean)
        ratio = t * np.log(t / ((t + c) * share)) + (c * np.log(c / ((t + c) * (1 - share))) if c else 0.0) if t else 0.0
        if t >= LEAST_TEXTS and odds >= LEAST_ODDS and ratio >= LEAST_RATIO:
            scored.append((-t * odds, term.endswith("*"), -len(term), term))
    chosen: list[tuple[str, bool]] = []
    words, stems, begun = set(), set(), set()
    for _, stem, _, term in sorted(scored):
        word = term[:-1]
        heads = {word[:k] for k in range(1, min(len(word), LONGEST_STEM) + 1)}
        if word in words or heads & stems or (stem and word in begun):
            continue
        chosen.append((word, stem))
        (stems if stem else words).add(word)
        begun |= heads
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    z = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(h, z.T @ (weight * (p - y)) + penalty * beta)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of the training rows (crc32 of doc_id mod 5 is not 0), and all such labels by class."""
    marks = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where((F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0) & F.col("toxic").isin(0, 1))
    )
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    some = None
    for kind, most in ((1, max_toxic), (0, max_clean)):
        part = marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.union(part)
    return docs.join(F.broadcast(some), "doc_id"), totals  # at most max_toxic + max_clean rows


def _common_words(counted: DataFrame, automata: list[Automaton], texts_of: dict[int, int]) -> frozenset[str]:
    """Words at a distance from an entry that clean texts use as much as toxic ones; at most the words of the sample."""
    if not automata:
        return frozenset()
    held = counted.sparkSession.sparkContext.broadcast(automata)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for part in slices(batch):
                lowered = _lowered(part["text"].to_pylist())
                owner, start, end, _, errors, _ = find_words(lowered, held.value)
                toxic = part["toxic"].to_pylist()
                for k, word in {(k, lowered[k][a:b]) for k, a, b, e in zip(owner.tolist(), start.tolist(), end.tolist(), errors.tolist()) if e}:
                    counts[toxic[k]][word] += 1
        names = list(counts[0])
        clean, toxic = ([counts[k][w] for w in names] for k in (0, 1))
        other = [w for w in counts[1] if w not in counts[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + other, pa.string()), pa.array(toxic + [counts[1][w] for w in other], pa.int64()), pa.array(clean + [0] * len(other), pa.int64())],
            names=["word", "toxic", "clean"],
        )

    words = counted.select("text", "toxic").mapInArrow(spelt, "word string, toxic long, clean long").groupBy("word")
    words = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (texts_of[1] + 1)) - F.log((F.col("c") + 0.5) / (texts_of[0] + 1))
    return frozenset(r["word"] for r in words.where((F.col("c") >= COMMON_TEXTS) & (odds < COMMON_ODDS)).select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit lexicon, evidence and regression on at most ``max_toxic + max_clean`` labelled rows.

    Without rows of both classes the model scores every text with the share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    sample, totals = labelled_sample(texts, labels, max_toxic, max_clean)
    sample = materialise(sample.select("doc_id", "text", "toxic"), "labelled")
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counted = materialise(without_copies(sample), "counted")
    texts_of = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in counted.groupBy("toxic").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (texts_of[1] + 1)) - F.log((F.col("clean") + 0.5) / (texts_of[0] + 1))
    strong = term_counts(counted).where((F.col("toxic") >= LEAST_TEXTS) & (odds >= LEAST_ODDS - 1e-9))
    entries = choose_entries([tuple(r) for r in strong.collect()], texts_of[1], texts_of[0])
    model = Model(automata=compile_shards(entries))
    model.common = _common_words(counted, model.automata, texts_of)
    found = spark.sparkContext.broadcast(model)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hits, words = found.value.hits(part["text"].to_pylist())
                kind = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["toxic"], pa.array(words.astype(np.int64)), pa.array([[[n, e, int(q)] for n, e, q, *_ in h] for h in hits], kind)],
                    names=["doc_id", "toxic", "words", "hits"],
                )

    rows = sample.mapInArrow(matched, "doc_id long, toxic int, words long, hits array<array<int>>").orderBy("doc_id", "words", "hits").collect()
    y = np.array([r["toxic"] for r in rows], float)
    hits = [[(n, e, bool(q)) for n, e, q in r["hits"]] for r in rows]
    seen = np.zeros((2, len(entries), 3))
    for r, found_ in zip(rows, hits):
        for n, e in {(n, e) for n, e, q in found_ if not q}:
            seen[int(r["toxic"]), n, e] += 1
    rate = [(seen[k] + 0.5) / (counts[k] + 1) for k in (0, 1)]
    evidence = np.maximum(0, np.log(rate[1]) - np.log(rate[0]))
    # A misspelling never met in the sample is trusted half as much as the word itself.
    unseen = (seen[0] + seen[1]) == 0
    model.evidence = np.where(unseen, evidence[:, :1] / 2, evidence)
    x = model.features(hits, np.array([r["words"] for r in rows]))
    weight = np.where(y == 1, totals[1] / counts[1], totals[0] / counts[0])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model.weights, model.bias = _logistic((x - model.mean) / model.scale, y, weight / weight.mean())
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: doc_id, held_out, score, predicted, matches (start, end, quoted).

    Null texts count as empty and get the score of a text without words. Repeated rows are scored each on its own;
    a row without doc_id is not held out. Only the text enters the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("quoted", pa.bool_())]))
        for batch in batches:
            for part in slices(batch):
                score, hits = shared.value.score(part["text"].to_pylist())
                spans = [[{"start": a, "end": b, "quoted": q} for _, _, q, a, b in h] for h in hits]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "matches"])

    kind = "doc_id long, score double, matches array<struct<start:long,end:long,quoted:boolean>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(scored, kind).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "matches",
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with a score below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(p["text"].to_pylist())[0] for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.coalesce(col(text_col).cast("string"), F.lit(""))) < limit)
