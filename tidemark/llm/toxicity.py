"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed. The lexical one reads words and writes classes: insults
(stems with weights, induced from labelled rows), threats, targets, negations, verbs of speech,
particles (the small words that clauses are built with, learned from the same rows), and what ends
a clause (commas, conjunctions) or a sentence. The negation one marks what stands in a negation's
scope, the reporting one what follows a verb of speech in its sentence. The frame one finds an
insult's argument: a target or particle up to REACH words before it in its clause, or else up to
REACH words after it; and a threat's, in order, a target after it. The clause one keeps a
clause's most telling match and accepts it at the clause's end. Words alone match nothing, nor does
an insult whose clause has its target or particle elsewhere. An accepted clause weighs as much as
its heaviest insult in that context. The composed table is made of the states that texts reach.
Documents are scored by the weights of accepted clauses of each kind and by how many clauses
there are; these are fitted on the labelled sample too, so that a negated or reported
insult never counts for more than a plain one.

Insult stems are prefixes that are far more frequent among the words of toxic
rows: the grammar holds what inflection varies. The sample is bounded
(``per_class`` rows of each label); scoring covers whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sample

# Closed classes of the grammar, in the four languages.
THREATS = {"kill", "murder", "hurt", "stab", "shoot", "destroy", "töten", "umbringen", "verletzen", "tuer", "frapper", "matar", "herir"}
TARGETS = {"you", "your", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "sie", "er", "tu", "te", "toi", "vous", "ils", "elle", "usted", "ustedes", "ellos", "ella"}
NEGATIONS = {"not", "no", "never", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás"}
REPORTS = {"said", "says", "wrote", "claimed", "quoted", "sagte", "schrieb", "behauptete", "dit", "écrit", "dijo", "escribió"}

# Words and signs that end a clause, not its sentence.
CONJUNCTIONS = {"and", "but", "because", "while", "und", "aber", "weil", "denn", "et", "mais", "parce", "car", "y", "pero", "porque"}
BREAKS = {",", ":", "(", ")", "\"", "–"}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PARTICLE, BREAK, END = CLASSES = range(9)
#: Words that a negation reaches; words between an insult and its argument, the argument counted.
SCOPE, REACH = 3, 3
#: What an insult may stand in, from the least to the most telling.
CONTEXTS = IN_NEGATION, IN_REPORT, IN_PLAIN = range(3)
EVENTS = NEGATED, REPORTED, FRAMED, AIMED, THREATENED = ("negated", "reported", "framed", "aimed", "threat")
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,()\"–\n]")
#: Lengths of stems that are tried; labelled toxic rows a stem needs; how many times likelier it is among their words.
STEM, SUPPORT, LIFT = (4, 7), 4, 12.0
#: What a stem's likelihood ratio statistic must reach: a stem of chance rarely does, however many are tried.
EVIDENCE = 22.0
#: A particle's least share of labelled rows.
COMMON = 0.05
#: Weight of a document's clauses of one kind from which on more of them add nothing.
MOST = 60.0
#: Weight of a threat with a target; weights of the events where no row tells.
MENACE, PRIOR = 12.0, (0.0, 0.0, 5.0, 0.0, 5.0)
# Insults the grammar knows from the start.
INSULTS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "dumb", "jerk", "blödmann", "dummkopf", "trottel", "imbécile", "crétin", "estúpido", "imbécil", "tonto")
ENDINGS = ("", "e", "en", "es", "n", "s")


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1)] or [word]


def evidence(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood gained by separate rates a/n and b/m over a common one."""
    part = lambda k, total, rate: k * math.log(k / (total * rate)) if k else 0.0
    rate = (a + b) / (n + m)
    return 2 * (part(a, n, rate) + part(b, m, rate) + part(n - a, n, 1 - rate) + part(m - b, m, 1 - rate)) if 0 < rate < 1 else 0.0


def places(texts: list[list[str]], stems: set[str]) -> dict[str, tuple[int, int]]:
    """For each stem the different places (pairs of neighbours) it has, and the texts most of whose places for it no earlier text has:
    copies of one text, exact or near, are no more evidence than the text itself."""
    seen: dict[str, set] = {s: set() for s in stems}
    rows: Counter = Counter()
    for words in texts:
        here: dict[str, set] = {}
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            for s in stems_of(w):
                if s in seen:
                    here.setdefault(s, set()).add(hash((before, after)))
        for s, p in here.items():
            rows[s] += 2 * len(p - seen[s]) > len(p)
            seen[s] |= p
    return {s: (len(p), rows[s]) for s, p in seen.items()}


def induced(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Stems with weights (log of how much likelier they are among the words of toxic rows); the shortest that qualifies stands
    for longer ones, as far on as it keeps nine tenths of its places."""
    split = {y: [TOKEN.findall(t.lower()) for t, z in rows if z == y] for y in (0, 1)}
    said = {y: Counter(w for words in split[y] for w in words) for y in (0, 1)}
    n, m = (max(1, said[y].total()) for y in (1, 0))
    raw = {y: Counter() for y in (0, 1)}
    for y in (1, 0):
        for w, k in said[y].items():
            for s in stems_of(w):
                if y or s in raw[1]:
                    raw[y][s] += k
    known = {s[: STEM[1]] for s in INSULTS}
    tried = {s for s, k in raw[1].items() if k >= SUPPORT and 3 * k * m >= LIFT * raw[0][s] * n} | known
    toxic, clean = places(split[1], tried), places(split[0], tried)
    count = {s: (toxic[s][0], clean[s][0]) for s in tried}
    lift = {s: ((a + 0.1) / n) / ((b + 0.1) / m) for s, (a, b) in count.items()}
    out = {s: math.log(max(LIFT, lift[s[: STEM[1]]])) for s in INSULTS if sum(count[s[: STEM[1]]])}
    longer: dict[str, list[str]] = {}
    for s in tried:
        longer.setdefault(s[:-1], []).append(s)
    for s in sorted(tried, key=lambda s: (len(s), s)):
        a, b = count[s]
        if toxic[s][1] >= SUPPORT and lift[s] >= LIFT and evidence(a, n, b, m) >= EVIDENCE and not any(s[:i] in out for i in range(1, len(s))):
            while (more := max(longer.get(s, ()), key=lambda e: (count[e][0], e), default=None)) and count[more][0] >= 0.9 * count[s][0]:
                s = more
            out[s] = math.log(lift[s])
    # what the rows never say weighs as those that they say do, but only as a whole word (marked by a full stop) with a common ending
    usual = sorted(out.values())[len(out) // 2] if out else math.log(LIFT)
    return {f"{s}{e}.": usual for s in INSULTS if s not in out for e in ENDINGS} | out


def particles(rows: list[tuple[str, int]]) -> set[str]:
    """Words that COMMON of the rows hold, toxic or not: what clauses of any content are built with."""
    often = Counter(w for t, _ in rows for w in set(TOKEN.findall(t.lower())) if w.isalpha())
    return {w for w, k in often.items() if k >= max(2, COMMON * len(rows))}


@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) gives the next state, the symbol written, and what is accepted: (event, context) or None."""

    start: object
    step: Callable[[object, object], tuple[object, object, tuple]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes is what the other reads."""

        def step(state, symbol):
            mine, written, first = self.step(state[0], symbol)
            its, out, second = other.step(state[1], written)
            return (mine, its), out, first or second

        return Transducer((self.start, other.start), step)


class Table:
    """A transducer's next states, symbols written and what is accepted, at state * symbols + symbol, filled in as states are reached."""

    def __init__(self, machine: Transducer, symbols):
        self.machine, self.symbols = machine, list(symbols)
        self.places, self.order = {machine.start: 0}, [machine.start]
        self.next, self.said, self.accepted = ([x] * len(self.symbols) for x in (-1, None, None))

    def fill(self, at: int) -> int:
        state, symbol = divmod(at, len(self.symbols))
        to, self.said[at], self.accepted[at] = self.machine.step(self.order[state], self.symbols[symbol])
        if to not in self.places:
            self.places[to] = len(self.order)
            self.order.append(to)
            for column, x in ((self.next, -1), (self.said, None), (self.accepted, None)):
                column.extend([x] * len(self.symbols))
        self.next[at] = self.places[to]
        return self.next[at]


def negate(left: int, symbol: int):
    """Counts down a negation's scope; a clause's end closes it."""
    after = SCOPE if symbol == NEGATION else 0 if symbol in (BREAK, END) else max(left - 1, 0)
    return after, (symbol, left > 0), None


def report(inside: bool, read: tuple):
    """After a verb of speech the rest of the sentence is reported."""
    symbol, negated = read
    return (symbol == REPORT or inside) and symbol != END, (symbol, IN_REPORT if inside else IN_NEGATION if negated else IN_PLAIN), None


def frame(seen: tuple[int, int, int, int, int], read: tuple):
    """Holds how far the last target, the last particle, an insult without argument (and its context) and a plain threat still reach; writes the symbol, its context and the event that it completes."""
    (target, particle, waits, context, threat), (symbol, here) = seen, read
    if symbol in (BREAK, END):
        return (0, 0, 0, 0, 0), (symbol, None, None), None
    event = None
    if symbol == INSULT and (target or particle):
        event = (NEGATED, REPORTED, AIMED if target else FRAMED)[here]
    elif symbol in (TARGET, PARTICLE) and waits:
        event = (NEGATED, REPORTED, AIMED if symbol == TARGET else FRAMED)[context]
    elif symbol == TARGET and threat:
        event = THREATENED
    less = lambda n: max(n - 1, 0)
    waits, context = (REACH, here) if symbol == INSULT and event is None and not (waits and context > here) else (less(waits), context if waits > 1 else 0)
    after = (REACH if symbol == TARGET else less(target), REACH if symbol == PARTICLE else less(particle), waits, context, REACH if symbol == THREAT and here == IN_PLAIN else less(threat))
    return after, (symbol, here if symbol == INSULT else None, event), None


def clause(best: int, read: tuple):
    """Keeps a clause's most telling event (0 none, else its number and one); accepts it at the clause's end. Writes the context of an insult."""
    symbol, context, event = read
    if symbol in (BREAK, END):
        return 0, None, best - 1 if best else None
    rank = lambda e: RANKS[e - 1] if e else -1
    new = EVENTS.index(event) + 1 if event else 0
    return max(best, new, key=rank), context, None


#: How telling the events are, in their order: a threat says more than what is denied or quoted.
RANKS = (0, 1, 3, 4, 2)
#: The context of the insult that each event is about.
CONTEXT_OF = (IN_NEGATION, IN_REPORT, IN_PLAIN, IN_PLAIN, None)
CLAUSES = Transducer(0, negate).then(Transducer(False, report)).then(Transducer((0, 0, 0, 0, 0), frame)).then(Transducer(0, clause))
TABLE = Table(CLAUSES, CLASSES)


class Grammar:
    """The lexical transducer, before the composed clause table, and the weights of what it accepts."""

    def __init__(self, stems: dict[str, float], particles: set[str] = frozenset()):
        self.stems, self.particles = stems, particles
        self.lengths = sorted({len(s) for s in stems})
        self.classes: dict[str, tuple[int, float]] = {}
        self.bias, self.weights = -3.0, np.array([*PRIOR, 0.0])

    def word(self, w: str) -> tuple[int, float]:
        """The class of a word or sign and its weight."""
        if len(w) == 1 and not w.isalpha():
            return (BREAK if w in BREAKS else END), 0.0
        if (v := self.stems.get(w + ".")) is not None:
            return INSULT, v
        for n in self.lengths:
            if (v := self.stems.get(w[:n])) is not None:
                return INSULT, v
        for kind, words in ((THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (BREAK, CONJUNCTIONS), (PARTICLE, self.particles)):
            if w in words:
                return kind, 1.0
        return OTHER, 0.0

    def read(self, text: str) -> np.ndarray:
        """The weights of a text's accepted clauses by event, and how many clauses it has."""
        out = [0.0] * (len(EVENTS) + 1)
        known, width, state = self.classes, len(CLASSES), 0
        following, said, accepted = TABLE.next, TABLE.said, TABLE.accepted
        heaviest, words = [0.0] * len(CONTEXTS), 0
        if len(known) > 500_000:
            known.clear()
        for w in [*TOKEN.findall(text.lower()), "."]:
            c = known.get(w)
            if c is None:
                c = known[w] = self.word(w)
            at = state * width + c[0]
            state = following[at]
            if state < 0:
                state = TABLE.fill(at)
            if c[0] < BREAK:
                words += 1
                if c[0] == INSULT:
                    heaviest[said[at]] = max(heaviest[said[at]], c[1])
            elif words:
                out[-1] += 1
                if (found := accepted[at]) is not None:
                    out[found] += MENACE if CONTEXT_OF[found] is None else heaviest[CONTEXT_OF[found]]
                heaviest, words = [0.0] * len(CONTEXTS), 0
        return np.array(out)

    @staticmethod
    def features(read: np.ndarray) -> np.ndarray:
        """Weights of clauses are log-likelihood ratios and add up (MOST settles it); an aimed clause is a framed one and more; the number of clauses counts by its logarithm."""
        events = np.minimum(read[..., :-1], MOST) / 10  # a copy
        events[..., EVENTS.index(FRAMED)] += events[..., EVENTS.index(AIMED)]
        return np.concatenate((events, np.log1p(read[..., -1:])), axis=-1)

    def fit(self, rows: list[tuple[str, int]], rounds: int = 3000, keep: float = 1e-5) -> Grammar:
        """Weights by logistic regression, events that no row has at PRIOR; no event speaks against toxicity, what is denied or reported for it no more than what is said, and no number of clauses for it."""
        y = np.array([r[1] for r in rows], float)
        x = np.column_stack((self.features(np.stack([self.read(r[0]) for r in rows])), np.ones(len(rows))))
        steepest = np.linalg.eigvalsh(x.T @ x / len(y))[-1] / 4 + keep
        w = before = prior = np.array([*PRIOR, 0.0, 0.0])
        for i in range(rounds):  # projected descent with momentum
            at = w + i / (i + 3) * (w - before)
            d = (1 / (1 + np.exp(-(x @ at))) - y) / len(y)
            before, w = w, at - (x.T @ d + keep * (at - prior)) / steepest
            w = np.concatenate((np.maximum(w[:-2], 0), np.minimum(w[-2:-1], 0), w[-1:]))
            w[:2] = np.minimum(w[:2], w[EVENTS.index(FRAMED)])
        self.weights, self.bias = w[:-1], float(w[-1])
        threat = EVENTS.index(THREATENED)
        if not x[:, threat].any():  # no row tells: one threat, in a text of a clause, is enough
            self.weights[threat] = max(self.weights[threat], (1 - self.bias - self.weights[-1] * math.log(2)) * 10 / MENACE)
        return self

    def score(self, text: str | None) -> float:
        """The probability of label 1. A text without an accepted clause stays below one half whatever its words."""
        read = self.read(text or "")
        z = float(self.features(read) @ self.weights + self.bias) if read[:-1].any() else min(self.bias, -1.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def grammar(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2500, longest: int = 12_000) -> Grammar | float:
    """Fitted on a bounded sample of labelled rows (see quality.sample); with rows of one label only that label, with none 0.

    Null and empty texts, repeated rows and ids labelled more than once are rows like others;
    only the id, text and label columns are read.
    """
    rows = sample(docs, labels, learn, "toxic", per_class, longest)
    ys = {y for _, y in rows}
    if len(ys) < 2:
        return float(max(ys, default=0))
    return Grammar(induced(rows), particles(rows)).fit(rows)


def scored(docs: DataFrame, model: Grammar | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row. A null text is scored as an empty one, texts without an accepted clause alike; whole texts
    of any length are read word by word. Repeated rows and null ids are rows like others, ties have equal scores, an empty
    table gives an empty one. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            m = sent.value
            texts = batch.column(1).to_pylist()
            p = [m] * len(texts) if isinstance(m, float) else [m.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Grammar | float, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score is under ``reject``; odd rows as for scored. No column is added on the way."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            m = sent.value
            good = [(m if isinstance(m, float) else m.score(t)) < reject for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
