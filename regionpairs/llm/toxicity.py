"""Operator 10: toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to classes: insults (words and stems learned from labelled documents), threats, targets,
first persons, negations, reporting verbs. Small machines over the classes - insult, threat, target, negation, reported
speech - are composed into one transducer, which reads clause by clause and emits an event per match: a plain, targeted,
negated or reported insult, and a threat of a target, plain, negated or reported. A threatening verb without a target
("kill the process") is none: in English the target follows within a few words, in German, French and Spanish it may also be
an object pronoun earlier in the clause ("ich werde dich töten", "je vais te tuer", "te voy a matar"). Event weights are learned on the same bounded sample and give the document's probability.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled, slices, texts, through_table, tidy

#: Labelled rows, by smallest hash of their id, that the lexicon and the weights are learned from.
SAMPLE = 20_000
#: Lengths of stems; different contexts that a lexicon entry needs; how many times likelier it is in toxic documents, two deviations to the worse. All entries that meet these are kept; the sample bounds them.
STEMS, CONTEXTS, LIFT = (3, 4, 5, 6, 7, 8), 8, 12.0
#: Words after a negation that it reaches; words after a threatening verb within which its target stands.
SCOPE, REACH = 5, 3
#: Word lists of the grammar (fixed values, four languages).
TARGETS = frozenset("you your yours u she he they them him her his these those this people everyone du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre il elle ils eux tú usted ustedes él ella ellos vosotros".split())
FIRST = frozenset("i we ich wir je nous yo nosotros".split())
NEGATIONS = frozenset("not no never cannot n't without nicht kein keine nie niemals ohne pas jamais sans ni nunca jamás sin".split())
REPORTS = frozenset("said says say called wrote claimed quoted reported told sagte sagt nannte schrieb behauptete dit disait appelé écrit dijo dice llamó escribió".split())
THREATS = frozenset("kill murder hurt destroy shoot stab burn beat".split())
#: Threatening verbs of languages that put an object pronoun before them, and these pronouns.
LATE_THREATS = frozenset("töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split())
OBJECTS = frozenset("dich dir euch ihn ihm te toi vous os".split())
#: Targets that are subjects in these languages (du is a French article too), so nobody whom a late verb after them threatens.
SUBJECTS = frozenset("du er il ils tú".split())
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"«»„“”]")
#: A colon ends no clause: what is said may follow it.
CLAUSE = re.compile(r"[^.!?;\n]+")
EVENTS = ("insult", "targeted insult", "negated insult", "reported insult", "targeted threat", "negated threat", "reported threat")

# Component machines: state -> class -> state; a class that isn't listed keeps the state. Classes: I insult, H threat,
# L threat whose object may come before it, T target, P target as an object pronoun, A first person, N negation, R report,
# Q quotation mark, O other.
CLASSES = "IHLTPANRQO"
# a target (1), an object pronoun (2) since the clause's start
TARGET = {0: {"T": 1, "P": 2}, 1: {"P": 2}, 2: {}}
NEGATION = {0: {"N": SCOPE}} | {k: {c: SCOPE if c == "N" else k - 1 for c in CLASSES} for k in range(1, SCOPE + 1)}
# what others say is open after their verb, up to the end of the clause or of the quotation; one's own words (3) are no report
REPORT = {0: {"R": 1, "A": 3}, 1: {"Q": 2}, 2: {"Q": 0}, 3: {c: 3 if c == "A" else 0 for c in CLASSES}}


def compose(*machines) -> dict[tuple, dict[str, tuple]]:
    """Product of machines over the same classes: reachable states and their moves for every class."""
    start = tuple(0 for _ in machines)
    out, todo = {}, [start]
    while todo:
        s = todo.pop()
        if s not in out:
            out[s] = {c: tuple(m[q].get(c, q) for m, q in zip(machines, s)) for c in CLASSES}
            todo += out[s].values()
    return out


GRAMMAR = compose(TARGET, NEGATION, REPORT)


def emits(state: tuple, cls: str) -> str | None:
    """The event when an insult or a threat is read in a state; what weakens comes before what strengthens."""
    if cls not in "IHL":
        return None
    target, negation, report = state
    kind = "negated " if negation else "reported " if report in (1, 2) else "targeted " if target else ""
    return kind + ("insult" if cls == "I" else "threat")


TRANSDUCER = {(s, c): (to, emits(s, c)) for s, moves in GRAMMAR.items() for c, to in moves.items()}


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        import ahocorasick

        self.any = ahocorasick.Automaton()
        for w in {*words, *stems, *THREATS, *LATE_THREATS}:
            self.any.add_word(w, w)
        self.any.make_automaton()
        self.lengths = sorted({len(s) for s in stems})

    def read(self, w: str) -> tuple[str, float]:
        """Class and weight of a word."""
        if w in self.words:
            return "I", self.words[w]
        for n in self.lengths:
            if w[:n] in self.stems and len(w) > n:
                return "I", self.stems[w[:n]]
        if w in THREATS or w in LATE_THREATS:
            return "H" if w in THREATS else "L", 1.0
        if w in OBJECTS:
            return "P", 0.0
        return ("N" if w in NEGATIONS or w[-3:] in ("n't", "n’t") else "A" if w in FIRST else "R" if w in REPORTS else "T" if w in TARGETS else "Q" if not w[0].isalpha() else "O"), 0.0

    def spots(self, low: str) -> list[int]:
        """Where a lexicon entry starts a word."""
        return [end - len(w) + 1 for end, w in self.any.iter(low) if end == len(w) - 1 or not low[end - len(w)].isalpha()]


def matches(text: str, lex: Lexicon) -> tuple[Counter, float, set]:
    """Events of a text, their summed lexicon weight and the distinct entries that matched."""
    low = text.lower()
    events, weight, entries = Counter(), 0.0, set()
    spots = lex.spots(low)
    if not spots:
        return events, weight, entries
    start = (0, 0, 0)
    done = -1
    for spot in sorted(spots):
        if spot < done:
            continue
        lo = max(low.rfind(c, 0, spot) for c in ".!?;\n") + 1
        clause = CLAUSE.match(low, lo)
        done = clause.end()
        words = WORD.findall(clause.group())
        state = start
        read = [lex.read(w) for w in words]
        after = sum(c in "TP" for c, _ in read)  # a target may also follow what is said of it
        for k, (w, (c, x)) in enumerate(zip(words, read)):
            after -= c in "TP"
            met = state[0] == 2
            state, event = TRANSDUCER[state, c]
            near = any(d == "P" or d == "T" and (c == "H" or v not in SUBJECTS) for v, (d, _) in zip(words[k + 1 : k + 1 + REACH], read[k + 1 :]))
            if c in "HL" and not near and not (c == "L" and met):
                continue  # nobody is threatened
            if event:
                if event in ("insult", "threat"):
                    event = f"targeted {event}" if after or event == "threat" else event
                events[event] += 1
                weight += x
                entries.add(w)
    return events, weight, entries


def features(text: str, lex: Lexicon) -> list[float]:
    e, weight, entries = matches(text, lex)
    n = sum(e.values())
    return [*(math.log1p(e[k]) for k in EVENTS), math.log1p(weight), math.log1p(len(entries)), float(len(entries) >= 2), math.log1p(100 * n / max(1.0, len(text) / 6))]


def labelled(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """toxic and text of the sampled labelled rows outside fold 0. Their ids, at most `sample`, are sent to the tasks."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    ids = sampled(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")), sample)
    return texts(docs).join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5):
    """(lexicon, weights) from labelled rows outside fold 0."""
    import numpy as np

    rows = through_table(labelled(docs, labels, sample, folds), "labelled")  # read five times
    seen = rows.where("toxic = 1").mapInArrow(_contexts, "entry string, form string, context long").distinct()
    known = seen.groupBy("entry").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("form").alias("forms")).where((F.col("contexts") >= CONTEXTS) & (F.col("entry").startswith("=") | (F.col("forms") >= 6)))
    toxic = {r.entry: r.contexts for r in known.collect()}  # of at most `sample` texts
    clean = Counter()
    if toxic:
        for r in rows.where("toxic = 0").mapInArrow(functools.partial(_clean, entries=frozenset(toxic)), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
            clean[r.entry] = r.n
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    odds = max(1, sizes.get(0, 0)) / max(1, sizes.get(1, 0))
    sure = {e: odds * (a - 2 * math.sqrt(a)) / (clean[e] + 2 * math.sqrt(clean[e]) + 1) for e, a in toxic.items()}
    good = sorted((e for e, x in sure.items() if x >= LIFT), key=lambda e: (-sure[e], e))
    weight = lambda e: math.log(odds * toxic[e] / (clean[e] + 0.5))
    stems: dict[str, float] = {}
    for e in good:  # of stems that begin each other, the surest
        if e[0] == "^" and not any(e[1:].startswith(x) or x.startswith(e[1:]) for x in stems):
            stems[e[1:]] = weight(e)
    words = {e[1:]: weight(e) for e in good if e[0] == "=" and not any(e[1 : k + 1] in stems for k in range(1, len(e) - 1))}
    lex = Lexicon(words, stems)
    got = rows.mapInArrow(functools.partial(_features, words=words, stems=stems), "toxic int, n long, x array<double>").groupBy("toxic", "x").agg(F.sum("n").alias("n")).collect()
    width = len(features("", lex)) + 1
    if not got:
        return lex, np.array([-2.0] + [0.0] * (width - 1))
    x = np.array([[1.0, *r.x] for r in got])
    y, n = np.array([r.toxic for r in got], float), np.array([r.n for r in got], float)
    w = np.zeros(width)
    penalty = np.full(width, 0.05)
    for _ in range(25):  # Newton's method on the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(penalty), x.T @ (n * (p - y)) + penalty * w)
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return lex, w


def _entries(w: str):
    yield "=" + w
    for k in STEMS:
        if len(w) > k:
            yield "^" + w[:k]


@tidy
def _contexts(batches):
    import zlib

    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            out = set()
            for t in part.column("text").to_pylist():
                words = WORD.findall(t.lower())
                for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                    if len(w) > 2:
                        c = zlib.crc32(f"{a} {b}".encode())
                        out.update((e, w if e[0] == "^" else "", c) for e in _entries(w))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["entry", "form", "context"])


@tidy
def _clean(batches, entries):
    import pyarrow as pa

    for part in (part for batch in batches for part in slices(batch)):
        n: Counter = Counter()
        for t in part.column("text").to_pylist():
            n.update(e for w in WORD.findall(t.lower()) for e in _entries(w) if e in entries)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])


@tidy
def _features(batches, words, stems):
    import pyarrow as pa

    lex = Lexicon(words, stems)
    for part in (part for batch in batches for part in slices(batch)):
        n = Counter((y, tuple(features(t, lex))) for y, t in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([list(k[1]) for k in n], pa.list_(pa.float64()))], ["toxic", "n", "x"])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row, from its whole text alone.

    Null and empty texts match nothing and get the score of a text without matches; repeated rows are kept and score
    alike; a row with a null doc_id is scored and not held out. Without labels every text gets one low score. Labels given
    twice for a document count as their maximum, those without a doc_id not at all.
    """
    lex, w = learn(docs, labels, sample, folds)
    got = texts(docs).mapInArrow(functools.partial(_score, words=lex.words, stems=lex.stems, weights=[float(x) for x in w]), "doc_id long, score double")
    return got.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@tidy
def _score(batches, words, stems, weights):
    import pyarrow as pa

    lex = Lexicon(words, stems)
    for batch in batches:
        for part in slices(batch):
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] + sum(a * b for a, b in zip(weights[1:], features(t, lex))))))) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])
