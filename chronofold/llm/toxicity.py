"""Operator 1: toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses; the words of a clause become symbols (insult, threat, target, negation, reported speech,
other). Four letter transducers are composed into one: negation rewrites what it reaches, reported speech rewrites what
follows it in the clause, targets near an insult or threat rewrite it to an aimed one, and the last one weighs what is left.
A clause scores the sum of its weights, so a word alone does not decide: "not an idiot" and "she said idiot" weigh less
than "you idiot". Insult stems and their weights are learned from a bounded sample of labelled rows, added to fixed seeds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import batch, saved

#: Closed word classes in the corpus's languages.
SEEDS = {
    "threat": "kill hurt destroy attack beat stab shoot strangle töten schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
    "target": "you your youre u they them du dich dein ihr euch tu toi vous ton tú usted vosotros".split(),
    "negation": "not never no isnt arent dont wasnt nicht kein keine nie pas jamais aucun nunca jamás".split(),
    "report": "said says say told called wrote quoted claimed reported sagte schrieb nannte dit écrit appelé dijo llamó escribió".split(),
    "insult": "idiot moron loser scum stupid pathetic".split(),
}
SYMBOL = {"insult": "I", "threat": "H", "target": "T", "negation": "N", "report": "R"}
OTHER = "."
WORD = re.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]+")


@dataclass
class Transducer:
    """A deterministic letter transducer: (state, symbol) -> (symbol out, weight, state); other symbols pass as they are."""

    arcs: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)  # state -> next state on a symbol without an arc

    def step(self, state: object, symbol: str) -> tuple[str, float, object]:
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.rest.get(state, state))


def windowed(opener: str, changes: dict[str, str], reach: int) -> Transducer:
    """After `opener`, symbols up to `reach` words on are changed."""
    t = Transducer({(s, opener): (opener, 0.0, reach) for s in range(reach + 1)}, {s: max(0, s - 1) for s in range(reach + 1)})
    for s in range(1, reach + 1):
        for a, b in changes.items():
            t.arcs[s, a] = (b, 0.0, s - 1)
    return t


def reported() -> Transducer:
    """After a verb of speech, insults and threats of the clause are reported ones."""
    t = Transducer({(0, "R"): ("R", 0.0, 1), (1, "R"): ("R", 0.0, 1)})
    for a, b in (("I", "r"), ("H", "r"), ("i", "i")):
        t.arcs[1, a] = (b, 0.0, 1)
    return t


def weighing(weights: dict[str, float]) -> Transducer:
    """Each symbol's weight; a target soon after an insult adds a little."""
    t = Transducer(rest={0: 0, 1: 2, 2: 3, 3: 0})
    for s in range(4):
        for a, w in weights.items():
            t.arcs[s, a] = (a, w, 1)
    for s in (1, 2, 3):
        t.arcs[s, "T"] = ("T", 0.25, 0)
    return t


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that does both, over the reachable pairs of states."""
    out, todo, seen = Transducer(), [(0, 0)], {(0, 0)}
    while todo:
        a, b = todo.pop()
        for symbol in alphabet:
            middle, w1, a2 = first.step(a, symbol)
            last, w2, b2 = second.step(b, middle)
            out.arcs[(a, b), symbol] = (last, w1 + w2, (a2, b2))
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    numbers = {s: i for i, s in enumerate([(0, 0), *sorted(seen - {(0, 0)}, key=str)])}
    return Transducer({(numbers[s], x): (o, w, numbers[t]) for (s, x), (o, w, t) in out.arcs.items()})


#: What an insult of weight 1 counts for: plain, aimed at somebody, negated, reported; and threats, plain and aimed.
CLASS_WEIGHTS = {"I": 1.0, "A": 1.3, "i": 0.5, "r": 0.5, "H": 0.15, "K": 0.8, "h": 0.1}


def grammar(weights: dict[str, float] = CLASS_WEIGHTS) -> Transducer:
    alphabet = "IHTNR."
    negation = windowed("N", {"I": "i", "H": "h"}, 3)
    aim = windowed("T", {"I": "A", "H": "K"}, 4)
    both = compose(negation, reported(), alphabet)
    return compose(compose(both, aim, alphabet), weighing(weights), alphabet)


@dataclass
class Lexicon:
    """Whole words and word beginnings with their symbols, and insult weights. A calibration turns sums into scores."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, float]
    bias: float = -4.0
    slope: float = 3.0

    def symbol(self, word: str) -> tuple[str, float]:
        if (found := self.words.get(word)) is not None:
            return found
        for n in range(STEM[0], min(STEM[1], len(word)) + 1):
            if (w := self.stems.get(word[:n])) is not None:
                return "I", w
        return OTHER, 0.0


#: Lengths of learned word beginnings.
STEM = (4, 6)


def seed_lexicon() -> Lexicon:
    words = {w: (SYMBOL[kind], 1.0) for kind, all_words in SEEDS.items() for w in all_words}
    return Lexicon(words, {})


class Scorer:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.grammar = lexicon, grammar()
        self.finder = ahocorasick.Automaton()
        for w in [w for w, (s, _) in lexicon.words.items() if s in "IH"] + list(lexicon.stems):
            self.finder.add_word(w, w)
        self.finder.make_automaton()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that weigh anything, each read whole. Clauses without a trigger word are not read."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, done = [], 0
        for at, _ in self.finder.iter(low):
            if at < done:
                continue
            start = max(done, 1 + max(low.rfind(c, done, at) for c in CLAUSE_ENDS))
            m = CLAUSE_END.search(low, at)
            done = m.start() if m else len(low)
            state, total = 0, 0.0
            for word in WORD.finditer(low, start, done):
                symbol, weight = self.lexicon.symbol(word[0].replace("'", ""))
                _, w, state = self.grammar.step(state, symbol)
                total += w * (weight if symbol == "I" else 1.0)
            if total:
                out.append((start, done, total))
        return out

    def raw(self, text: str | None) -> float:
        """The sum of a text's clause weights, each clause counting 3 at most."""
        return sum(min(w, 3.0) for _, _, w in self.clauses(text)) if text else 0.0

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.lexicon.bias + self.lexicon.slope * math.log1p(raw)))))


# --- learning ------------------------------------------------------------------------------------------------


def features(text: str) -> set[str]:
    """Whole words as `=w` and word beginnings, of one text."""
    words = {w.replace("'", "") for w in WORD.findall(text.lower())}
    out = {f"={w}" for w in words if len(w) > 2}
    for n in range(STEM[0], STEM[1] + 1):
        out.update(w[:n] for w in words if len(w) > n)
    return out


def learn(sample: DataFrame, most_features: int = 4000, least_gain: float = 0.004) -> Lexicon:
    """Learns insult words and stems from sample(text, toxic), and a calibration.

    Document counts per feature and label are grouped in Spark; the strongest `most_features` are matched to the toxic
    texts, and a greedy cover keeps those that explain texts which no better feature explains: at least 5 and
    `least_gain` of them. All that reaches the driver is bounded by the sample's bound. With no toxic row the seeds stay.
    """
    lexicon = seed_lexicon()
    sample = sample.filter("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int")).dropDuplicates()
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if n1 < 5 or n0 < 5:
        return lexicon

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(features(text))
            rows = [(f, t, n) for t, c in counts.items() for f, n in c.items()]
            yield batch([list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []], pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    per = sample.mapInArrow(counted, "feature string, toxic int, n long").groupBy("feature")
    counts = per.agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1)))
    least = max(5, math.ceil(least_gain * n1))
    strong = counts.withColumn("odds", odds).filter((F.col("a") >= least) & (F.col("odds") > 3.0) & (F.col("b") <= 0.05 * F.col("a")))
    top = strong.orderBy(F.desc(F.col("a") * F.col("odds")), "feature").limit(most_features).collect()
    weight = {r["feature"]: r["odds"] for r in top}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([[sorted(features(t) & weight.keys()) for t in b.column(0).to_pylist()]], pa.schema([("found", pa.list_(pa.string()))]))

    texts = [set(r[0]) for r in sample.filter("toxic = 1").select("text").mapInArrow(matched, "found array<string>").collect()]
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(texts):
        for f in found:
            holders.setdefault(f, set()).add(i)
    # Evidence is shared: a text already explained counts less for the next feature, but all strong insults are kept.
    explained = np.zeros(len(texts))
    while holders:
        gain = {f: sum(0.5 ** explained[i] for i in own) * weight[f] for f, own in holders.items()}
        best = max(gain, key=lambda f: (round(gain[f], 6), f.startswith("="), -len(f), f))
        own = holders.pop(best)
        if sum(explained[i] < 2 for i in own) < least and len(own) < 0.05 * len(texts):
            break
        explained[list(own)] += 1
        for f in [f for f in holders if f.lstrip("=").startswith(best.lstrip("=")) or best.lstrip("=").startswith(f.lstrip("="))]:
            del holders[f]
        w = min(weight[best], 6.0) / 6.0
        if best.startswith("="):
            lexicon.words[best[1:]] = ("I", w)
        else:
            lexicon.stems[best] = w
    return calibrated(lexicon, sample)


def raws(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and raw, the sum of clause weights."""
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", raw double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in batches:
            out = pa.array([scorer.raw(t.as_py()) for t in b.column(0)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], out], names=[*keep, "raw"])

    return docs.select("text", *keep).mapInArrow(run, kind)


def calibrated(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """The lexicon with a logistic fit of the sample's labels to the log of the sums, slightly drawn to its start."""
    rows = raws(sample, lexicon, ["toxic"]).collect()  # bounded as the sample is
    x = np.log1p(np.array([r["raw"] for r in rows]))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    a, b = lexicon.bias, lexicon.slope
    prior = np.array([a, b])
    design = np.stack([np.ones_like(x), x], axis=1)
    theta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - 0.02 * (theta - prior)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.02 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    lexicon.bias, lexicon.slope = float(theta[0]), float(max(theta[1], 0.5))
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """At most so many labelled rows, by a hash of their doc_id; rows with crc32(doc_id) mod 3 = 1 are never taken."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    by_hash = F.xxhash64("doc_id")
    taken = [usable.filter(F.col("toxic") == v).orderBy(by_hash, "doc_id").limit(n) for v, n in ((1, toxic_rows), (0, clean_rows))]
    ids = taken[0].unionByName(taken[1])  # so many rows at most
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def score(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 6000) -> DataFrame:
    """Scores every row of docs(doc_id, text): doc_id, raw and score (0 to 1, higher: likelier toxic).

    The classifier is fitted on at most toxic_rows + clean_rows labelled rows. Null and empty texts have raw 0 and the
    score of a text without any insult; repeated rows are scored each; very long texts are read whole.
    """
    lexicon = learn(saved(training_rows(docs, labels, toxic_rows, clean_rows)))
    scorer = (lexicon.bias, lexicon.slope)
    scored = raws(docs.select(F.col("doc_id").cast("long"), "text"), lexicon, ["doc_id"])
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(scorer[0]) + F.lit(scorer[1]) * F.log1p("raw")))))
