"""Toxicity by a weighted finite-state pattern grammar.

Two transducers are composed. The lexical one reads letters and writes token
classes: INSULT and THREAT (lexicon entries with weights), TARGET, NEGATION,
REPORT, or nothing. An entry is a whole word or a stem that any letters may
follow. The grammar transducer reads the classes of one clause (text between
clause marks) and remembers in its state whether a target was named, whether
a negation was read within the last ``REACH`` words, and whether speech is
reported; at an insult or threat it writes the pattern (kind, target,
negation, report) with the entry's weight. So clauses are scored, not isolated
words: "he said you are an idiot", "you are no idiot" and "you idiot" are
different patterns with weights of their own.

A text's features are the summed weights per pattern (damped by a logarithm);
a logistic model scores them. Its pattern weights start from the grammar's own
(``PRIOR``: reported or negated clauses count less, aimed ones more) and are
fitted to labels with a pull towards these. The lexicon starts from the seeds
below and learns words and stems that occur in toxic and hardly in other
texts. Both are fitted on a bounded sample of labelled texts, about ``SAMPLE`` by
label; the lexicon has at most ``ENTRIES`` learned entries.

Style: Arrow batches; an Aho-Corasick automaton finds the entries in the whole
text and only clauses around a hit are read further. Unit counts of the sample
are summed by Spark; there is no shuffle of texts.

Edge cases: an entry may follow an apostrophe within a word (elision, single
quotes); null or empty text: no clause, the model's base score; very long
texts are read whole; a lexicon without training labels is the seeds; rows
that repeat are scored alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

SAMPLE = {0: 10_000, 1: 2_500}        # labelled texts, by label, used to fit (about)
ENTRIES = 500        # learned lexicon entries
STEM = (3, 8)        # lengths of stems that are tried
SUPPORT = 5          # toxic texts of the sample an entry needs
PURITY = 0.02        # non-toxic per toxic occurrence an entry may have
REACH = 3            # words a negation reaches
CLAUSE = 400         # characters to each side within which a clause mark is looked for

# Seeds of the grammar.
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting imbecile bastard".split()
THREATS = "kill hurt strangle stab shoot lynch".split()
TARGETS = set("you your yours u he she they them him her people du dich dir ihr euch sie tu te toi vous "
              "usted ustedes ti él ella".split())
NEGATIONS = set("not no never nobody neither nor isn't aren't don't won't kein keine nicht nie ne pas jamais "
                "nunca ni".split())
REPORTS = set("said says say told called calls wrote writes quoted claimed sagte sagt nannte schrieb dit "
              "écrit appelé dijo dice escribió llamó".split())

KINDS = 2                                  # insult, threat
PATTERNS = KINDS * 8                       # kind, target, negation, report
PRIOR = np.array([4.0 + 0.5 * bool(p & 4) - 1.0 * bool(p & 2) - 1.0 * bool(p & 1)
                  for p in range(8)] * KINDS + [-2.0])   # pattern = kind * 8 + target * 4 + negation * 2 + report
PULL = 0.1                                 # strength of the prior

MARK = ".,;:!?\n|()\"«»“”"


@dataclass
class Model:
    """entries: text -> (whole word, kind, weight); weights: per pattern, then the bias."""

    entries: dict[str, tuple[bool, int, float]]
    weights: np.ndarray


def seeds() -> dict[str, tuple[bool, int, float]]:
    return {w: (True, 0, 1.0) for w in INSULTS} | {w: (True, 1, 0.6) for w in THREATS}


class Grammar:
    """The composed transducers for one lexicon."""

    def __init__(self, entries: dict[str, tuple[bool, int, float]]) -> None:
        import ahocorasick
        import regex

        self.entries = entries
        self.find = ahocorasick.Automaton()
        for e in entries:
            self.find.add_word(e, e)
        self.find.make_automaton()
        self.word = regex.compile(r"[\p{L}\p{M}']+").finditer

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """Start of a word or of a part of it after an apostrophe -> (kind,
        weight) of the heaviest entry it matches."""
        out: dict[int, tuple[int, float]] = {}
        for last, entry in self.find.iter(text):
            start = last - len(entry) + 1
            whole, kind, weight = self.entries[entry]
            if start and text[start - 1].isalpha() or whole and text[last + 1:last + 2].isalpha():
                continue
            if start not in out or out[start][1] < weight:
                out[start] = (kind, weight)
        return out

    def features(self, text: str | None) -> np.ndarray:
        sums = np.zeros(PATTERNS)
        text = (text or "").lower()
        hits = self.hits(text) if text else {}
        done = 0                             # end of the last clause read
        for at in sorted(hits):
            if at < done:
                continue
            low = max(done, at - CLAUSE)
            begin = max([low, *(text.rfind(m, low, at) + 1 for m in MARK)])
            stops = [x for m in MARK if (x := text.find(m, at, at + CLAUSE)) >= 0]
            done = min(stops, default=min(len(text), at + CLAUSE))
            for pattern, weight in self.read(text, begin, done, hits):
                sums[pattern] += weight
        return np.log2(1 + sums)

    def read(self, text: str, begin: int, end: int, hits: dict[int, tuple[int, float]]) -> list[tuple[int, float]]:
        """The grammar transducer over one clause: patterns written, with weights."""
        target = report = False
        negated, out = 0, []
        for m in self.word(text, begin, end):
            word, first = m.group(), m.start()
            starts = [first, *(first + i + 1 for i, c in enumerate(word) if c == "'")] if "'" in word else [first]
            found = [hits[at] for at in starts if at in hits]     # also elided or quoted: "l'idiot", "'idiot'"
            word = word.strip("'")
            out.extend((kind * 8 + 2 * (negated > 0) + report, weight) for kind, weight in found)
            if word in TARGETS and not found:
                target = True
            elif word in REPORTS and not found:
                report = True
            negated = REACH + 1 if word in NEGATIONS else max(negated - 1, 0)
        return [(p + 4 * target, w) for p, w in out]     # a target may also follow: "idiots like you"


def _units(text: str, find) -> set[str]:  # noqa: ANN001
    """Words ("w word") and stems ("s stem") of a text, to be counted."""
    out = set()
    for w in set(find(text.lower())):
        if len(w) > STEM[0]:
            out.add("w " + w)
            out.update("s " + w[:k] for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return out


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[bool, int, float]]:
    """Entries that mark toxic texts, from rows (text, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(r"\p{L}+").findall
        for batch in batches:
            n = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[y].update(_units(text or "", find))
            units = [*(n[0] | n[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.string()), pa.array([n[1][u] for u in units], pa.int64()),
                 pa.array([n[0][u] for u in units], pa.int64())], names=["unit", "toxic", "other"])

    counts = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["y"]: r["n"] for r in counts}
    if not size.get(1) or not size.get(0):
        return {}
    odds = (F.col("other") / size[0]) / (F.col("toxic") / size[1])
    got = (sample.mapInArrow(run, "unit string, toxic bigint, other bigint")
           .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
           .where(F.col("toxic") >= SUPPORT).where(odds <= PURITY)
           .orderBy(F.desc("toxic"), "unit").limit(20 * ENTRIES).collect())
    n = {r["unit"]: r["toxic"] for r in got}
    stems = {u[2:]: c for u, c in n.items() if u[0] == "s"}
    beyond: Counter = Counter()             # stem -> support of the best entry that extends it
    for u, c in n.items():
        for k in range(STEM[0], len(u) - 1 if u[0] == "w" else len(u) - 2):
            beyond[u[2:2 + k]] = max(beyond[u[2:2 + k]], c)
    chosen: dict[str, int] = {}
    for u, c in n.items():
        body = u[2:]
        shorter = max((stems.get(body[:k], 0) for k in range(STEM[0], len(body))), default=0)
        # left out: a stem of it says more, or a more specific entry as much
        if shorter <= 1.05 * c and (u[0] == "w" or beyond[body] < 0.95 * c):
            chosen[u] = c
    best = sorted(chosen, key=lambda u: (-chosen[u], u))[:ENTRIES]
    # an entry seen in few texts weighs less
    return {u[2:]: (u[0] == "w", 0, min(1.0, 0.7 + chosen[u] / 100)) for u in best}


def _fit_weights(x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Logistic regression pulled towards PRIOR, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (importance * (p - y)) + PULL * (w - PRIOR)
        hess = (x * (importance * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and pattern weights from labels (doc_id, toxic)."""
    from .common import store

    sample, totals = labelled_sample(docs, labels, "toxic", SAMPLE)
    sample = store(sample, "toxicity-sample")
    entries = seeds()
    for e, v in learn_lexicon(sample).items():
        entries[e] = v if e not in entries else (True, entries[e][1], 1.0)
    grammar_entries = entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(grammar_entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([grammar.features(t) for t in batch.column(0).to_pylist()],
                                           pa.list_(pa.float64()))], names=["y", "x"])

    kind = dict(sample.dtypes)["y"]
    rows = sample.mapInArrow(run, f"y {kind}, x array<double>").collect()
    if not rows:
        return Model(entries, PRIOR.copy())
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    seen = Counter(y.tolist())
    weight = np.array([totals[int(v)] / seen[v] for v in y]) * len(y) / sum(totals.values())
    return Model(entries, _fit_weights(x, y, weight))


def score(docs: DataFrame, model: Model, extra: Column) -> DataFrame:
    """doc_id, extra, score, predicted, n_clauses (patterns with weight) of
    every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.entries)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, PATTERNS)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array((x > 0).sum(1).astype(np.int32))],
                names=["doc_id", "extra", "score", "predicted", "n_patterns"])

    return docs.select("text", "doc_id", extra.alias("extra")).mapInArrow(
        run, "doc_id bigint, extra boolean, score double, predicted int, n_patterns int")
