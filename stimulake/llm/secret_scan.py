"""Secret scans by grammar inference.

Plain patterns label credentials of three kinds. From a bounded sample of distinct labelled values per kind a prefix tree over
character classes is built, and states whose futures are statistically compatible (Hoeffding bound on the share of every
class and of stopping, down both subtrees) are merged into a probabilistic automaton. Every other run of LEAST or more credential
characters, and what labelled spans leave of a run, is then a candidate: if an automaton gives its format a likelihood well above
that of the corpus' ordinary runs (a Markov chain over all of them), it is a span too.

Texts are scanned where they are, once to learn and once to find; only labelled values and class-pair counts are shuffled, summed
before, and written.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: The shortest labelled value, and so the shortest run that is scored.
LEAST = 8
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Labelled values per kind that the automata are fitted on, at most: those of the smallest hashes.
MAX_LABELLED = 400
#: Confidence of the merge test; likelihood of what a state has not seen; least log-likelihood ratio per character.
ALPHA, UNSEEN, MIN_RATIO = 0.01, 1e-3, 0.4


def _class_of(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.islower():
        return "a" if c <= "f" else "g"
    if c.isupper():
        return "A" if c <= "F" else "G"
    return c


CLASSES = {c: _class_of(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"}
TO_CLASS = str.maketrans(CLASSES)
N_CLASSES = len(set(CLASSES.values()))
END = "$"


def base_spans(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """Labelled spans (start, kind, end, value) in order, and the runs (start, end), without what spans cover."""
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    runs = []
    for r in RUN.finditer(text):
        run, at = r[0], r.start()
        if len(run) >= 32:
            spans += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(run)]
        if "AKIA" in run:
            spans += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(run)]
        runs.append((at, r.end()))
    spans.sort()
    if spans:
        runs = [piece for a, b in runs for piece in uncovered(a, b, spans)]
    return spans, runs


def uncovered(start: int, end: int, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """The pieces of a run that spans, in order, leave: of LEAST characters or more."""
    for s, _, e, _ in spans:
        if s < end and start < e:
            if s - start >= LEAST:
                yield start, s
            start = max(start, e)
    if end - start >= LEAST:
        yield start, end


def candidate(text: str, start: int, end: int) -> tuple[int, int]:
    """A run without the punctuation at its ends; = may close a value but not begin it."""
    while end > start and text[end - 1] in ".-_/":
        end -= 1
    while start < end and text[start] in ".-_/=":
        start += 1
    return start, end


# ---- automata ----


class Automaton:
    """A probabilistic automaton: for each state the counts and targets of its arcs, and how many values end there."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]

    def add(self, classes: str) -> None:
        s = 0
        for c in classes:
            self.count[s][c] += 1
            if c not in self.arcs[s]:
                self.arcs[s][c] = len(self.arcs)
                self.arcs.append({})
                self.count.append(Counter())
            s = self.arcs[s][c]
        self.count[s][END] += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states and all that follow could be samples of the same state."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.count[a], self.count[b]
            n, m = x.total(), y.total()
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in x.keys() | y.keys():
                if abs(x[c] / n - y[c] / m) > bound:
                    return False
                if c in self.arcs[a] and c in self.arcs[b]:
                    todo.append((self.arcs[a][c], self.arcs[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for c, t in self.arcs[b].items():
                if c in self.arcs[a]:
                    todo.append((self.arcs[a][c], t))
                else:
                    self.arcs[a][c] = t

    def infer(self) -> Automaton:
        """Merges compatible states: kept states in order of discovery, the rest tried against each of them."""
        kept = [0]
        fringe = [(0, c) for c in sorted(self.arcs[0])]
        while fringe:
            s, c = fringe.pop(0)
            t = self.arcs[s][c]
            if t in kept:
                continue
            for k in kept:
                if self.compatible(k, t):
                    self.arcs[s][c] = k
                    self.fold(k, t)
                    break
            else:
                kept.append(t)
            fringe = [(k, c) for k in kept for c in sorted(self.arcs[k]) if self.arcs[k][c] not in kept]
        return self

    def log_likelihood(self, classes: str) -> float:
        s, total = 0, 0.0
        for c in classes + END:
            n = self.count[s].total() if s is not None else 0
            seen = self.count[s][c] if n else 0
            total += math.log((1 - UNSEEN) * seen / n + UNSEEN / (N_CLASSES + 1) if n else 1 / (N_CLASSES + 1))
            s = self.arcs[s].get(c) if s is not None else None
        return total


@dataclass
class Formats:
    """The automata by kind, and the log-probabilities of class pairs among ordinary runs."""

    automata: dict[str, Automaton]
    pairs: dict[str, float]

    def kind(self, value: str) -> str | None:
        """The kind whose format the value has, if any."""
        classes = value.translate(TO_CLASS)
        if not self.automata or not classes:
            return None
        plain = sum(self.pairs[a + b] for a, b in zip(END + classes, classes + END))
        score, kind = max((a.log_likelihood(classes), k) for k, a in self.automata.items())
        return kind if (score - plain) / (len(classes) + 1) >= MIN_RATIO else None


def class_pairs(texts: list[str]) -> Counter:
    """How often class pairs stand in the candidates of texts, ends included."""
    pairs: Counter = Counter()
    for text in texts:
        for run in base_spans(text)[1]:
            a, e = candidate(text, *run)
            classes = END + text[a:e].translate(TO_CLASS) + END
            pairs.update(map("".join, zip(classes, classes[1:])))
    return pairs


def formats_of(labelled: list[tuple[str, str]], pairs: Counter) -> Formats:
    """The automata of labelled values (kind, value), beside the background that class pairs give."""
    automata = {}
    for kind in KINDS:
        values = sorted(v for k, v in labelled if k == kind)
        if values:
            automata[kind] = Automaton()
            for v in values:
                automata[kind].add(v.translate(TO_CLASS))
            automata[kind].infer()
    total: Counter = Counter()
    for p, n in pairs.items():
        total[p[0]] += n
    size = N_CLASSES + 1
    classes = [END, *sorted(set(CLASSES.values()))]
    return Formats(automata, {a + b: math.log((pairs[a + b] + 0.5) / (total[a] + 0.5 * size)) for a in classes for b in classes})


def learn_formats(docs: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Formats:
    """Fits the automata on at most max_labelled distinct labelled values per kind, and the background on all runs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            values = {(KINDS[k], v) for text in texts for _, k, _, v in base_spans(text)[0]}
            # A batch's smallest hashes are enough: what is not among them is not among all either.
            least = [(k, v, -1) for kind in KINDS for k, v in sorted((x for x in values if x[0] == kind), key=lambda x: _rank(x[1]))[:max_labelled]]
            found = least + [("pair", p, n) for p, n in class_pairs(texts).items()]
            yield pd.DataFrame(found, columns=["kind", "value", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(rows, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = materialize(found, "secret-values")  # read once per kind below, the texts only once
    both = found.where("kind = 'pair'")
    for kind in KINDS:
        both = both.unionByName(found.where(F.col("kind") == kind).orderBy(F.xxhash64(F.col("value")), "value").limit(max_labelled))
    rows_ = both.collect()  # at most max_labelled values per kind and the pairs of the few classes
    return formats_of([(r["kind"], r["value"]) for r in rows_ if r["kind"] != "pair"], Counter({r["value"]: r["n"] for r in rows_ if r["kind"] == "pair"}))


def _rank(value: str) -> int:
    """Spark's xxhash64 of a string, a signed long."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def scan_text(text: str, formats: Formats) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str, int]]]:
    """Labelled spans, and all spans (start, kind, end): labelled ones, then by format, in order."""
    spans, runs = base_spans(text)
    extra = []
    for run in runs:
        a, b = candidate(text, *run)
        if b - a >= LEAST and (kind := formats.kind(text[a:b])):
            extra.append((a, 3 + KINDS.index(kind), b))
    every = sorted([(s, k, e) for s, k, e, _ in spans] + extra)
    names = (*KINDS, *(f"like_{k}" for k in KINDS))
    return spans, [(s, names[k], e) for s, k, e in every]


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each stretch that spans cover replaced by ``<SECRET>``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "<SECRET>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, formats: Formats | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, comma-joined, labelled ones and those by format
    (like_assign, like_access, like_hex); base_sha256 is the SHA-256 of the labelled ones alone. Null texts count as empty. Null
    ids and repeated rows come back as they are; other columns are not read; an empty table gives an empty result.
    """
    formats = formats or learn_formats(docs, text_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for text in b.pop("__text"):
                base, every = scan_text(text or "", formats)
                n = Counter(k for _, k, _, _ in base)
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                done.append((n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every)))
            yield b.reset_index(drop=True).join(pd.DataFrame(done, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]))

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, formats: Formats | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their secrets replaced; length_col, if there, is set to the new length where the text changed.

    Null texts stay null, all other columns and all rows stay as they are.
    """
    formats = formats or learn_formats(docs, text_col)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, scan_text(t, formats)[1]))

    out = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out
