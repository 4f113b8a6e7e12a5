"""Language identification by hierarchical discrimination.

Linear support vector machines on hashed character 1- to 3-grams first tell the language families apart, one against one; within
the predicted family one-against-one machines separate its languages. A machine's margin is a mean of weights over a text's
n-grams, so whole texts are scored with table look-ups and sums, a block at a time.

The machines are fitted on at most ``max_labelled`` documents per language (those of the smallest id hashes), whose features are
made on the executors and kept sparse: what reaches the driver is bounded by that and by the number of hash bins. Prediction shuffles
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 14
BLOCK = 1 << 17
MAX_LABELLED = 400
UNKNOWN = "und"

#: Families of languages by code; languages that aren't listed are grouped by their n-grams.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr"),
}

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def gram_bins(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins of the n-grams at each place of the pieces, one row per order (0: no n-gram there), and where each piece begins.

    Letters count, all else is a space. A piece is lower-cased text with the number of places in it at which n-grams begin; two more
    characters follow those.
    """
    starts = np.cumsum([0] + [len(t) for t, _ in pieces[:-1]])
    c = np.frombuffer("".join([*(t for t, _ in pieces), "  "]).encode("utf-32-le"), np.uint32)
    letter = _is_letter(c)
    c = np.where(letter, c, 32).astype(np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    two, n = letter[:-2] | letter[1:-1], len(a)
    bins = np.zeros((3, n), np.int32)
    for k, (key, there) in enumerate(((a, letter[:-2]), (a << np.uint64(21) | b, two), (a << np.uint64(42) | b << np.uint64(21) | d, two))):
        h = (key + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        bins[k] = np.where(there, (h >> np.uint64(33)) % np.uint64(BINS - 1) + np.uint64(1), 0)
    for at, (_, own) in zip(starts.tolist(), pieces):
        bins[:, at + own : at + own + 2] = 0  # those begin in the next piece or beyond the text
    return bins, starts


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[str, int]]]]:
    """Texts, with a space before and after, in blocks of bounded size: indices and pieces; a long text is cut into several pieces that
    overlap by two characters, so that each of its n-grams begins in exactly one."""
    at: list[int] = []
    pieces: list[tuple[str, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t = f" {t.lower()} "
        own = len(t) - 1  # nothing begins at the last space
        t += " "
        for k in range(0, own, BLOCK):
            n = min(BLOCK, own - k)
            if size + n > BLOCK and pieces:
                yield np.array(at), pieces
                at, pieces, size = [], [], 0
            at.append(i)
            pieces.append((t[k : k + n + 2], n))
            size += n
    if pieces:
        yield np.array(at), pieces


@dataclass
class Machines:
    """One-against-one machines between classes: weights per bin and pair, a bias per pair."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def chances(self, margins: np.ndarray) -> np.ndarray:
        """Per class its mean chance of winning over its own machines: 1 for a sure winner, however many classes there are."""
        won = np.zeros((len(margins), len(self.classes)))
        if not self.pairs:
            return won + 1
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -30, 30)))
            won[:, i] += p
            won[:, j] += 1 - p
        return won / (len(self.classes) - 1)


#: Features of rows: bins and shares end to end, and where each row begins.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit_pair(x: Sparse, rows: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Bins, their weights and the bias of a squared-hinge machine, by accelerated gradient steps, both sides with the same weight.

    Only these rows, over the bins they use, are laid out in full.
    """
    bins, shares, begins = x
    y = y.astype(np.float32)
    at = [slice(begins[r], begins[r + 1]) for r in rows]
    used, where = np.unique(np.concatenate([bins[a] for a in at]), return_inverse=True)
    z = np.zeros((len(rows), len(used)), np.float32)
    z[np.repeat(np.arange(len(rows)), [a.stop - a.start for a in at]), where] = np.concatenate([shares[a] for a in at])
    scale = 1 / np.sqrt(z.mean(axis=0) + np.float32(1e-6))
    z = np.concatenate((z * scale, np.ones((len(rows), 1), np.float32)), axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.full(z.shape[1], z.shape[1] ** -0.5, np.float32)
    for _ in range(20):  # largest curvature
        v = z.T @ (share * (z @ v))
        top = np.linalg.norm(v)
        v /= top
    w = u = np.zeros(z.shape[1], np.float32)
    rate = np.float32(1 / (2.2 * top + penalty))
    for step in range(steps):
        gap = np.maximum(0, 1 - y * (z @ u))
        new = u - rate * (-2 * z.T @ (share * y * gap) + np.float32(penalty) * u)
        u, w = new + np.float32(step / (step + 3)) * (new - w), new
    return used, w[:-1] * scale, float(w[-1])


def contests(labels: np.ndarray, family_of: dict[str, str], per_class: int) -> list[tuple[str, str, str, np.ndarray, np.ndarray]]:
    """(family or '' for those among families, class, class, rows, sides) of all machines: per_class rows a class at most, in order, dealt
    out evenly over a family's languages."""
    found = []
    by_lang = {lang: np.flatnonzero(labels == lang) for lang in family_of}
    members: dict[str, list[str]] = {}
    for lang, family in sorted(family_of.items()):
        members.setdefault(family, []).append(lang)
    rows_of = {f: np.concatenate([by_lang[lang][: max(1, per_class // len(langs))] for lang in langs]) for f, langs in members.items()}
    groups = [("", sorted(members), rows_of)] + [(f, langs, {lang: by_lang[lang][:per_class] for lang in langs}) for f, langs in sorted(members.items())]
    for name, classes, rows in groups:
        for a, b in combinations(classes, 2):
            found.append((name, a, b, np.concatenate((rows[a], rows[b])), np.repeat((1, -1), (len(rows[a]), len(rows[b])))))
    return found


def grouped(labels: np.ndarray, x: Sparse, families: dict[str, tuple[str, ...]], largest: int = 8) -> dict[str, str]:
    """The family of each language: that of the list, or, for languages that aren't listed, groups of up to ``largest`` with alike n-grams.

    So the number of machines stays far below one for each two of all languages.
    """
    bins, shares, begins = x
    family_of, made = {}, []
    for lang in sorted(set(labels.tolist())):
        listed = next((f for f, langs in families.items() if lang in langs), None)
        if listed is None:
            mean = np.zeros(BINS)
            for r in np.flatnonzero(labels == lang):
                mean[bins[begins[r] : begins[r + 1]]] += shares[begins[r] : begins[r + 1]]
            mean /= np.linalg.norm(mean)
            near = [(float(mean @ m), k) for k, (_, m, n) in enumerate(made) if n < largest]
            if near and max(near)[0] > 0.5:
                k = max(near)[1]
                made[k][2] += 1
            else:
                k = len(made)
                made.append([lang, mean, 1])
            listed = made[k][0]
        family_of[lang] = listed
    return family_of


@dataclass
class LanguageModel:
    families: Machines
    languages: dict[str, Machines]

    def _margins(self, m: Machines, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins per text and pair, and each text's number of n-grams."""
        total, count = np.zeros((len(texts), len(m.pairs))), np.zeros(len(texts))
        for at, pieces in blocks(texts):
            bins, starts = gram_bins(pieces)
            np.add.at(count, at, np.add.reduceat((bins > 0).sum(axis=0), starts))
            for k in range(len(m.pairs)):
                w = np.ascontiguousarray(m.weights[:, k])
                place = w[bins[0]] + w[bins[1]] + w[bins[2]]
                np.add.at(total[:, k], at, np.add.reduceat(place, starts, dtype=np.float64))
        return total / np.maximum(count, 1)[:, None] + m.bias, count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margins, count = self._margins(self.families, texts)
        chances = self.families.chances(margins)
        family, score = chances.argmax(axis=1), chances.max(axis=1)
        said = np.full(len(texts), UNKNOWN, object)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero((family == f) & (count > 0))
            m = self.languages[name]
            if len(rows):
                inner = m.chances(self._margins(m, [texts[i] for i in rows])[0] if m.pairs else np.zeros((len(rows), 0)))
                said[rows] = np.array(m.classes, object)[inner.argmax(axis=1)]
                score[rows] *= inner.max(axis=1)
        score[count == 0] = 0.0
        return said.tolist(), score


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", max_labelled: int = MAX_LABELLED, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel | None:
    """Fits on labelled rows (non-null language, a letter in the text) that aren't held out; None if there are none.

    Machines are fitted side by side on the executors, each on at most max_labelled rows of either class.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, found = b["text"].tolist(), []
            for lang, h, text in zip(b["lang"], b["h"], texts):
                counts = np.zeros(BINS)
                for _, pieces in blocks([text]):
                    counts += np.bincount(gram_bins(pieces)[0].ravel(), minlength=BINS)
                counts[0] = 0
                if counts.any():
                    i = np.flatnonzero(counts)
                    found.append((lang, h, i, counts[i] / counts.sum()))
            yield pd.DataFrame(found, columns=["lang", "h", "bins", "shares"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    least = d.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= max_labelled)
    # The greatest hash taken per language: one row per language.
    limits = least.groupBy("lang").agg(F.max("h").alias("limit")).collect()
    if not limits:
        return None
    taken = F.lit(False)
    for r in limits:
        taken = taken | ((F.col("lang") == r["lang"]) & (F.col("h") <= r["limit"]))
    per_lang = Window.partitionBy("lang").orderBy("h", "text")  # null or repeated ids share a hash
    sample = d.where(taken).withColumn("n", F.row_number().over(per_lang)).where(F.col("n") <= max_labelled)
    got = sample.select("lang", "h", "text").mapInPandas(rows, "lang string, h long, bins array<int>, shares array<float>").toPandas()
    got = got.sort_values("h", kind="stable").reset_index(drop=True)
    if not len(got):
        return None
    labels = got["lang"].to_numpy(str)
    x = (np.concatenate(got["bins"]), np.concatenate(got["shares"]), np.concatenate(([0], np.cumsum([len(b) for b in got["bins"]]))))
    family_of = grouped(labels, x, families)
    pairs = contests(labels, family_of, max_labelled)
    shipped = docs.sparkSession.sparkContext.broadcast((x, [p[3:] for p in pairs]))  # max_labelled rows a language

    def machines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sparse, sides = shipped.value
            for k in b["id"]:
                used, w, bias = fit_pair(sparse, *sides[k])
                yield pd.DataFrame({"k": [k], "bins": [used], "weights": [w], "bias": [bias]})

    fitted = {r["k"]: r for r in docs.sparkSession.range(0, len(pairs), 1, min(max(1, len(pairs)), 512)).mapInPandas(machines, "k long, bins array<int>, weights array<float>, bias double").collect()}

    def put(name: str, classes: list[str]) -> Machines:
        own = [k for k, p in enumerate(pairs) if p[0] == name]
        weights = np.zeros((BINS, len(own)), np.float32)
        for c, k in enumerate(own):
            weights[fitted[k]["bins"], c] = fitted[k]["weights"]
        at = {c: i for i, c in enumerate(classes)}
        return Machines(classes, [(at[pairs[k][1]], at[pairs[k][2]]) for k in own], weights, np.array([fitted[k]["bias"] for k in own]))

    names = sorted(set(family_of.values()))
    return LanguageModel(put("", names), {f: put(f, sorted(k for k, v in family_of.items() if v == f)) for f in names})


def identify(docs: DataFrame, model: LanguageModel | None = None, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The model is fitted on ``docs`` unless given. A text that is null or has no letter is ``und`` with score 0, as is every text if
    there is nothing to learn from. score is the family's mean chance of winning times the language's within it. Null ids and repeated rows come
    back as they are; other columns are not read. An empty table gives an empty result.
    """
    model = model or fit(docs, text_col, id_col, lang_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b.pop("text")]
            lang, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), 0.0)
            yield b.assign(lang_pred=lang, score=score)

    d = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, min_score: float = 0.4, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is told with at least ``min_score``; texts without letters go. Columns stay as they are."""
    model = model or fit(docs, text_col, id_col, lang_col)

    @F.pandas_udf("double")
    def certainty(texts: pd.Series) -> pd.Series:
        said, score = model.predict([t or "" for t in texts]) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        return pd.Series(np.where(np.array(said, object) == UNKNOWN, -1.0, score))

    return docs.where(certainty(F.col(text_col).cast("string")) >= min_score)
