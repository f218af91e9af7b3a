"""Language identification: a linear model picks the family, one-versus-one linear SVMs the language within it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Texts, batches, column, filtered, id_and_text, trim
from terravane.llm.ngrams import letters
from terravane.llm.sampling import chosen, class_counts, fold

#: Families of related languages by ISO code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}
PAIRS, TRIPLES = 1 << 16, 1 << 16
SIZE = PAIRS + TRIPLES
NOTHING = SIZE
#: Labelled documents of each language that training reads at most (about; the bound of the sample).
PER_LANGUAGE = 1500
#: Score from which known_languages believes a prediction.
LEAST = 0.35


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the numbers of the pair and the triple that start there; NOTHING where they leave the text."""
    wide = data.astype(np.uint32)
    n = len(data)
    pairs, triples = np.full(n, NOTHING, np.int64), np.full(n, NOTHING, np.int64)
    if n > 1:
        pairs[:-1] = (wide[:-1] << 8) | wide[1:]
    if n > 2:
        three = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        triples[:-2] = PAIRS + ((three * np.uint32(2654435761)) >> np.uint32(16))
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    pairs[last], triples[last] = NOTHING, NOTHING
    last = bounds[1:][bounds[1:] - 1 > bounds[:-1]] - 2
    triples[last] = NOTHING
    return pairs, triples


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    count = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])
    low = data | 0x20
    found = count((low >= 0x61) & (low <= 0x7A)) > 0
    for i in np.flatnonzero(~found & (count(data >= 0x80) > 0)):
        found[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class LanguageModel:
    """weights: a column for each family (against the rest), then one for each pair of languages of a family."""

    families: list = field(default_factory=list)
    members: dict = field(default_factory=dict)
    pairs: list = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE + 1, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        data, bounds = letters(data, bounds)
        out = np.zeros((len(bounds) - 1, self.weights.shape[1]))
        if len(data):
            some = bounds[1:] > bounds[:-1]
            total = np.maximum(np.diff(bounds)[some] * 2 - 3, 1)[:, None]
            for f in features(data, bounds):
                out[some] += np.add.reduceat(self.weights[f], bounds[:-1][some], axis=0) / total
        return out + self.biases

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score (0 to 1: the family's share times the language's) for each text; und and 0 without letters."""
        n = len(bounds) - 1
        known = has_letter(data, bounds)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        m = self.margins(data, bounds)
        own = m[:, : len(self.families)] * 4
        own = np.exp(own - own.max(axis=1, keepdims=True))
        share = own / own.sum(axis=1, keepdims=True)
        which, score = share.argmax(axis=1), share.max(axis=1)
        langs = np.full(n, "und", object)
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero((which == k) & known), self.members[f]
            votes = np.zeros((len(rows), len(names)))
            for j, (a, b) in enumerate(self.pairs):
                if a in names:
                    p = 1 / (1 + np.exp(-4 * m[rows, len(self.families) + j]))
                    votes[:, names.index(a)] += (p >= 0.5) + p / 2
                    votes[:, names.index(b)] += (p < 0.5) + (1 - p) / 2
            best = votes.argmax(axis=1)
            langs[rows] = np.array(names, object)[best]
            if len(names) > 1:
                score[rows] *= votes[np.arange(len(rows)), best] / (1.5 * (len(names) - 1))
        score[~known] = 0
        return langs.tolist(), np.clip(score, 0, 1)


def linear_svm(rows: list, y: np.ndarray, cost: float = 10.0, passes: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge linear SVM by dual coordinate descent; rows: (indices, values) pairs."""
    w, bias = np.zeros(SIZE + 1), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(0)
    # the rarer side counts more, so that both sides weigh alike
    sides = {s: max(int((y == s).sum()), 1) for s in (-1, 1)}
    each = np.array([cost * len(rows) / (2 * sides[int(s)]) for s in y])
    diagonal = np.array([float(v @ v) + 1.0 for _, v in rows]) + 0.5 / each
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + bias) - 1 + alpha[i] * 0.5 / each[i]
            new = max(alpha[i] - g / diagonal[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def train_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2), per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the whole texts of a sample of about per_language rows of each language, outside the held-out fold.

    held_out: (folds, the fold that is not learnt from). The sample is chosen by a hash of the id. Rows
    without id, text or language are not learnt from; without any row the model knows no language. A row of the sample
    comes to the driver as at most SIZE counts, however long its text.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), held_out[0]) != held_out[1]))
    counts = class_counts(rows, "lang")
    spec = [("lang", pa.string()), ("place", pa.int64()), ("idx", pa.binary()), ("val", pa.binary())]

    @batches(spec)
    def extract(batch):
        texts = Texts(batch.column(0))
        out = []
        for i in range(len(texts)):
            data, bounds = letters(texts.data[texts.starts[i] : texts.ends[i]], np.array([0, texts.ends[i] - texts.starts[i]]))
            f = np.concatenate(features(data, bounds))
            idx, n = np.unique(f[f != NOTHING], return_counts=True)
            out.append((idx.astype("<i4").tobytes(), (n / max(2 * len(data) - 3, 1)).astype("<f4").tobytes()))
        return [batch.column(1), batch.column(2), [x for x, _ in out], [x for _, x in out]]

    sample = rows.where(F.col("text").isNotNull() & chosen(counts, "lang", per_language)).select("text", "lang", "doc_id")
    found = sample.mapInArrow(extract, "lang string, place long, idx binary, val binary").toArrow().combine_chunks()
    named, places = found.column(0).to_pylist(), found.column(1).to_pylist()
    idx, val = found.column(2).to_pylist(), found.column(3).to_pylist()
    order = sorted((i for i in range(len(idx)) if idx[i]), key=lambda i: (named[i], places[i], idx[i]))
    of = np.array([named[i] for i in order])
    langs = sorted(set(of.tolist()))
    if not langs:
        return LanguageModel()
    data = [(np.frombuffer(idx[i], "<i4"), np.frombuffer(val[i], "<f4")) for i in order]
    del found, idx, val
    mean = np.zeros(SIZE + 1)
    for i, v in data:
        mean[i] += v
    scale = 1 / np.sqrt(np.maximum(mean / len(data), 1e-6))
    data = [(i, (v * scale[i]).astype(np.float32)) for i, v in data]
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    fam = np.array([family_of(x) for x in of])
    pairs = [(a, b) for f in families for i, a in enumerate(members[f]) for b in members[f][i + 1 :]]
    fitted = [linear_svm(data, np.where(fam == f, 1, -1)) if len(families) > 1 else (np.zeros(SIZE + 1), 0.0) for f in families]
    for a, b in pairs:
        own = np.flatnonzero((of == a) | (of == b))
        fitted.append(linear_svm([data[i] for i in own], np.where(of[own] == a, 1, -1)))
    weights = np.column_stack([w * scale for w, _ in fitted]).astype(np.float32)
    weights[NOTHING] = 0
    del data
    trim()
    return LanguageModel(families, members, pairs, weights, np.array([b for _, b in fitted]))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Reads the whole text and nothing else. Null, empty and letterless texts are und with score 0;
    held_out is false for a null id; repeated rows come back as often as they occur.
    """
    spec = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the input

    @batches(spec)
    def identify(batch):
        texts, langs, scores = Texts(batch.column(2)), [], []
        for i, j in texts.pieces(1 << 18):
            own, score = shared.value.predict(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i])
            langs += own
            scores.append(score)
        return [batch.column(0), batch.column(1), langs, np.concatenate(scores)]

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce(fold(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(identify, "doc_id long, held_out boolean, lang_pred string, score double")


def known_languages(docs: DataFrame, model: LanguageModel, languages: list[str] | None = None, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of docs that are in one of the languages (None: any that the model has learnt), all columns as they are.

    A row stays if the language predicted for its text is among them with a score of at least `least`. Null, empty and letterless
    texts go. A model that has learnt no language rejects nothing else. Repeated rows stay or go together; ids are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: Texts) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for i, j in texts.pieces(1 << 18):
            data, bounds = texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i]
            if not shared.value.families:
                out[i:j] = has_letter(data, bounds)
                continue
            langs, score = shared.value.predict(data, bounds)
            out[i:j] = [x != "und" and s >= least and (languages is None or x in languages) for x, s in zip(langs, score, strict=True)]
        return out

    return filtered(docs, text_col, keep)


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Train on docs outside the held-out fold, then identify every row of docs."""
    return identify_languages(docs, train_languages(docs, **options))
