"""Language identification by character language models, one for each language.

Models are interpolated Kneser-Ney of ORDER characters over lower-case letters, anything else being one space. Each
order keeps the hashes of its n-grams, sorted, and beside them a matrix of probabilities, a column for each language,
and likewise its contexts with the weight each language gives to the order below. A text gets the language of the
lowest cross-entropy per character.

The models learn from a bounded sample of the labelled texts (SAMPLE distinct texts of each language, those of least
digests); a fifth of it is kept apart to calibrate the score and the level of rejection.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.pretokens import LETTER, code_points, tables
from foliant.llm.words import Runs, mix

#: Texts of each language that the models learn from, at most.
SAMPLE = 600
ORDER = 4
DISCOUNT = 0.75
#: A text is rejected if its cross-entropy is over the calibration texts' greatest by more than this share.
SLACK = 0.25
_lower: list[np.ndarray] = []
GRAMS = "lang int, size int, gram long, context long, suffix long, n long"


def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or 0 if it is no letter."""
    if not _lower:
        kinds, _ = tables()
        table = np.zeros(0x110000, np.int32)
        for cp in np.flatnonzero(kinds == LETTER):
            low = chr(cp).lower()
            table[cp] = ord(low) if len(low) == 1 else cp
        table[[i for i in np.flatnonzero(table) if unicodedata.category(chr(i))[0] != "L"]] = 0
        _lower.append(table)
    return _lower[0]


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with single spaces (0) between and before, each text's range of them, each text's number of letters."""
    cp, at = code_points(data)
    bounds = np.searchsorted(at, offs)
    s = _letters()[cp]
    n = len(offs) - 1
    wide = np.zeros(len(s) + n, np.int32)  # one space before each text
    wide[np.arange(len(s)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))] = s
    starts = bounds[:-1] + np.arange(n)
    keep = wide > 0
    if len(keep):
        keep[1:] |= wide[:-1] > 0
        keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(wide > 0)])
    ends = np.append(starts[1:], len(wide))
    return wide[keep], before[np.append(starts, len(wide))], letters[ends] - letters[starts]


def gram_hashes(s: np.ndarray, ranges: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place, text) of all symbols but the texts' first, and for each size the hash of the run that ends there.

    A run that would begin before its text has one more hash, of what there is: sizes differ in the hash's seed only.
    """
    text = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    runs = Runs(mix(s.astype(np.uint64) + np.uint64(1)))
    at = np.arange(len(s))
    first = ranges[:-1][text]
    hashes = [mix(runs(np.maximum(at + 1 - k, first), at + 1) ^ np.uint64(k * 0x9E37)) for k in range(order + 1)]
    inside = at > first
    return at[inside], text[inside], hashes


def count_grams(sample: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, size, gram, context, suffix, n) of a sample (lang, text): counted in each batch, then added up."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for whole in batches:
            for batch in c.slices(whole, "text", c.FINE_BYTES):
                s, ranges, _ = symbols(*c.flat(batch.column("text")))
                at, text, hashes = gram_hashes(s, ranges, ORDER)
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)[text]
                for k in range(1, ORDER + 1):
                    gram, context, suffix = hashes[k][at], hashes[k - 1][at - 1], hashes[k - 1][at]
                    _, first, n = np.unique(mix(gram ^ (lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
                    columns = [pa.array(lang[first].astype(np.int32)), pa.array(np.full(len(first), k, np.int32)), *(pa.array(x[first].view(np.int64)) for x in (gram, context, suffix)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "gram", "context", "suffix", "n"])

    return sample.select("lang", "text").mapInArrow(run, GRAMS).groupBy("lang", "size", "gram", "context", "suffix").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hashes and matrices of each order, and what calibration found."""

    langs: list[str]
    grams: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    uniform: float
    sharpness: float = 8.0
    level: float = float("inf")

    def _probability(self, k: int, at: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Interpolated probability of each place's symbol by its k - 1 before it, a column for each language."""
        if k == 0:
            return np.full((len(at), len(self.langs)), self.uniform, np.float32)
        gram = hashes[k][at]
        i = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
        out = self.probabilities[k][i]
        miss = np.flatnonzero(self.grams[k][i] != gram)
        if len(miss):
            context = hashes[k - 1][at[miss] - 1]
            j = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            weight = np.where((self.contexts[k][j] == context)[:, None], self.weights[k][j], np.float32(1))
            out[miss] = weight * self._probability(k - 1, at[miss], hashes)
        return out

    def entropies(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol in nats, a row for each text; each text's number of letters."""
        s, ranges, letters = symbols(data, offs)
        at, text, hashes = gram_hashes(s, ranges, ORDER)
        logs = np.empty((len(at), len(self.langs)), np.float32)
        for a in range(0, len(at), 1 << 16):
            logs[a : a + (1 << 16)] = -np.log(self._probability(ORDER, at[a : a + (1 << 16)], hashes))
        n = np.bincount(text, minlength=len(offs) - 1)
        sums = np.stack([np.bincount(text, logs[:, i], len(offs) - 1) for i in range(len(self.langs))], axis=1)
        return sums / np.maximum(n, 1)[:, None], letters

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether a text is rejected; und, 0 and True for a text without letters."""
        h, letters = self.entropies(data, offs)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp(-self.sharpness * (h - least[:, None])).sum(axis=1)
        none = letters == 0
        return [("und" if x else self.langs[i]) for i, x in zip(best, none)], np.where(none, 0.0, score), none | (least > self.level)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(which, v, len(distinct)) for v in values)


def build(langs: list[str], table: pa.Table) -> Model:
    """Interpolated Kneser-Ney models from counted n-grams."""
    rows = {k: table.column(k).to_numpy() for k in ("lang", "size", "gram", "context", "suffix", "n")}
    rows |= {k: rows[k].view(np.uint64) for k in ("gram", "context", "suffix")}
    symbols_seen = len(np.unique(rows["gram"][rows["size"] == 1]))
    model = Model(langs, [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], 1 / (symbols_seen + 2))
    for k in range(1, ORDER + 1):
        mine = {x: v[rows["size"] == k] for x, v in rows.items()}
        grams, first = np.unique(mine["gram"], return_index=True)
        contexts = np.unique(mine["context"])
        context_of = np.searchsorted(contexts, mine["context"][first])
        if k == 1:
            lower = np.full((len(grams), len(langs)), model.uniform)
        else:
            lower = model.probabilities[k - 1][np.searchsorted(model.grams[k - 1], mine["suffix"][first])]
        found, weights = lower.copy(), np.ones((len(contexts), len(langs)))
        for i in range(len(langs)):
            of = mine["lang"] == i
            gram, context, n = mine["gram"][of], mine["context"][of], mine["n"][of].astype(float)
            if k < ORDER:  # below the top, in how many contexts a run has been seen counts
                up = (rows["size"] == k + 1) & (rows["lang"] == i)
                suffix, kinds = _sum_by(rows["suffix"][up], np.ones(up.sum()))
                j = np.minimum(np.searchsorted(suffix, gram), max(len(suffix) - 1, 0))
                n = np.where(suffix[j] == gram, kinds[j], 1.0) if len(suffix) else np.ones(len(gram))
            seen, total, kinds = _sum_by(context, n, np.ones(len(n)))
            at = np.searchsorted(contexts, seen)
            weights[at, i] = DISCOUNT * kinds / total
            totals = np.zeros(len(contexts))
            totals[at] = total
            g = np.searchsorted(grams, gram)
            own = np.zeros(len(grams))
            own[g] = np.maximum(n - DISCOUNT, 0)
            known = totals[context_of] > 0
            found[:, i] = np.where(known, own / np.maximum(totals[context_of], 1e-9) + weights[context_of, i] * lower[:, i], lower[:, i])
        model.grams.append(grams)
        model.probabilities.append(found.astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(weights.astype(np.float32))
    return model


def calibrate(model: Model, texts: list[str], labels: list[str]) -> None:
    """Sharpness: of a grid, that with the highest likelihood of the labels. Level: the greatest entropy and SLACK."""
    arr = pa.array(texts, pa.string())
    h, letters = model.entropies(*c.flat(arr))
    truth = np.array([model.langs.index(x) for x in labels])
    h, truth = h[letters > 0], truth[letters > 0]
    if not len(h):
        return

    def loss(s: float) -> float:
        z = -s * (h - h.min(axis=1, keepdims=True))
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()) + 1e-4 * s

    model.sharpness = min((2.0**i for i in range(0, 7)), key=loss)
    model.level = float(h.min(axis=1).max() * (1 + SLACK))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models from the labelled texts that aren't held out; rows without text, language or id don't count."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.withColumn("digest", F.xxhash64("text"))
    texts = known.select("lang", "digest").distinct()  # copies count once, both for the rate and for the turns
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    # about twice as many as are needed, of any language, so that no language is ordered as a whole
    drawn = texts.join(sizes, "lang").where((F.col("digest") / F.lit(2.0**64) + 0.5) * F.col("texts") < 2 * SAMPLE)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    turns = drawn.withColumn("turn", turn).where(F.col("turn") <= SAMPLE)
    sample, _ = c.stored(known.join(turns, ["lang", "digest"]).groupBy("lang", "turn").agg(F.min("text").alias("text")), "languages")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    model = build(langs, count_grams(sample.where("turn % 5 <> 0"), langs).toArrow()) if langs else Model([], [], [], [], [], 1.0)
    if langs:
        apart = sample.where("turn % 5 = 0").select("lang", "text").collect()  # a fifth of SAMPLE for each language
        calibrate(model, [r.text for r in apart], [r.lang for r in apart])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if the model knows no
    language. rejected: also if the cross-entropy is over the calibrated level. score: the softmax share of the
    language at the calibrated sharpness. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE texts of each language

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in c.slices(whole, "text", c.FINE_BYTES):
                n = batch.num_rows
                lang, score, rejected = m.predict(*c.flat(batch.column("text"))) if m.langs else (["und"] * n, np.zeros(n), np.ones(n, bool))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is rejected: no letters, or a cross-entropy over the calibrated level."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE texts of each language

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in c.slices(whole, text_col, c.FINE_BYTES):
                if m.langs:
                    yield batch.filter(pa.array(~m.predict(*c.flat(batch.column(text_col)))[2]))

    return docs.mapInArrow(run, docs.schema)
