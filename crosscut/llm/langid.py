"""Language ID by error-correcting output codes.

Each language gets a codeword; for each bit a naive Bayes classifier over byte 2- and 3-grams (ASCII lower-cased,
other ASCII than letters as one space, 3-grams hashed into 65,536 cells) predicts it. Decoding picks the language
whose codeword has the least loss, each bit's logistic loss weighted by how well its classifier did on the fitting
sample, and flags a text as ambiguous when the runner-up comes close.

Fitting uses a bounded sample: of each language about `PER_LANGUAGE` labelled documents, chosen by a hash of their id.
Prediction reads whole texts and nothing but the text.

Defined results: `und`, score 0 and not ambiguous for a null text, a text without a letter, or a model without
languages; with one language all other texts get it; an empty table gives an empty result; ties go to the language
that comes first by code point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, give_back, lean, small_batches

PER_LANGUAGE = 1000
CELLS = 1 << 16
NONE = 2 * CELLS  # the cell of n-grams that cross texts or hold only spaces
SMOOTH = 0.5
SHARPNESS = 6.0
AMBIGUOUS = 0.15
LEAST = 0.5  # an ambiguous text of a lower score is rejected: no language has half of the probability
SLICE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the 2-gram and the 3-gram that begin at each byte."""
    x = np.concatenate((_FOLD[data], np.full(2, 32, np.uint8))).astype(np.uint32)
    two = x[:-2] << 8 | x[1:-1]
    three = (two << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(16)
    two, three = two.astype(np.int32), three.astype(np.int32) + CELLS
    blank = (x[:-2] == 32) & (x[1:-1] == 32)
    two[blank] = three[blank] = NONE
    ends = offs[1:][np.diff(offs) > 0]
    two[ends - 1] = three[ends - 1] = NONE
    three[np.maximum(ends - 2, 0)] = NONE
    return two, three


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all distinct splits up to 7 languages, else one against the rest and random splits."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        return np.where(bits[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(n)
    extra = np.stack([rng.permutation(n) < n // 2 for _ in range(4 * int(np.ceil(np.log2(n))))], 1)
    return np.where(np.concatenate((np.eye(n, dtype=bool), extra), 1), 1, -1).astype(np.int8)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # cell x bit; the last row is 0
    trust: np.ndarray  # by bit

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """text x bit: the mean log odds of the n-grams, shrunk for few of them."""
        out = np.zeros((len(offs) - 1, self.codes.shape[1]))
        full = np.flatnonzero(np.diff(offs))
        if not len(full) or not out.shape[1]:
            return out
        two, three = grams(data, offs)
        sums = np.add.reduceat(self.weights[two] + self.weights[three], offs[full], 0, dtype=np.float64)
        count = np.add.reduceat((two != NONE).astype(np.int64) + (three != NONE), offs[full])
        out[full] = sums / (count + 6.0)[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score and whether the runner-up is close."""
        loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.codes[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        close = top[:, -1] - top[:, -2] < AMBIGUOUS if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], close


def fit(texts: list[str], langs: list[str]) -> Model:
    names = tuple(sorted(set(langs), key=lambda s: s.encode()))
    codes = codewords(len(names))
    index = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), NONE + 1))
    y = np.array([index[x] for x in langs], np.int64)
    raw = [t.encode() for t in texts]
    for i in range(0, len(raw), 200):
        for k in set(y[i : i + 200].tolist()):
            part = [r for r, c in zip(raw[i : i + 200], y[i : i + 200], strict=True) if c == k]
            data = np.frombuffer(b"".join(part), np.uint8)
            for cells in grams(data, np.concatenate(([0], np.cumsum([len(r) for r in part])))) if len(data) else ():
                counts[k] += np.bincount(cells, minlength=NONE + 1)
    counts[:, NONE] = 0
    rate = (counts + SMOOTH / max(len(names), 1)) / (counts.sum(1, keepdims=True) + SMOOTH * 2 * CELLS / max(len(names), 1))
    weights = np.zeros((NONE + 1, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        weights[:NONE, b] = np.log(rate[codes[:, b] > 0].mean(0) / rate[codes[:, b] < 0].mean(0))[:NONE]
    model = Model(names, codes, weights, np.ones(codes.shape[1]))
    if codes.shape[1]:
        wrong = np.zeros(codes.shape[1])
        for i in range(0, len(raw), 200):
            part = raw[i : i + 200]
            data = np.frombuffer(b"".join(part), np.uint8)
            m = model.margins(data, np.concatenate(([0], np.cumsum([len(r) for r in part]))))
            wrong += (m * codes[y[i : i + 200]] <= 0).sum(0)
        err = (wrong + 0.5) / (len(raw) + 1)
        model = Model(names, codes, weights, np.clip(np.log((1 - err) / err), 0.1, 5) / 5)
    return model


def fit_on(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows of docs, from a sample bounded by language."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row per language
    if not sizes:
        return fit([], [])
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(share)
    pick = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 32)) < share * (1 << 32)
    rows = known.filter(pick).select(F.col(text_col), F.col(lang_col)).collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                data, offs = flat(b.column("body"))
                if model.langs:
                    best, score, close = model.decode(model.margins(data, offs))
                else:
                    best, score, close = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
                lost = ~np.asarray(b.column("letter").to_pylist(), bool)
                best[lost], score[lost], close[lost] = len(model.langs), 0, False
                if not model.langs:
                    best[:] = 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("flag"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(close)],
                    ["id", "flag", "lang_pred", "score", "ambiguous"],
                )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """id, lang_pred, score (0 to 1), ambiguous per row; flag: a boolean that is carried along as `flag`."""
    text = F.col(text_col)
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("body"), letter.alias("letter"), (F.lit(None).cast("boolean") if flag is None else flag).alias("flag")
    )
    return rows.mapInArrow(lean(_predict(model)), "id long, flag boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, that have a language; ambiguous ones need a score of `least`."""

    @F.arrow_udf("boolean")
    def good(body: pa.Array) -> pa.Array:
        out = np.zeros(len(body), bool)
        at = 0
        for part in by_bytes(pa.RecordBatch.from_arrays([body], ["body"]), "body", SLICE):
            n = part.num_rows
            if model.langs:
                _, score, close = model.decode(model.margins(*flat(part.column("body"))))
                out[at : at + n] = ~close | (score >= least)
            at += n
        give_back()
        return pa.array(out)

    small_batches(docs.sparkSession)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.filter(letter).filter(good(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(id_col: Column, of: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % of == fold, F.lit(False))
