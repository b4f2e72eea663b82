"""Language identification by hierarchical discrimination.

A family is predicted first, then one-versus-one linear support vector machines separate the
languages inside it. Both levels use the same machines: a linear SVM with squared hinge loss on
hashed letter n-grams of the whole text.

Fitting takes a bounded sample: about ``per_lang`` labelled rows of each language, chosen by a
hash of the key (all rows where a language has fewer). Features are made by the tasks, each
machine is fitted in a task of its own, and only the weights (4 bytes x ``DIM`` for each pair)
reach the driver. Prediction is one pass without a shuffle.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0. Rows without a
language, or whose key is null, are not learned from. With one language learned every text with
a letter gets it, with score 1; with none every text gets ``und``. Repeated rows get the same
answer. Columns of the input other than the named ones are never read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import U, WEIGHTS, chunks, mix, small_batches, tidied

#: Branches of the ISO 639-1 codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
DIM = 4096
PER_LANG = 600
ROWS = 512
MOST_LANGS = 400
UNKNOWN = "und"


def family_of(lang: str) -> str:
    """The family of a code; a language outside the table is a family of its own."""
    return next((f for f, codes in FAMILIES.items() if lang.lower()[:2] in codes), lang)


def _letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and single gaps; bytes above 127 count as letters."""
    c = buf.copy()
    upper = (c >= 65) & (c <= 90)
    c[upper] += 32
    latin = np.zeros(len(c), bool)
    latin[1:] = (c[:-1] == 0xC3) & (c[1:] < 0x9F) & (c[1:] >= 0x80) & (c[1:] != 0x97)
    c[latin] += 32
    gap = ~(((c >= 97) & (c <= 122)) | (c >= 128))
    c[gap] = 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return c[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root counts of hashed runs of 1 to 4 letters, one unit-length row for each text."""
    c, at = _letters(buf, offs)
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros(n * DIM, np.float32)
    code = c.astype(U)
    for k in range(1, 5):
        m = len(c) - k + 1
        if m <= 0:
            break
        g = code[:m].copy()
        for i in range(1, k):
            g = g * WEIGHTS[i] + code[i:m + i]
        slot = (mix(g + U(k)) >> U(52)).astype(np.int64)
        same = row[:m] == row[k - 1:]
        out += np.bincount(row[:m][same] * DIM + slot[same], minlength=n * DIM)
    x = np.sqrt(out.reshape(n, DIM))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    count = np.concatenate(([0], np.cumsum(ascii_letter)))
    found = np.diff(count[offs]) > 0
    for i in np.flatnonzero(~found):
        text = buf[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(ch.isalpha() for ch in text)
    return found


def _fit(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 200) -> np.ndarray:
    """Squared-hinge SVM by accelerated gradient; the last weight is the bias. Classes weigh
    the same however many rows they have."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c * 20
    weigh = weigh.astype(np.float32)
    rate = np.float32(1.0 / (1.0 + 4 * weigh.sum()))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        short = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (v - 2 * (x.T @ (weigh * y * short)))
        v = step + np.float32(t / (t + 3)) * (step - w)
        w = step
    return w


class Model:
    """Machines by level: ``pairs[level]`` is a list of (a, b, weights); a positive margin
    speaks for ``a``. ``level`` is "" for families, else the family."""

    def __init__(self, langs: list[str], pairs: dict[str, list[tuple[str, str, np.ndarray]]]):
        self.groups: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.groups.setdefault(family_of(lang), []).append(lang)
        self.pairs = pairs

    def _vote(self, x: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most wins (then the largest margins) and its share."""
        wins = np.zeros((len(x), len(names)))
        margins = np.zeros((len(x), len(names)))
        for a, b, w in self.pairs.get(level, []):
            i, j = names.index(a), names.index(b)
            m = x @ w[:-1] + w[-1]
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            margins[:, i] += m
            margins[:, j] -= m
        best = np.argmax(wins + np.tanh(margins) / 4, axis=1)
        odds = np.exp(2 * np.clip(margins, -20, 20))
        share = odds[np.arange(len(x)), best] / odds.sum(axis=1)
        return best, share

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted(self.groups)
        if not families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        best, score = self._vote(x, "", families)
        out = np.empty(len(x), object)
        for i, f in enumerate(families):
            at = np.flatnonzero(best == i)
            if len(at):
                k, share = self._vote(x[at], f, self.groups[f])
                out[at] = np.array(self.groups[f], object)[k]
                score[at] *= share
        return list(out), score


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
        lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on a bounded sample of the rows where ``learn`` holds."""
    rows = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"),
                                      F.col(lang).alias("l"), learn.alias("use")).where(
        "use and l is not null and t is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("k").alias("n"))
              .where("n > 0").limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: is {lang} a language column?")
    groups = Model(list(counts), {}).groups
    jobs = []
    families = sorted(groups)
    for level, names in [("", families), *groups.items()]:
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                side = {a: groups[a], b: groups[b]} if level == "" else {a: [a], b: [b]}
                jobs += [(level, a, b, x, s) for n, s in ((a, 1), (b, -1)) for x in side[n]]
    if not jobs:
        return Model(list(counts), {})
    spark = docs.sparkSession
    share = spark.createDataFrame([(x, min(1.0, per_lang / n)) for x, n in counts.items()],
                                  "l string, share double")
    chosen = rows.join(F.broadcast(share), "l").where(
        "pmod(xxhash64(k), 1000000) < share * 1000000").select("l", "t")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            langs = b.column("l")
            for row, buf, offs in chunks(b.column("t"), rows=ROWS):
                x = features(buf, offs).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [langs.slice(row, len(x)), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["l", "x"])

    def machine(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows.x), np.float32).reshape(-1, DIM)
        w = _fit(x, rows.side.to_numpy(np.float64))
        return rows[["level", "a", "b"]].head(1).assign(w=w.tobytes())

    to = spark.createDataFrame(jobs, "level string, a string, b string, l string, side int")
    fitted = (chosen.mapInArrow(featured, "l string, x binary").join(F.broadcast(to), "l")
              .groupBy("level", "a", "b")
              .applyInPandas(machine, "level string, a string, b string, w binary")).collect()
    pairs: dict[str, list[tuple[str, str, np.ndarray]]] = {}
    for r in sorted(fitted, key=lambda r: (r.level, r.a, r.b)):
        pairs.setdefault(r.level, []).append((r.a, r.b, np.frombuffer(r.w, np.float32)))
    return Model(list(counts), pairs)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A text that is kept anyway goes to Python once.
    read = f"k{keep.index(text)}" if text in keep else "t"
    frame = small_batches(docs).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                        *[F.col(text).alias("t")] * (text not in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            names: list[str] = []
            scores = [np.zeros(0)]
            for _, buf, offs in chunks(b.column(read), rows=ROWS):
                lang, score = shared.value.predict(features(buf, offs))
                known = has_letter(buf, offs)
                names += [x if ok else UNKNOWN for x, ok in zip(lang, known)]
                scores.append(np.where(known, score, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f"k{i}") for i in range(len(keep))], pa.array(names, pa.string()),
                 pa.array(np.concatenate(scores), pa.float64())],
                names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    kinds = dict(frame.dtypes)
    schema = ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep)))
    out = frame.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      "lang_pred", "score")


def held_out(key: str = "doc_id") -> Column:
    """The fold kept from learning; a null key is in neither fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Fit on one fold and predict every row."""
    learn = F.col("doc_id").isNotNull() & ~held_out()
    out = predict(docs, fit(docs, learn), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
