"""Language identification with hyperdimensional profiles.

Every symbol (a letter, or the edge of a word) has a random vector of +1 and -1.  An
n-gram binds its symbols' vectors, each rotated by its place, by multiplication; a text
bundles its n-grams by addition; a language's prototype bundles its training texts, each
scaled to length 1.  A text gets the language whose prototype has the greatest cosine.

Defined cases: null texts and texts without letters are ``und`` with score 0; a text counts as
standing between edges, so a single letter makes an n-gram; ties go to the smaller name; rows without a language are predicted but not learned from; without any
training row all are ``und``; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, char_tables, code_points, mix, text_slices

EDGE = 32


class Space:
    """Vectors of symbols and n-grams; n-gram vectors are kept while a task runs."""

    def __init__(self, dims: int, n: int, seed: int):
        self.dims, self.n, self.seed = dims, n, seed
        self.row: dict[int, int] = {}
        self.vectors = np.empty((1024, dims), np.float32)

    def symbol(self, cp: np.ndarray) -> np.ndarray:
        """+1 and -1 drawn from a hash of code point, place and seed."""
        words = mix(cp.astype(np.uint64)[:, None] * np.uint64(1 << 32)
                    + np.arange(self.dims // 64, dtype=np.uint64)[None, :] + np.uint64(self.seed) * np.uint64(1 << 56))
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(cp), -1), axis=1)
        return bits.astype(np.float32) * 2 - 1

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of n-grams packed 21 bits a symbol."""
        new = [c for c in codes.tolist() if c not in self.row]
        if new:
            if len(self.row) + len(new) > 1 << 16:  # forget, so that rare n-grams cannot fill the memory
                self.row, new = {}, codes.tolist()
            need = len(self.row) + len(new)
            if need > len(self.vectors):
                self.vectors = np.resize(self.vectors, (max(need, 2 * len(self.vectors)), self.dims))
            at, packed = len(self.row), np.array(new, np.uint64)
            made = np.ones((len(new), self.dims), np.float32)
            for place in range(self.n):
                cp = (packed >> np.uint64(21 * (self.n - 1 - place))) & np.uint64((1 << 21) - 1)
                letters, inverse = np.unique(cp, return_inverse=True)
                made *= np.roll(self.symbol(letters), self.n - 1 - place, axis=1)[inverse]
            self.vectors[at:need] = made
            self.row.update(zip(new, range(at, need)))
        return self.vectors[[self.row[c] for c in codes.tolist()]]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a vector per text, has it letters)."""
        cps, at = code_points(data, offs)
        cls, low = char_tables()
        size = np.diff(at) + 2  # an edge before and after each text, so that one letter makes an n-gram
        doc = np.repeat(np.arange(len(offs) - 1), size)
        start = np.cumsum(size) - size
        inner = np.ones(len(doc), bool)
        inner[start] = inner[start + size - 1] = False
        letter = np.zeros(len(doc), bool)
        letter[inner] = (cls[cps] == 1) | (cls[cps] == 2)
        sym = np.full(len(doc), EDGE, np.uint64)
        sym[inner] = np.where(letter[inner], low[cps], EDGE)
        has = np.bincount(doc[letter], minlength=len(offs) - 1) > 0
        keep = letter.copy()  # of several edges in a row one counts
        keep[1:] |= letter[:-1]
        keep[start] = has
        sym, doc = sym[keep], doc[keep]
        n = self.n
        out = np.zeros((len(offs) - 1, self.dims), np.float32)
        if len(sym) < n:
            return out, has
        code = np.zeros(len(sym) - n + 1, np.uint64)
        for place in range(n):
            code = code << np.uint64(21) | sym[place:len(sym) - n + 1 + place]
        inside = doc[n - 1:] == doc[:len(doc) - n + 1]
        code, doc = code[inside], doc[:len(doc) - n + 1][inside]
        grams, which = np.unique(code, return_inverse=True)
        step = max(1, (1 << 22) // max(1, len(grams)))
        for d in range(0, len(out), step):
            a, b = np.searchsorted(doc, [d, d + step])
            counts = np.bincount((doc[a:b] - d) * len(grams) + which[a:b], minlength=step * len(grams))
            used = np.flatnonzero(counts.reshape(step, -1).any(axis=0))
            part = counts.reshape(step, -1)[:len(out) - d, used].astype(np.float32)
            for i in range(0, len(used), 1 << 15):
                out[d:d + step] += part[:, i:i + (1 << 15)] @ self.grams(grams[used[i:i + (1 << 15)]])
        return out, has


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def prototypes(docs: DataFrame, dims: int = 1024, n: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """Language -> prototype from all rows of (lang, text); each task adds up its own rows, so
    one vector per language and task is shuffled, and one per language is collected."""
    def bundle(batches):
        space, sums = Space(dims, n, seed), {}
        for rows, data, offs in text_slices(batches, ["lang"], "text", 1 << 20):
            vec, has = space.texts(data, offs)
            langs = np.array(rows.column(0).to_pylist(), object)
            for lang in set(langs[has]):
                sums[lang] = sums.get(lang, 0) + unit(vec[has & (langs == lang)].astype(np.float64)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["lang", "sums"])

    rows = docs.select("lang", "text").where(F.col("lang").isNotNull())
    parts = arrow_map(rows, bundle, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("i", "x"))
    total = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got: dict[str, np.ndarray] = {}
    for r in total.collect():  # languages x dims numbers
        got.setdefault(r[0], np.zeros(dims))[r[1]] = r[2]
    return got


def predict(docs: DataFrame, models: dict[str, np.ndarray], dims: int = 1024, n: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names = sorted(models)
    table = unit(np.array([models[k] for k in names]).reshape(-1, dims)).astype(np.float32)

    def run(batches):
        space = Space(dims, n, seed)
        for rows, data, offs in text_slices(batches, ["doc_id"], "text", 1 << 20):
            vec, has = space.texts(data, offs)
            if names:
                cos = unit(vec) @ table.T
                best = cos.argmax(axis=1)
                score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).astype(float)
                pred = [names[b] if h else "und" for b, h in zip(best, has)]
            else:
                score, pred = np.zeros(len(has)), ["und"] * len(has)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")
