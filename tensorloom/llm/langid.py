"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram is the product of its
letters' vectors, each rotated by its place (binding); a text is the sum of its n-grams'
vectors (bundling), a language the sum of its training texts. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SIZE = 1024  # components of a vector
GRAM = 3
NONE = "und"
BLOCK = 64  # texts of one matrix product
STRETCH = 2048  # n-gram vectors of one matrix product
KEPT = 20_000  # n-gram vectors a worker keeps
#: letters get numbers below 2**16; rarer code points share one by their low bits
MASK = (1 << 16) - 1


@cache
def letter_numbers() -> np.ndarray:
    """A number from 1 to 65535 for every letter there is, 0 for other characters.

    Letters of the higher planes share the numbers of others.
    """
    return np.fromiter((min(((c - 1) & MASK) + 1, MASK) if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint16, 0x110000)


class Grams:
    """n-grams of letters as integers, and their bound vectors."""

    def __init__(self, size: int = SIZE, gram: int = GRAM, seed: int = 11):
        self.size, self.gram, self.seed = size, gram, seed
        self.table = letter_numbers()
        self.letters: dict[int, np.ndarray] = {}
        self.vectors: dict[int, np.ndarray] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-grams, counts); words are set apart by one space at each side."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        x = self.table[points].astype(np.int64)
        x = np.concatenate([[0], x, [0]])
        x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
        if len(x) < self.gram:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.zeros(len(x) - self.gram + 1, np.int64)
        for k in range(self.gram):
            code = (code << 16) | x[k : len(x) - self.gram + 1 + k]
        return np.unique(code, return_counts=True)

    def letter(self, number: int) -> np.ndarray:
        if number not in self.letters:
            bits = np.random.default_rng([self.seed, number]).integers(0, 2, self.size, dtype=np.int8)
            self.letters[number] = bits * 2 - 1
        return self.letters[number]

    def vector(self, code: int) -> np.ndarray:
        found = self.vectors.get(code)
        if found is None:
            found = np.ones(self.size, np.int8)
            for k in range(self.gram):
                found = found * np.roll(self.letter((code >> (16 * k)) & MASK), k)
            if len(self.vectors) >= KEPT:
                self.vectors.clear()
            self.vectors[code] = found
        return found

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row per text: the sum of its n-gram vectors."""
        codes = np.concatenate([c for c, _ in texts])
        counts = np.concatenate([n for _, n in texts])
        row = np.repeat(np.arange(len(texts)), [len(c) for c, _ in texts])
        names, column = np.unique(codes, return_inverse=True)
        out = np.zeros((len(texts), self.size), np.float32)
        for at in range(0, len(names), STRETCH):
            part = names[at : at + STRETCH]
            own = (column >= at) & (column < at + STRETCH)
            many = np.zeros((len(texts), len(part)), np.float32)
            many[row[own], column[own] - at] = counts[own]
            out += many @ np.stack([self.vector(c) for c in part.tolist()]).astype(np.float32)
        return out


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Documents no model learns from: crc32 of the id as text, modulo 4, is 2."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def learn_prototypes(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, np.ndarray]:
    """Language -> prototype over all given documents with a language and a text.

    Each task sums its own texts; partial sums meet per (language, stretch of components).
    The driver receives ``size`` numbers per language.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(size), {}
        for batch in batches:
            held: dict[str, list] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                found = grams.of(text.as_py())
                if len(found[0]):
                    held.setdefault(lang.as_py(), []).append(found)
            for lang, rows in held.items():
                codes, place = np.unique(np.concatenate([c for c, _ in rows]), return_inverse=True)
                n = np.bincount(place, np.concatenate([k for _, k in rows])).astype(np.int64)
                for at in range(0, len(codes), STRETCH):  # products in double precision: sums stay whole numbers
                    block = np.stack([grams.vector(c) for c in codes[at : at + STRETCH].tolist()]).astype(np.float64)
                    total[lang] = total.get(lang, 0) + n[at : at + STRETCH].astype(np.float64) @ block
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                ["lang", "total"],
            )

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    partial = usable.select(F.col(text_col), F.col(lang_col)).mapInArrow(sums, "lang string, total array<double>")
    summed = partial.select("lang", F.posexplode("total").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(rows, key=lambda r: r["lang"])}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that prototype (0 to 1).

    Null texts, texts without letters and an empty model give ``und`` with score 0. Ties go
    to the first language by name. Columns of these names are replaced; the others stay.
    """
    names = sorted(prototypes)
    frame = docs.drop("lang_pred", "score")
    out = StructType([*frame.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    model = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]) if names else None
    where = frame.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(size)
        for batch in batches:
            lang, score = [NONE] * batch.num_rows, np.zeros(batch.num_rows)
            held: list[tuple[int, tuple]] = []

            def judge() -> None:
                if held and model is not None:
                    sums = grams.bundle([f for _, f in held]).astype(np.float64)  # noqa: B023
                    norm = np.maximum(np.linalg.norm(sums, axis=1), 1e-300)
                    cosine = sums @ model.T / norm[:, None]
                    for (k, _), row in zip(held, cosine, strict=True):  # noqa: B023
                        best = int(np.argmax(row))
                        lang[k], score[k] = names[best], min(1.0, max(0.0, float(row[best])))  # noqa: B023
                held.clear()  # noqa: B023

            for k, text in enumerate(batch.column(where)):
                found = grams.of(text.as_py() or "")
                if len(found[0]):
                    held.append((k, found))
                    if len(held) == BLOCK:
                        judge()
            judge()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return frame.mapInArrow(predict, out)


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): learn from the documents that are not held out, judge all."""
    train = docs.where(~held_out(id_col))
    model = learn_prototypes(train, text_col=text_col, lang_col=lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict_language(narrow, model).drop("text")
