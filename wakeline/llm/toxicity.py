"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and the words' opening
letters, hashed to ``2**BITS`` columns; only columns that ``LEAST`` texts of the
sample have, and whose count among toxic texts is off by a chi-square of
``CHI_SQUARE``, carry weights.  The model scores

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

with x_i = 1 in the linear part and 1 / sqrt(number of terms) in the pairwise
part, so pairs of terms that matter only together (an insult and the group that
it names) have a weight of their own while long texts stay in scale.  It is fitted by
Adagrad on a bounded sample of labelled texts (``sample`` rows by hash order,
only the columns with weights come to the driver, no text) and sent to the executors as a
broadcast of fixed size; all texts are then scored in Arrow batches.

Defined results: null and empty texts have no terms and get the model's constant; without labelled
rows of both classes every score is the share of toxic labels (0 if there are none);
repeated rows give repeated results; a labelled id with several texts is learned from one of them (the first by its columns); of repeated labels of one id the toxic one
counts, null labels are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wakeline.llm.hashing import KEPT, slices
from wakeline.llm.shared import append_columns

BITS = 31  # hashed columns, as a power of two
LEAST = 4  # texts of the sample that a column with a weight occurs in
CHI_SQUARE = 11.0  # evidence in the sample that a column goes with either class
FACTORS = 4  # length of each term's pairwise vector
SAMPLE = 20_000  # most labelled texts that the model is fitted on
OPENING = 4  # letters of a word's opening
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*")


def _column(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % 2**BITS


class TermHash(dict):
    """Columns of a word and of its opening, packed into one integer; kept for the most part.

    With ``index``, a column's place in the model or else 2**32 - 1.
    """

    def __init__(self, index: dict[int, int] | None = None):
        self.index = index

    def __missing__(self, word: str) -> int:
        full, opening = _column(word), _column("^" + word[:OPENING])
        if self.index is not None:
            full, opening = self.index.get(full, 2**32 - 1), self.index.get(opening, 2**32 - 1)
        packed = full << 32 | opening
        if len(self) < KEPT:
            self[word] = packed
        return packed


def term_columns(text: str, seen: TermHash) -> np.ndarray:
    """The distinct columns of a whole text, sorted."""
    words = set(_WORD.findall(text.lower()))
    packed = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    both = np.unique(np.concatenate([packed >> np.uint64(32), packed & np.uint64(2**32 - 1)]))
    return both[both < 2**32 - 1].astype(np.int32)


class FactorizationMachine:
    def __init__(self, columns: np.ndarray, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.columns = columns  # hashed columns with a weight, sorted
        self.w0 = 0.0
        self.w = np.zeros(len(columns), np.float32)
        self.v = rng.normal(0, 0.1, (len(columns), factors)).astype(np.float32)

    def margins(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; ``starts`` has each row's first place in ``index`` and its end."""
        sizes = np.diff(starts)
        linear = np.add.reduceat(np.append(self.w[index], 0), starts[:-1]) * (sizes > 0)
        v = np.concatenate([self.v[index], np.zeros((1, self.v.shape[1]), np.float32)])
        sums = np.add.reduceat(v, starts[:-1]) * (sizes > 0)[:, None]
        squares = np.add.reduceat((v * v).sum(1), starts[:-1]) * (sizes > 0)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(1) - squares) / np.maximum(sizes, 1)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, steps: int = 3000, batch: int = 128, rate: float = 0.1, penalty: float = 2e-3) -> None:
        """Logistic loss with squared penalties, Adagrad, both classes of equal weight; rows hold places in ``columns``.

        ``steps`` batches at least, in whole passes over the rows.
        """
        rng = np.random.default_rng(11)
        share = labels.mean()
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        factors = self.v.shape[1]
        g0, gw, gv = 1.0, np.full(len(self.w), 0.1, np.float32), np.full(self.v.shape, 0.1, np.float32)
        for _ in range(max(5, -(-steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(rows[i]) for i in pick])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                index = np.concatenate([rows[i] for i in pick])
                p = 1 / (1 + np.exp(-np.clip(self.margins(index, starts), -30, 30)))
                error = ((p - labels[pick]) * weight[pick]).astype(np.float32)
                g = error.sum()
                g0 += g * g
                self.w0 -= rate * g / np.sqrt(g0)
                if not len(index):
                    continue
                row = np.repeat(np.arange(len(pick)), sizes)
                v = self.v[index]
                sums = np.stack([np.bincount(row, v[:, f], len(pick)) for f in range(factors)], 1)
                slope = (error / np.maximum(sizes, 1))[row][:, None] * (sums[row] - v)
                columns, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, error[row], len(columns)) + penalty * self.w[columns]
                dv = np.stack([np.bincount(back, slope[:, f], len(columns)) for f in range(factors)], 1) + penalty * self.v[columns]
                gw[columns] += dw * dw
                gv[columns] += dv * dv
                self.w[columns] -= rate * dw / np.sqrt(gw[columns])
                self.v[columns] -= rate * dv / np.sqrt(gv[columns])

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for start, end in slices([len(r) for r in rows], 500_000):
            own = rows[start:end]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int64)
            m = self.margins(np.concatenate(own), starts)
            out[start:end] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """Fit a model on at most ``sample`` labelled rows, those with the smallest hashes of their ids."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # The sample is bounded, so the texts need no shuffle to meet it.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = TermHash()
        for batch in batches:
            rows = [term_columns(t or "", seen) for t in batch["text"]]
            if rows:
                columns, place, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
                toxic = np.bincount(place, np.repeat(batch["y"].to_numpy() > 0, [len(r) for r in rows]), len(columns))
                yield pd.DataFrame({"c": columns, "n": n, "toxic": toxic.astype(np.int64)})

    totals = texts.agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("int")).alias("toxic")).first()
    n, share = totals["n"], (totals["toxic"] or 0) / max(totals["n"], 1)
    expected = F.col("n") * share
    counts = texts.mapInPandas(count, "c int, n long, toxic long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    telling = counts.where((F.col("n") >= LEAST) & (F.pow(F.col("toxic") - expected, 2) >= CHI_SQUARE * (1 - share) * expected))
    both = 0 < share < 1
    columns = np.array(sorted(r["c"] for r in telling.select("c").collect()) if both else [], np.int32)
    index = spark.sparkContext.broadcast({int(c): k for k, c in enumerate(columns)})

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = TermHash(index.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "x": [term_columns(t or "", seen) for t in batch["text"]]})

    model = FactorizationMachine(columns)
    if both:
        kind = docs.schema[id_col].dataType.simpleString()
        found = texts.mapInPandas(featurise, f"id {kind}, y int, x array<int>")
        found = found.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect()  # `sample` rows at most
        rows = sorted(((r["id"], r["y"], np.array(r["x"], np.int32)) for r in found), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        model.fit([r[2] for r in rows], np.array([float(r[1] > 0) for r in rows]))
    else:
        model.v[:] = 0
        model.w0 = 30.0 if n and share else -30.0
    return model


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        seen = TermHash({int(c): n for n, c in enumerate(model.columns)})
        return lambda texts: [model.probability([term_columns(t or "", seen) for t in texts])]

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return append_columns(picked, make, ["text"], [("score", DoubleType())]).drop("text").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labels that are not held out; a null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
