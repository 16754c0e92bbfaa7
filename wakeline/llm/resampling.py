"""Quality classifier by importance resampling with hashed n-gram models.

Two generative bag-of-n-grams models share ``2**BITS`` hashed buckets: one of the
target texts (labelled good) and one of the raw corpus (all documents).  A
text's importance is the mean log ratio of its n-grams' probabilities under both.  The
n-grams are words, word pairs, word shapes (``Aa.``, ``AA!!``, ``a%%%``) and pairs
of shapes, a repeated word counting as a pair of its own kind, so junk that no
vocabulary lists still shows.

Weights.  The ratio of the models' likelihoods itself is useless as a sampling weight for whole texts: its logarithm is a sum over
all n-grams, in the thousands, and lets length decide.  The weight is therefore normalised by length and tempered:
``exp(logit)`` with ``logit = (importance - boundary) / TEMPERATURE``, where the boundary
best separates labelled texts, so the logit stands for the log odds of a text being a target text.

Selection is Gumbel top-k: each text gets the key ``logit + Gumbel noise``, the noise being a function of id, text
and seed.  The k texts with the largest keys are a sample without replacement in proportion to exp(logit).  The sample
size is ``k``, or else the expected number of target texts: the sum of ``1 / (1 + exp(-logit))`` over all texts.  Texts
a few units around the k-th key are in or out by chance; far ones practically always the same way.

Corpus counts cover all documents; they meet in a vector of fixed size.  Only the boundary is
fitted on a bounded sample (``sample`` labelled ids by hash order).  The k-th
key is found exactly by narrowing a histogram, without sorting texts.

Defined results: null and empty texts have no n-grams and are never selected; without
labels of both kinds the boundary is 0 (raw and target alike); texts with the
same key as the k-th all stay, so repeated rows share their fate; ids may be
null; of several labels of one id the lowest counts, and of several texts of a labelled id the least important one sets the boundary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wakeline.llm.hashing import KEPT, mix, slices
from wakeline.llm.shared import append_columns, cut, fresh

BITS = 16  # hashed n-gram buckets, as a power of two
SAMPLE = 20_000  # most labelled texts that the boundary is fitted on
TEMPERATURE = 0.005  # importance (nats per n-gram) that one unit of the logit stands for
SEED = 17
_SLICE = 500_000  # characters handled together
_KINDS = [(regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{Ll}+|\p{Lo}+|\p{M}+"), "a"), (regex.compile(r"\p{N}+"), "0")]


def shape(word: str) -> str:
    """A word with each run of upper-case letters, other letters or digits as one sign."""
    for kind, sign in _KINDS:
        word = kind.sub(sign, word)
    return word[:12]


class NgramHash(dict):
    """Hashes of a word (48 bits) and of its shape (16 bits), packed into one integer; kept for the most part."""

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?").lower() or word
        packed = (xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass")) >> 16 << 16) | (
            xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass")) & 0xFFFF
        )
        if len(self) < KEPT:
            self[word] = packed
        return packed


def ngram_buckets(texts: list[str], seen: NgramHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each n-gram counted from it, bucket of each n-gram), slice by slice."""
    mask, low = np.uint64(2**BITS - 1), np.uint64(0xFFFF)
    for start, end in slices([len(t) for t in texts], _SLICE):
        words = [t.split() for t in texts[start:end]]
        sizes = np.array([len(w) for w in words])
        packed = np.fromiter((seen[w] for own in words for w in own), np.uint64, int(sizes.sum()))
        row = np.repeat(np.arange(end - start), sizes)
        word, form = packed >> np.uint64(16), packed & low
        pair = row[1:] == row[:-1]
        same = word[1:] == word[:-1]
        pairs = np.where(same, np.uint64(1), word[1:] * np.uint64(0x9E3779B97F4A7C15) + word[:-1])
        kinds = [word, form, pairs[pair], (form[1:] << np.uint64(16) | form[:-1])[pair]]
        rows = [row, row, row[1:][pair], row[1:][pair]]
        buckets = [mix(k + np.uint64(n << 60)) & mask for n, k in enumerate(kinds, 1)]
        yield start, np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


class Resampler:
    """The fitted log ratios and boundary; small and of fixed size."""

    def __init__(self, ratios: np.ndarray, boundary: float = 0.0):
        self.ratios, self.boundary = ratios, boundary

    def importance(self, texts: list[str], seen: NgramHash) -> np.ndarray:
        """Mean log ratio of each text's n-grams; NaN without any."""
        out = np.full(len(texts), np.nan)
        for start, row, bucket in ngram_buckets(texts, seen):
            if len(row):
                n = np.bincount(row)
                with np.errstate(invalid="ignore"):
                    out[start : start + len(n)] = np.bincount(row, self.ratios[bucket]) / n
        return out

    def keys(self, ids: list, texts: list[str], importance: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Logit and logit plus Gumbel noise; NaN for texts without n-grams."""
        logit = (importance - self.boundary) / TEMPERATURE
        h = np.array([xxhash.xxh3_64_intdigest(f"{i}\0{t}".encode("utf-8", "surrogatepass"), seed) for i, t in zip(ids, texts, strict=True)], np.uint64)
        uniform = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        return logit, logit - np.log(-np.log(uniform))


def _counts(texts: DataFrame) -> np.ndarray:
    """N-gram counts by bucket over all rows of a frame with a text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = NgramHash(), np.zeros(2**BITS, np.int64)
        for batch in batches:
            for _, _, bucket in ngram_buckets([t or "" for t in batch["text"]], seen):
                total += np.bincount(bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(2**BITS)
    for r in texts.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 2**BITS rows at most
        out[r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Resampler:
    """Models of good and of all texts, and the boundary between labelled good and bad texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    labelled = texts.join(F.broadcast(picked), "id")  # bounded by `sample`
    raw, target = _counts(texts.select("text")), _counts(labelled.where("good = 1").select("text"))
    if not target.sum() or not raw.sum():
        return Resampler(np.zeros(2**BITS))
    smooth = 1.0
    ratios = np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))
    shared = spark.sparkContext.broadcast(Resampler(ratios))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = NgramHash()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"] > 0, "s": shared.value.importance([t or "" for t in batch["text"]], seen)})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = labelled.mapInPandas(run, f"id {kind}, good boolean, s double").where(~F.isnan("s"))
    scored = scored.groupBy("id").agg(F.first("good").alias("good"), F.min("s").alias("s")).collect()  # `sample` rows at most
    good, bad = np.sort([r["s"] for r in scored if r["good"]]), np.sort([r["s"] for r in scored if not r["good"]])
    return Resampler(ratios, boundary(good, bad))


def boundary(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that errs least on both sorted classes, each by its share; halfway between its neighbours."""
    if not len(good) or not len(bad):
        return 0.0
    every = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[every[0] - 1], (every[1:] + every[:-1]) / 2, [every[-1] + 1]])
    wrong = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def keyed(docs: DataFrame, model: Resampler, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """Every row's id, or all its columns (``keep``), with importance, logit and Gumbel key, and the names of these three columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name, *names = fresh(docs, "id", "importance", "logit", "key")
    own = (docs if keep else docs.select(id_col, text_col)).withColumn(name, F.coalesce(F.col(id_col).cast("string"), F.lit("")))

    def make():
        seen, model_ = NgramHash(), shared.value

        def run(ids: list, texts: list) -> list[np.ndarray]:
            texts = [t or "" for t in texts]
            s = model_.importance(texts, seen)
            return [s, *model_.keys(ids, texts, s, seed)]

        return run

    out = append_columns(own, make, [name, text_col], [(n, DoubleType()) for n in names])
    return (out.drop(name) if keep else out.drop(name, text_col)), names


def expected_targets(scored: DataFrame, logit_col: str) -> int:
    """The expected number of target texts by their logits; whole millionths are summed, so the order of rows does not matter."""
    millionths = F.floor(1e6 / (1 + F.exp(-F.col(logit_col)))).cast("decimal(38,0)")
    return round((scored.where(~F.isnan(logit_col)).agg(F.sum(millionths)).first()[0] or 0) / 10**6)


def kth_largest(values: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest of a column of doubles (NaN and null left out); -inf if there are fewer.

    The doubles' bits are ordered integers; four histograms of 2**16 bins narrow them down.
    """

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = batch["v"].to_numpy(np.float64).view(np.int64)
            yield pd.DataFrame({"b": np.where(b < 0, b ^ np.int64(2**63 - 1), b)})

    b = values.select(F.col(col).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).mapInPandas(ordered, "b long")
    high = None
    for shift in (48, 32, 16, 0):
        own = b if high is None else b.where(F.shiftright("b", shift + 16) == high)
        bins = sorted(((r["bin"], r["n"]) for r in own.groupBy(F.shiftright("b", shift).alias("bin")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for bin_, n in bins:
            if k <= n:
                high = bin_
                break
            k -= n
        else:
            return -math.inf
    bits = np.int64(high)
    return float(np.array([bits ^ np.int64(2**63 - 1) if bits < 0 else bits], np.int64).view(np.float64)[0])


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, keep: bool = False, seed: int = SEED) -> DataFrame:
    """The sampled rows: id, importance, logit and gumbel_key, or the rows as they came (``keep``)."""
    model = fit(docs, labels, id_col, text_col)
    slim, (importance, logit, key) = keyed(docs, model, id_col, text_col, seed=seed)
    slim = cut(slim.where(~F.isnan(key)))  # numbers only, which are read a few times
    if k is None:
        k = expected_targets(slim, logit)
    least = kth_largest(slim, key, k) if k > 0 else math.inf
    if keep:  # scored again: texts written besides would take as much disk as the table
        full, (_, _, key) = keyed(docs, model, id_col, text_col, keep=True, seed=seed)
        return full.where(~F.isnan(key) & (F.col(key) >= least)).select(*docs.columns)
    return slim.where(F.col(key) >= least).select(F.col(id_col), F.col(importance).alias("importance"), F.col(logit).alias("logit"), F.col(key).alias("gumbel_key"))


def op3_resampling(spark, sf_dir: str) -> DataFrame:
    """The sampled documents with importance, logit and gumbel_key; documents without n-grams are never among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
