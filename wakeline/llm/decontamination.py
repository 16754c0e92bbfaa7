"""Benchmark decontamination by spaced-seed hashing.

A spaced seed hashes the tokens at the marked positions of a fixed mask and
ignores the others, so it still hits when ignored tokens were replaced.  All
seeds of the benchmark items are joined with all seeds of the texts; a hit fixes
an alignment of text and item, and along it the best-scoring stretch (a match counts 1,
a substitution ``-PENALTY``) must hold ``LEAST`` matching tokens, or all of a shorter item.
A positive score of that stretch means at least PENALTY / (PENALTY + 1) matches.  Of an item under 2 * ``LEAST``
tokens an alignment also counts if that share of all the item's tokens match.

Texts' seeds first pass a Bloom filter of the benchmark's seeds, whose size is
fixed: it only spares shuffling seeds that cannot join, whatever the benchmark's size.  Items
shorter than a mask get masks of their own length, one of which misses any fifth of their tokens.

Defined results: null and empty texts and items (or ones without a token) match nothing; equal texts
have equal results, on each of their rows; items with equal text are each reported; ids may be null; other
columns are ignored.  Tokens are runs of letters, marks and digits, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.hashing import WordHash, mix, seeded, slices
from wakeline.llm.shared import cut, fresh, release

#: Positions that count, of 13 at most; eight of them in each.
MASKS = ("1101100101011", "1011010011101", "1110010110011")
LEAST = 13  # matching tokens of a stretch
PENALTY = 4  # a substitution's cost in matches
BITS = 25  # Bloom filter size, as a power of two
_SLICE = 500_000
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def masks_for(lengths: list[int]) -> list[str]:
    """The fixed masks, and for each shorter item length those that any fifth of its tokens may be changed for.

    Places are dealt to groups in turn, one more than may change or two; the masks leave out each set of as many groups.
    """
    span = max(map(len, MASKS))
    out = list(MASKS)
    for n in sorted(set(lengths)):
        if 0 < n < span:
            free = n // (PENALTY + 1)
            out += ["".join("0" if k % (free + 2) in off else "1" for k in range(n)) for off in combinations(range(free + 2), free)]
    return out


def seed_hashes(texts: list, masks: list[str], seen: WordHash) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, hash) of every seed of every text, slice by slice and mask by mask."""
    for start, end in slices([len(t or "") for t in texts], _SLICE):
        words = [tokens(t) for t in texts[start:end]]
        sizes = np.array([len(w) for w in words])
        h = np.fromiter((seen[w] for own in words for w in own), np.uint64, int(sizes.sum()))
        row = np.repeat(np.arange(start, end), sizes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for n, mask in enumerate(masks):
            span = len(mask)
            if len(h) < span:
                continue
            count = len(h) - span + 1
            total = np.full(count, hash_start(mask), np.uint64)
            for k, sign in enumerate(mask):
                if sign == "1":
                    total += h[k : k + count] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            own = row[:count] == row[span - 1 :]
            yield row[:count][own], place[:count][own], mix(total[own])


def hash_start(mask: str) -> int:
    return int(mask.replace("0", "2"), 3) * 0xD1342543DE82EF95 % 2**64


def bloom_places(h: np.ndarray) -> list[np.ndarray]:
    return [(seeded(h, k) & np.uint64(2**BITS - 1)).astype(np.int64) for k in (1, 2)]


def bloom(seeds: DataFrame) -> np.ndarray:
    """The filter's bytes: 2**BITS bits, gathered as bitmaps of 32,768 bits each."""
    filled = np.zeros(2**BITS // 8, np.uint8)
    bit = seeds.select(F.explode("bits").alias("bit")).distinct()
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    for r in maps.collect():
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        # Bucket n holds the values from 32768 * (n - 1) + 1 on; value v is bit v - 1 of all buckets.
        filled[(r["n"] - 1) * 4096 : (r["n"] - 1) * 4096 + len(own)] = own
    return filled


def item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(item, pos, h, bits): seeds of the distinct item texts, each with its places in the filter (from 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHash()
        for batch in batches:
            for row, place, h in seed_hashes(batch["text"].tolist(), masks, seen):
                bits = np.stack(bloom_places(h), 1) + 1
                yield pd.DataFrame({"item": batch["item"].to_numpy()[row], "pos": place, "h": h.view(np.int64), "bits": list(bits)})

    return items.select("item", "text").mapInPandas(run, "item string, pos int, h long, bits array<long>")


def text_seeds(docs: DataFrame, masks: list[str], filled: np.ndarray) -> DataFrame:
    """(whole, pos, h): seeds of the texts that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bits = WordHash(), shared.value
        for batch in batches:
            batch = batch.drop_duplicates("whole")
            whole = batch["whole"].to_numpy()
            for row, place, h in seed_hashes(batch["text"].tolist(), masks, seen):
                ok = np.ones(len(h), bool)
                for at in bloom_places(h):
                    ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                yield pd.DataFrame({"whole": whole[row[ok]], "pos": place[ok], "h": h[ok].view(np.int64)})

    return docs.select("whole", "text").mapInPandas(run, "whole string, pos int, h long")


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the best-scoring stretch of an alignment; ties to the first."""
    score = np.concatenate([[0], np.cumsum(np.where(match, 1, -PENALTY))])
    low = np.minimum.accumulate(score)
    end = int((score - low).argmax())
    start = int(score[: end + 1].argmin())
    return start, end, int(match[start:end].sum())


def verify(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the text, tokens, matching tokens) of the overlap where item token i meets text token i + shift."""
    a, b = max(0, -shift), min(len(item), len(text) - shift)
    if b <= a:
        return None
    match = text[a + shift : b + shift] == item[a:b]
    start, end, n = best_stretch(match)
    if n < min(LEAST, len(item)):
        at = np.flatnonzero(match)
        if len(item) >= 2 * LEAST or len(at) * (PENALTY + 1) < PENALTY * len(item):
            return None
        start, end, n = int(at[0]), int(at[-1]) + 1, len(at)
    return a + start + shift, end - start, n


def _with_item(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("item", F.md5("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(whole, item_id, start, n_tokens, n_matched): overlaps of the texts, named by their md5, with the items.

    One row per distinct text and item: its longest overlap, the first on ties.
    """
    release(docs.sparkSession)
    items = _with_item(benchmark, item_id_col, item_text_col)
    texts = docs.select(F.md5(text_col).alias("whole"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": sorted({min(len(tokens(t)), 99) for t in batch["text"]})})

    lengths = [r["n"] for r in items.select("text").mapInPandas(count, "n int").distinct().collect()]  # 100 rows at most
    masks = masks_for(lengths)
    unique = items.select("item", "text").dropDuplicates(["item"])
    seeds = item_seeds(unique, masks)
    found = text_seeds(texts, masks, bloom(seeds))
    hits = found.join(seeds.select("item", F.col("pos").alias("at"), "h"), "h").select("whole", "item", (F.col("pos") - F.col("at")).alias("shift"))
    # Kept apart from texts: small rows, written once, that only texts with a hit have.
    hits = cut(hits.groupBy("whole", "item").agg(F.collect_set("shift").alias("shifts")))  # the two texts' lengths at most
    once = texts.join(hits.select("whole").distinct(), "whole", "left_semi")
    # Copies collapse before they meet: the turned key has its own exchange, with partial aggregation in front and behind a join that may be split.
    once = once.groupBy(F.reverse("whole").alias("turned")).agg(F.first("whole").alias("whole"), F.first("text").alias("text")).drop("turned")
    asked = hits.join(unique.withColumnRenamed("text", "item_text"), "item").join(once, "whole")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHash()
        last, h = None, None
        for batch in batches:
            out = []
            for whole, text, item, item_text, shifts in zip(*(batch[c] for c in ("whole", "text", "item", "item_text", "shifts")), strict=True):
                if whole != last:  # a text's rows mostly come one after the other
                    words = tokens(text)
                    last, h = whole, np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
                held = np.array([seen[w] for w in tokens(item_text)], np.uint64)
                found = [got for shift in shifts if (got := verify(h, held, int(shift))) is not None]
                if found:
                    start, n, matched = max(found, key=lambda g: (g[2], -g[0], g[1]))
                    out.append((whole, item, start, n, matched))
            yield pd.DataFrame(out, columns=["whole", "item", "start", "n_tokens", "n_matched"])

    columns = ("whole", "text", "item", "item_text", "shifts")
    checked = asked.select(*columns).mapInPandas(check, "whole string, item string, start int, n_tokens int, n_matched int")
    return checked.join(items.select("item", "item_id"), "item").drop("item")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, start, n_tokens, n_matched of every row that overlaps an item."""
    found = cut(overlaps(docs, benchmark, text_col))
    own = docs.select(F.col(id_col), F.md5(text_col).alias("whole"))
    return own.join(found, "whole").drop("whole")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that overlap no item, as they came."""
    (whole,) = fresh(docs, "whole")
    bad = cut(overlaps(docs, benchmark, text_col).select(F.col("whole").alias(whole)).distinct())
    return docs.join(bad, F.md5(text_col) == F.col(whole), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, with place and length; documents without an overlap have no row."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
