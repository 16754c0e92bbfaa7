"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

Signatures.  A text is the multiset of its five-word shingles.  Each shingle of
count c covers the discretised weights 0 .. c - 1; these lie in dyadic intervals
[0, 1), [1, 2), [2, 4), [4, 8) ..., each with a Poisson process of its length as rate, so a heavy
shingle adds only a logarithmic number of processes.  A point has a
uniform weight in its interval (it counts if that is below c) and a uniform component of
the signature; a component keeps its earliest point.  All processes of a text
run in step until no later point can win.  Two texts' components are equal with
a probability of their weighted Jaccard similarity, without bias.

Candidates.  Signatures are cut in bands; texts that share a band's hash are candidates, and the
components of that relation are families.  A family of more than ``FAMILY`` texts is taken bucket by bucket
instead, so loosely related texts don't add up to one ever larger group.

Verification.  A family (or bucket) is dealt into blocks of bounded size, and every pair of its blocks
is one task's work: the exact overlaps of all pairs of texts in it come from
counts of common elements, no pair ever becomes a row, and only a spanning forest of the links found leaves the
task.  A member is sent once for each block of its own family, once if the family is a single block.

Exact copies collapse before all this; the classes are the connected components of the links.

Defined results: texts without words (null, empty, white space) are alike only if equal (nulls
among themselves); shorter texts than a shingle are one shingle; repeated rows share a
class; null ids come last and a class of null ids only has a null class id; other columns are ignored. Of rows
with equal id and text, ``keep_one`` keeps that whose other columns come first as JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.components import components
from wakeline.llm.hashing import WordHash, mix, seeded, shingles, slices, word_hashes
from wakeline.llm.shared import cut, fresh, release

WORDS = 5  # words of a shingle
SIMILARITY = 0.8  # weighted Jaccard similarity of a link
BANDS, ROWS_OF_BAND = 24, 4  # a pair at 0.8 shares no band with a probability of 3e-6
FAMILY = 200_000  # most texts of a family that is taken as a whole
ROWS, ELEMENTS = 512, 200_000  # most texts and shingles of a block, but for a single longer text
DENSE = 16  # texts of two blocks that an element is counted pair by pair for; in more of them by a matrix product
_SLICE = 500_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bag(text: str | None, seen: WordHash, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, sorted, and their counts."""
    return np.unique(shingles(word_hashes((text or "").split(), seen), n), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: shared over total counts."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared) if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures (one row per bag, as ordered bits of arrival times); rows of empty bags are meaningless."""
    row = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    times = np.full((len(bags), size), np.inf)
    if not len(row):
        return times.view(np.int64)
    element, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    # Dyadic intervals of every element: level 0 is [0, 1), level j is [2**(j-1), 2**j).
    parts = []
    for level in range(int(count.max() - 1).bit_length() + 1):
        low = 0 if level == 0 else 1 << (level - 1)
        at = np.flatnonzero(count > low)
        parts.append((at, np.full(len(at), level), np.full(len(at), low), np.full(len(at), max(1, low))))
    at, level, low, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = seeded(element[at], 1) + level.astype(np.uint64) * _GOLDEN
    seed, row, most, rate = mix(seed), row[at], count[at], length.astype(np.float64)
    total = np.bincount(row, np.minimum(most, low + length) - low, len(bags))
    limit = size * (np.log(size) + 3) / np.maximum(total, 1)
    step = np.zeros(len(row), np.uint64)
    clock = np.zeros(len(row))
    flat = times.reshape(-1)

    def advance(p: np.ndarray) -> None:
        step[p] += np.uint64(1)
        u = mix(seed[p] + step[p] * _GOLDEN)
        clock[p] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / rate[p]

    live = np.arange(len(row))
    advance(live)
    while live.size:
        running = live[clock[live] <= limit[row[live]]]
        while running.size:
            v = mix((seed[running] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + step[running] * _GOLDEN)
            weight = low[running] + ((v & np.uint64(0xFFFFFFFF)) * length[running].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            ok = weight < most[running]
            component = ((v >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, row[running][ok] * size + component[ok], clock[running][ok])
            advance(running)
            running = running[clock[running] <= limit[row[running]]]
        open_rows = times.max(1) > limit
        limit[open_rows] *= 2
        live = live[open_rows[row[live]]]
    return times.view(np.int64)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of each signature."""
    parts = sig.reshape(len(sig), bands, rows).view(np.uint64)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), (len(sig), 1))
    for k in range(rows):
        out = mix(out + parts[:, :, k] * np.uint64(2 * k + 3))
    return out.view(np.int64)


def _digest(text_col: str):
    return F.coalesce(F.unhex(F.md5(text_col)), F.lit(b""))


def banded(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(whole, weight, hashes): number of shingles and band hashes of each distinct text with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHash()
        for batch in batches:
            batch = batch.drop_duplicates("whole")
            texts = batch["text"].tolist()
            for start, end in slices([len(t or "") for t in texts], _SLICE):
                bags = [bag(t, seen) for t in texts[start:end]]
                weight = np.array([b[1].sum() for b in bags], np.int64)
                some = np.flatnonzero(weight > 0)
                hashes = band_hashes(signatures(bags, bands * rows), bands, rows)[some]
                yield pd.DataFrame({"whole": batch["whole"].to_numpy()[start:end][some], "weight": weight[some], "hashes": list(hashes)})

    return cut(texts.mapInPandas(run, "whole binary, weight long, hashes array<long>").dropDuplicates(["whole"]))


def groups(one: DataFrame, most: int = FAMILY) -> DataFrame:
    """(node, bucket, part): texts (by a hash of ``whole``) and the groups within which pairs are verified.

    part is a family, or a bucket of a family of more than ``most`` texts.  Texts that share no band are not listed.
    """
    rows = one.select(F.xxhash64("whole").alias("node"), F.explode("hashes").alias("hash"))
    low = rows.groupBy("hash").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("hash", "low")
    low = cut(low)  # an exchange of its own lets adaptive execution split a very common hash
    shared = cut(rows.join(low, "hash"))  # a few rows of texts that share a band, none of others
    first = shared.groupBy("node").agg(F.min("low").alias("first"))
    steps = shared.join(first, "node").select(F.col("first").alias("u"), F.col("low").alias("v")).distinct()
    roots = components(steps).withColumnRenamed("node", "first")
    family = cut(first.join(roots, "first", "left").select("node", F.coalesce("root", "first").alias("family")))
    sizes = cut(family.groupBy("family").agg(F.count("*").alias("n")))
    sized = family.join(sizes, "family")
    small = sized.where(F.col("n") <= most).select("node", F.lit(False).alias("bucket"), F.col("family").alias("part"))
    large = sized.where(F.col("n") > most).join(shared, "node").select("node", F.lit(True).alias("bucket"), F.col("hash").alias("part"))
    return small.union(large.distinct())


def elements(own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a set: a hash for each shingle's first, second, ... occurrence, so shared counts are common elements."""
    times = np.arange(int(own[1].sum())) - np.repeat(np.cumsum(own[1]) - own[1], own[1])
    out = np.repeat(own[0], own[1])
    return np.where(times > 0, mix(out + times.astype(np.uint64) * _GOLDEN), out)


def overlaps(parts: list[np.ndarray], split: int = 0) -> np.ndarray:
    """Numbers of common elements of each pair of sets (upper triangle), or of the first ``split`` sets with the others only."""
    n = len(parts)
    row = np.repeat(np.arange(n), [len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")  # rows stay in order within an element
    row, every = row[order], every[order]
    column = np.cumsum(np.append(0, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    shared = np.bincount(column)[column]
    out = np.zeros(n * n, np.int64)
    few = (shared > 1) & (shared <= DENSE)
    r, c = row[few], column[few]
    for d in range(1, min(DENSE, len(r))):
        on = c[d:] == c[:-d]
        out += np.bincount(r[:-d][on] * n + r[d:][on], minlength=n * n)
    out = out.reshape(n, n)
    many = shared > DENSE
    r, c = row[many], column[many]
    c = np.cumsum(np.append(0, c[1:] != c[:-1])) if len(c) else c
    for start in range(0, int(c[-1]) + 1 if len(c) else 0, 4096):
        a, b = np.searchsorted(c, [start, start + 4096])
        m = np.zeros((n, min(4096, int(c[-1]) + 1 - start)), np.float32)
        m[r[a:b], c[a:b] - start] = 1  # sums below 2**24 are exact
        if split:
            out[:split, split:] += (m[:split] @ m[split:].T).astype(np.int64)
        else:
            out += (m @ m.T).astype(np.int64)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component in a graph of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(texts: DataFrame, one: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(u, v): links between distinct texts (whole, text) of each group that join all that are linked within it."""
    placed = one.select(F.xxhash64("whole").alias("node"), "whole", "weight").join(parts, "node")
    size = F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("weight") / ELEMENTS)).cast("int")
    dealt = placed.join(cut(placed.groupBy("bucket", "part").agg(size.alias("blocks"))), ["bucket", "part"])
    block = F.pmod(F.xxhash64("whole", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    asked = dealt.groupBy("whole").agg(F.collect_list(F.struct("bucket", "part", "blocks", block.alias("block"))).alias("places"))  # a band each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            bags = pa.array([elements(bag(t.as_py(), seen)).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["whole"], batch["places"], bags], ["whole", "places", "bag"])

    # Copies collapse within each task before texts move, then texts that stand in no group go.
    held = texts.groupBy("whole").agg(F.first("text").alias("text")).join(asked, "whole")
    bags = held.select("whole", "places", "text").mapInArrow(run, "whole binary, places array<struct<bucket: boolean, part: long, blocks: int, block: int>>, bag binary")
    sent = bags.select("whole", "bag", F.explode("places").alias("p")).select("whole", "bag", "p.*")
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("bucket", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "whole", "bag")

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["block", "whole"])
        sets = [np.frombuffer(b, np.uint64) for b in own["bag"]]
        size = np.array([len(x) for x in sets])
        split = int((own["block"] == key[2]).sum()) if key[2] < key[3] else 0
        common = overlaps(sets, split)
        common[split:, split:] *= not split  # pairs within a block are another task's
        common[:split, :split] = 0
        a, b = np.nonzero(np.triu(common, 1))
        linked = common[a, b] / (size[a] + size[b] - common[a, b]) >= least
        root = forest(len(sets), a[linked], b[linked])
        at = np.flatnonzero(root != np.arange(len(root)))
        whole = own["whole"].to_numpy()
        return pd.DataFrame({"u": whole[at], "v": whole[root[at]]})

    return sent.groupBy("bucket", "part", "low", "high").applyInPandas(solve, "u binary, v binary")


def links(texts: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS_OF_BAND, most: int = FAMILY) -> DataFrame:
    """(node, root): the components of linked distinct texts (whole, text); unlinked texts are not listed."""
    release(texts.sparkSession)
    one = banded(texts, bands, rows)
    parts = cut(groups(one, most))
    release(texts.sparkSession)
    return components(verified(texts, one, parts, least))


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id, whole, class_key) of every row."""
    texts = docs.select(_digest(text_col).alias("whole"), F.col(text_col).alias("text"))
    roots = links(texts, least)
    own = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("whole"))
    return own.join(roots.withColumnRenamed("node", "whole"), "whole", "left").select("id", "whole", F.coalesce("root", "whole").alias("class_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id, class_id (the smallest id of its class) and class_rows (the class's number of rows) of every row."""
    rows = cut(_classes(docs, id_col, text_col, least))
    release(docs.sparkSession)
    heads = cut(rows.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows")))
    return rows.join(heads, "class_key").select(F.col("id").alias(id_col), "class_id", "class_rows")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows as they came, one of each class: that of the smallest id, then of the smallest text digest."""
    key, id_, whole, row = fresh(docs, "key", "id", "whole", "row")
    rows = cut(_classes(docs, id_col, text_col, least))
    release(docs.sparkSession)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("whole")))
    heads = rows.groupBy("class_key").agg(first.alias("m")).select(F.col("m.id").alias(id_), F.col("m.whole").alias(whole))
    kept = docs.withColumn(key, _digest(text_col)).join(heads, (F.col(key) == F.col(whole)) & F.col(id_col).eqNullSafe(F.col(id_)), "left_semi")
    order = F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))
    one = kept.groupBy(id_col, key).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op7_near_dup(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and class_rows of every document; odd rows as the module says."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
