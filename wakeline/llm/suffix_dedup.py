"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it also starts elsewhere, in
the same text or another.

Dealing out.  A window is ``LENGTH`` bytes; its key is the smallest hash of the
``GRAM``-byte strings in it.  Equal windows have equal keys, and neighbouring
windows mostly share theirs, so texts fall into runs of windows of one key.  A
run whose smallest string stands in one place only holds no repeat; a Bloom filter of the other keys, of
fixed size, spares sending it.  Runs go to their key's partition as segments (the
run's bytes and the tail of its last window); equal segments count once, with a mark that they are several.

Crowded keys.  A passage that stands between many different texts gives its key a segment from each.  The windows of a key
whose distinct segments exceed a block are dealt out anew, by the smallest hash of longer strings in them and at last by
the hash of the whole window (``WIDTHS``).  Equal windows still share their key, as each step looks at nothing but the window.

Suffix arrays.  A partition's segments are handled in blocks of whole keys.  In a
block, suffixes that are smaller than their successors are sorted directly (byte words first, then
longer hashed strides while a group has not split), to the depth of a window; the others are induced by one scan over the
buckets of first bytes, wave by wave.  Neighbours in the suffix array whose
common prefix has ``LENGTH`` bytes (hashes first, then byte by byte) are repeats.

Marks return to every text with that segment and are merged to spans in its row.

Defined results: texts are their UTF-8 bytes, null ones empty; texts shorter than a
window lose nothing; all rows of a text that occurs on several rows are repeats of each other and lose every byte if they
have a window; ids may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from wakeline.llm.hashing import mix, seeded, slices
from wakeline.llm.shared import append_columns, cut

LENGTH = 400  # bytes of a window
GRAM = 64  # bytes of a hashed string; a power of two
BITS = 26  # Bloom filter size, as a power of two
WIDTHS = (GRAM, 256, 384, LENGTH)  # bytes of the strings whose smallest hash is the key, from step to step for crowded keys
BLOCK = 2_000_000  # bytes of segments whose suffixes are sorted together
_SLICE = 1 << 19  # bytes of text hashed together
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte string, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM and len(h) > width:
        h = mix_pair(h[:-width], h[width:])
        width *= 2
    return h if width == GRAM else h[:0]


def mix_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD1342543DE82EF95) + b
    x ^= x >> np.uint64(29)
    x *= _BASE
    return x ^ (x >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def widened(h: np.ndarray, width: int, wider: int) -> np.ndarray:
    """Hash of each string of ``wider`` bytes from those of ``width`` bytes."""
    while width < wider:
        step = min(2 * width, wider)
        h = mix_pair(h[: len(h) - step + width], h[step - width :])
        width = step
    return h


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array of at least one."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _label(h: np.ndarray, step: int) -> np.ndarray:
    """The key that a string's hash gives at a step."""
    return seeded(h, 5 + step) if step else h


def _windows(texts: list[bytes], length: int, crowded: list[np.ndarray]) -> Iterator[tuple]:
    """Slices of texts: number of the first, each text's end and begin, key, validity, text and step of each window, hashes and lowest ones of the last step.

    ``crowded`` has the sorted keys of each step whose windows take the next one.  The lowest hash is 0 where a window does not reach the last step.
    """
    for start, end in slices([len(t) for t in texts], _SLICE):
        data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        if len(data) >= length:
            h = gram_hashes(data)
            key = lowest = window_minima(h, length - GRAM + 1)
            sizes = np.array([len(t) for t in texts[start:end]])
            ends = np.cumsum(sizes)
            own = np.repeat(np.arange(end - start), sizes)[: len(key)]
            valid = np.arange(len(key)) + length <= ends[own]
            step = np.zeros(len(key), np.int8)
            for n, known in enumerate(crowded):
                on = valid & (step == n) & among(key, known)
                if not on.any():
                    lowest = np.zeros(len(key), np.uint64)
                    h = widened(h, WIDTHS[n], WIDTHS[len(crowded)])
                    break
                h = widened(h, WIDTHS[n], WIDTHS[n + 1])
                low = window_minima(h, length - WIDTHS[n + 1] + 1)
                lowest = np.where(on, low, np.uint64(0))
                key = np.where(on, _label(low, n + 1), key)
                step[on] = n + 1
            yield start, ends, ends - sizes, key, valid, own, step, h, lowest


def runs(texts: list[bytes], length: int = LENGTH, crowded: list[np.ndarray] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, windows, key) of each run of windows of one key, slice by slice; whole windows are runs of their own."""
    for start, _, begins, key, valid, own, step, _, _ in _windows(texts, length, crowded):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | ~valid[:-1] | (step[1:] != step[:-1]) | (step[1:] == len(WIDTHS) - 1)
        first = np.flatnonzero(fresh & valid)
        if len(first):
            closing = np.append(np.flatnonzero(fresh | ~valid), len(key))
            stop = closing[np.searchsorted(closing, first, "right")]
            yield own[first] + start, first - begins[own[first]], stop - first, key[first]


def anchors(texts: list[bytes], length: int = LENGTH, crowded: list[np.ndarray] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, key) of each string of the last step that is the smallest of some window there, slice by slice."""
    width = length - WIDTHS[len(crowded)]
    for start, ends, begins, _, valid, _, _, h, lowest in _windows(texts, length, crowded):
        if not lowest.any():
            continue
        # The largest key of the windows around a string equals it just if it is the smallest of one of them.
        around = np.concatenate([np.zeros(width, np.uint64), np.where(valid, lowest, np.uint64(0)), np.zeros(width, np.uint64)])
        largest = ~window_minima(~around, width + 1)
        at = np.flatnonzero(largest[: len(h)] == h)
        own = np.searchsorted(ends, at, "right")
        yield own + start, at - begins[own], _label(h[at], len(crowded))


def bloom_places(key: np.ndarray) -> list[np.ndarray]:
    return [(seeded(key, k) & np.uint64(2**BITS - 1)).astype(np.int64) for k in (3, 4)]


class Suffixes:
    """Suffix array of a block of segments, to the depth of a window.

    ``first`` and ``windows`` have each segment's place in ``data`` and its number of windows; segments are followed by a byte 0.
    Only windows, and the suffixes behind them up to the next one that is sorted directly, are ordered.
    """

    STRIDE = 64

    def __init__(self, data: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int = LENGTH):
        self.n, self.length = len(data), length
        self.data = np.concatenate([data, np.zeros(length + self.STRIDE + 8, np.uint8)])
        ahead = self.data.astype(np.uint64)
        width = 1
        while width < 8:  # ahead[i]: the 8 bytes from i on, the first one highest
            ahead = (ahead[:-width] << np.uint64(8 * width)) | ahead[width:]
            width *= 2
        self.word = ahead
        h = self.word
        while width < self.STRIDE:
            h = mix_pair(h[:-width], h[width:])
            width *= 2
        self.stride = h
        self.first, self.windows = first, windows

    def smaller_than_successor(self) -> np.ndarray:
        """Whether each suffix is smaller than the next one; runs of one byte follow the suffix that ends them."""
        d = self.data
        less, equal = d[:-1] < d[1:], d[:-1] == d[1:]
        # The next place where bytes differ decides; the padding's zeros count as smaller than nothing.
        decided = np.where(equal, len(d), np.arange(len(d) - 1))
        nearest = np.minimum.accumulate(decided[::-1])[::-1]
        return np.append(np.append(less, True)[np.minimum(nearest, len(d) - 1)], True)

    def direct(self, at: np.ndarray) -> np.ndarray:
        """Sort suffixes by their first ``length`` bytes; equal ones stay together in any order."""
        order = at[np.argsort(self.word[at], kind="stable")]
        key = self.word[order]
        group = np.zeros(len(order), np.int64)
        group[1:] = np.cumsum(key[1:] != key[:-1])
        where = np.arange(len(order))
        depth = np.full(len(order), 8)
        while True:
            # Places whose group has several members and may still split.
            size = np.bincount(group)
            alive = (size[group] > 1) & (depth < self.length)
            if not alive.any():
                return order
            where, group, depth = where[alive], group[alive], depth[alive]
            _, group = np.unique(group, return_inverse=True)
            own = order[where]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            # A group whose next stride is one string skips it.
            s = self.stride[own + depth]
            same = np.logical_and.reduceat(s == s[starts][group], starts)[group]
            depth = depth + np.where(same, self.STRIDE, 0)
            split = np.flatnonzero(~same)
            if len(split):
                key = self.word[own[split] + depth[split]]
                by = np.lexsort((key, group[split]))
                own[split] = own[split][by]
                order[where[split]] = own[split]
                key = key[by]
                fresh = np.zeros(len(group), bool)
                inner = np.append(False, (key[1:] != key[:-1]) & (group[split][1:] == group[split][:-1]))
                fresh[split] = inner
                fresh[starts] = True
                group = np.cumsum(fresh) - 1
                depth[split] += 8

    def ordered(self) -> np.ndarray:
        """All needed suffixes in order: directly sorted ones, and the others induced bucket by bucket."""
        small = self.smaller_than_successor()
        # Each segment needs its windows and what follows up to a directly sorted suffix.
        nexts = np.where(small, np.arange(len(small)), len(small))
        nexts = np.minimum.accumulate(nexts[::-1])[::-1]
        last = np.minimum(nexts[self.first + self.windows - 1], len(self.data) - 1)
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, self.first, 1)
        np.add.at(mark, last + 1, -1)
        needed = np.cumsum(mark[:-1]) > 0
        top = len(self.word) - self.length
        at = np.flatnonzero(needed & small)
        sorted_ = self.direct(at[at < top])
        head = self.data[sorted_]
        cuts = np.searchsorted(head, np.arange(257))
        pending: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []

        def induce(own: np.ndarray, byte: int) -> np.ndarray:
            """Send the predecessors of suffixes on, in order; those of the same bucket are returned."""
            before = own[own > 0] - 1
            before = before[needed[before] & ~small[before]]
            lead = self.data[before]
            later = before[lead > byte]
            if len(later):
                lead_later = self.data[later]
                by = np.argsort(lead_later, kind="stable")
                later, lead_later = later[by], lead_later[by]
                steps = np.flatnonzero(np.append(True, lead_later[1:] != lead_later[:-1]))
                for a, b in zip(steps, np.append(steps[1:], len(later)), strict=True):
                    pending[lead_later[a]].append(later[a:b])
            return before[lead == byte]

        for byte in range(256):
            wave = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
            pending[byte] = []
            while len(wave):
                out.append(wave)
                wave = induce(wave, byte)
            own = sorted_[cuts[byte] : cuts[byte + 1]]
            if len(own):
                out.append(own)
                induce(own, byte)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repeated(self) -> np.ndarray:
        """Which windows of all segments, in order of the segments, share their LENGTH bytes with another."""
        start = np.repeat(self.first - np.append(0, np.cumsum(self.windows)[:-1]), self.windows) + np.arange(int(self.windows.sum()))
        place = np.full(len(self.data), -1, np.int64)
        place[start] = np.arange(len(start))
        suffixes = self.ordered()
        suffixes = suffixes[place[suffixes] >= 0]
        equal = self.common(suffixes[:-1], suffixes[1:])
        found = np.zeros(len(start), bool)
        found[place[suffixes[:-1][equal]]] = True
        found[place[suffixes[1:][equal]]] = True
        return found

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes share ``length`` bytes: strides first, then words."""
        alive = np.arange(len(a))
        for depth in range(0, self.length - self.STRIDE + 1, self.STRIDE):
            alive = alive[self.stride[a[alive] + depth] == self.stride[b[alive] + depth]]
        for depth in [*range(0, self.length - 7, 8), self.length - 8]:
            alive = alive[self.word[a[alive] + depth] == self.word[b[alive] + depth]]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return out


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _repeated_keys(texts: DataFrame, crowded: list[np.ndarray]) -> DataFrame:
    """(key, n): keys of the last step whose string stands in more than one place, copies of whole texts counting once, and its rows."""
    shared = texts.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("whole")
            whole = np.array([int(w[:16], 16) for w in batch["whole"]], np.uint64)
            for text, at, key in anchors(_bytes(batch["text"]), crowded=shared.value):
                place = mix(seeded(whole[text], 5) + at.astype(np.uint64))
                yield pd.DataFrame({"key": key.view(np.int64), "place": place.view(np.int64)})

    found = texts.mapInPandas(run, "key long, place long")
    return found.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")


def _crowded(texts: DataFrame, crowded: list[np.ndarray], asked: np.ndarray, block: int) -> np.ndarray:
    """The keys among ``asked``, sorted, whose distinct segments have more than ``block`` bytes."""
    shared = texts.sparkSession.sparkContext.broadcast((crowded, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crowded, asked = shared.value
        for batch in batches:
            own = _bytes(batch.drop_duplicates("whole")["text"])
            for text, first, windows, key in runs(own, crowded=crowded):
                on = among(key, asked)
                rows = zip(text[on].tolist(), first[on].tolist(), windows[on].tolist(), strict=True)
                part = [int.from_bytes(hashlib.md5(own[t][f : f + w + LENGTH - 1]).digest()[:8], "big", signed=True) for t, f, w in rows]
                yield pd.DataFrame({"key": key[on].view(np.int64), "part": np.array(part, np.int64), "n": windows[on] + LENGTH - 1})

    parts = texts.mapInPandas(run, "key long, part long, n long").distinct()
    return _sorted_keys(parts.groupBy("key").agg(F.sum("n").alias("n")), block)


def _sorted_keys(counted: DataFrame, most: int) -> np.ndarray:
    """The keys with a count above ``most``; in all texts at most one place in so many gives one."""
    return np.sort(np.array([r["key"] for r in counted.where(F.col("n") > most).select("key").collect()], np.int64).view(np.uint64))


def _filters(texts: DataFrame, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The Bloom filter of the repeated keys of all steps, and the crowded keys of each step but the last."""
    crowded: list[np.ndarray] = []
    keys = own = cut(_repeated_keys(texts, crowded))
    while len(crowded) < len(WIDTHS) - 1:
        known = _sorted_keys(own, block // (2 * LENGTH - GRAM))  # a place's windows have that many bytes at most; equal segments are one
        if len(known):
            known = _crowded(texts, crowded, known, block)
        if not len(known):
            break
        crowded.append(known)
        own = cut(_repeated_keys(texts, crowded))
        keys = keys.unionByName(own)
    return _bloom(keys.select("key")), crowded


def _bloom(keys: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.concatenate(bloom_places(batch["key"].to_numpy().view(np.uint64)))
            yield pd.DataFrame({"bit": at + 1})

    bit = keys.mapInPandas(run, "bit long")
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    filled = np.zeros(2**BITS // 8, np.uint8)
    for r in maps.collect():  # 2**BITS / 32768 rows at most
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        filled[(r["n"] - 1) * 4096 : (r["n"] - 1) * 4096 + len(own)] = own
    return filled


def _segments(texts: DataFrame, filled: np.ndarray, crowded: list[np.ndarray]) -> DataFrame:
    """Runs whose key may repeat: key, segment (its bytes' digest), whole, first, bytes."""
    shared = texts.sparkSession.sparkContext.broadcast((filled, crowded))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, crowded = shared.value
        for batch in batches:
            batch = batch.drop_duplicates("whole")
            whole, own = batch["whole"].to_numpy(), _bytes(batch["text"])
            for text, first, windows, key in runs(own, crowded=crowded):
                ok = np.ones(len(key), bool)
                for at in bloom_places(key):
                    ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if not ok.any():
                    continue
                text, first, windows, key = text[ok], first[ok], windows[ok], key[ok]
                parts = [own[t][f : f + w + LENGTH - 1] for t, f, w in zip(text.tolist(), first.tolist(), windows.tolist(), strict=True)]
                yield pd.DataFrame({"key": key.view(np.int64), "segment": [hashlib.md5(p).digest() for p in parts], "whole": whole[text], "first": first, "bytes": parts})

    return texts.mapInPandas(run, "key long, segment binary, whole string, first int, bytes binary")


def _marked(segments: DataFrame) -> DataFrame:
    """(key, segment, froms, tos): ranges of each distinct segment's windows that repeat."""
    place = F.xxhash64("whole", "first")
    distinct = segments.groupBy("key", "segment").agg(F.first("bytes").alias("bytes"), F.min(place).alias("a"), F.max(place).alias("b"))
    dealt = distinct.select("key", "segment", "bytes", (F.col("a") != F.col("b")).alias("several"))
    dealt = dealt.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple]) -> pd.DataFrame:
        parts = [r[2] for r in rows]
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        first, windows = np.cumsum(sizes + 1) - sizes - 1, sizes - LENGTH + 1
        found = Suffixes(data, first, windows).repeated() if len(rows) > 1 or windows[0] > 1 else np.zeros(1, bool)
        out, at = [], 0
        for (key, segment, _, several), n in zip(rows, windows.tolist(), strict=True):
            own = np.ones(n, bool) if several else found[at : at + n]
            at += n
            if own.any():
                a, b = spans(own)
                out.append((key, segment, a.tolist(), b.tolist()))
        return pd.DataFrame(out, columns=["key", "segment", "froms", "tos"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(batch["key"], batch["segment"], batch["bytes"], batch["several"], strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return dealt.mapInPandas(run, "key long, segment binary, froms array<int>, tos array<int>")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, block: int = BLOCK) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the kept bytes on request.

    A key with more than ``block`` bytes of distinct segments is dealt out anew; results do not depend on it.
    """
    whole = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(whole.alias("whole"), F.col(text_col).alias("text")).where(F.octet_length("text") >= LENGTH)
    filled, crowded = _filters(texts, block)
    segments = cut(_segments(texts, filled, crowded))  # written once: hashing all texts costs more
    marks = _marked(segments)
    places = segments.select("key", "segment", "whole", "first").dropDuplicates(["whole", "first"])
    hit = places.join(marks, ["key", "segment"]).groupBy("whole").agg(F.collect_list(F.struct("first", "froms", "tos")).alias("marks"))
    copies = texts.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole", F.lit(True).alias("copied"))
    slim = cut(hit.join(copies, "whole", "full_outer"))

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept",) if keep_bytes else ())]

    def strip(texts: list, marks: list, copied: list) -> list[list]:
        out = []
        for text, own, copy in zip(_bytes(texts), marks, copied, strict=True):
            gone = np.zeros(len(text) + 1, np.int32)
            if copy:
                gone[0], gone[-1] = 1, -1
            else:
                for m in own or ():
                    np.add.at(gone, m["first"] + np.asarray(m["froms"]), 1)
                    np.add.at(gone, m["first"] + np.asarray(m["tos"]) + LENGTH - 1, -1)
            mask = np.cumsum(gone[:-1]) > 0
            a, _ = spans(mask)
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(a) else text
            out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), *((kept,) if keep_bytes else ())))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in names]

    kinds = [LongType(), LongType(), LongType(), StringType(), *((BinaryType(),) if keep_bytes else ())]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), whole.alias("whole"))
    found = append_columns(own.join(slim, "whole", "left"), lambda: strip, ["text", "marks", "copied"], list(zip(names, kinds, strict=True)))
    return found.select(F.col("id").alias(id_col), *names)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document, bytes and spans that go, and the digest of what is left; odd rows as the module says."""
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
