"""Word-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols sit in the leaves' gaps: leaf ``i`` of the tree holds the merge
rank of symbol ``i`` with its right neighbour, every inner node the smaller of
its children (the left one on ties).  The root is therefore the leftmost
lowest-rank merge; a merge changes at most three leaves, each a logarithmic
update, until the root says that nothing merges any more.

The vocabulary file is a parameter; it is read on the driver once and sent to
the executors as a broadcast of fixed size (the file's own).  Texts are encoded
in Arrow batches; the new words of a slice of texts are merged together, one
tree per row of a matrix, and each Python worker keeps the encodings of at most
``CACHE`` distinct words.  Words beyond ``WIDE`` symbols get a tree of their own.

Defined results: a null text is encoded as the empty text (no tokens, digests of
the empty string); special-token strings inside a text become the special token,
as in the library; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from wakeline.llm.shared import append_columns

CACHE = 300_000  # words kept per worker; a full cache is emptied
SLICE = 1_000_000  # characters of text that are encoded together
WIDE = 64  # symbols of a word that is merged together with others
_END = "</w>"
# The contractions and classes that the vocabulary's own file splits words by,
# with its white space (the Unicode property) written out.
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


def merge_word(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply all merges to one word; ``merges`` maps a pair to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = len(merges)
    leaves = 1 << (n - 1).bit_length()
    tree = [none] * (2 * leaves)
    get = merges.get
    missing = (none, 0)
    for i in range(n - 1):
        tree[leaves + i] = get((symbols[i], symbols[i + 1]), missing)[0]
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(i: int, rank: int) -> None:
        k = leaves + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (rank := tree[1]) < none:
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] != rank:
                k += 1
        i = k - leaves
        j = right[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after = right[i] = right[j]
        put(j, none)
        if after < n:
            left[after] = i
            put(i, get((symbols[i], symbols[after]), missing)[0])
        else:
            put(i, none)
        if (before := left[i]) >= 0:
            put(before, get((symbols[before], symbols[i]), missing)[0])
    return [s for s in symbols if s >= 0]


class PairRanks:
    """Merge ranks of symbol pairs, looked up for whole arrays; symbol -1 is no symbol."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], n_symbols: int):
        self.base, self.none = n_symbols + 2, len(merges)
        pairs = np.array([a * self.base + b for a, b in merges], np.int64)
        ranks = np.array([r for r, _ in merges.values()], np.int64)
        self.none = int(ranks.max(initial=-1)) + 1
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.append(pairs[order], -1), np.append(ranks[order], self.none).astype(np.int32)
        self.merged = np.zeros(self.none + 1, np.int32)
        self.merged[ranks] = [m for _, m in merges.values()]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.pairs[:-1], key)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], self.none).astype(np.int32)


def merge_words(symbols: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Apply all merges to many words at once, each with its own tree.

    ``symbols`` has a word per row, padded with -1 to a power of two and two more columns;
    merged-away symbols become -1 in the result.
    """
    rows, leaves = len(symbols), symbols.shape[1] - 2
    tree = np.full((rows, 2 * leaves), ranks.none, np.int32)
    tree[:, leaves:] = ranks(symbols[:, :leaves], symbols[:, 1 : leaves + 1])
    k = leaves
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    right = np.tile(np.arange(1, leaves + 3, dtype=np.int32), (rows, 1))
    left = right - 2
    live = np.flatnonzero(tree[:, 1] < ranks.none)
    while live.size:
        best = tree[live, 1]
        k = np.ones(live.size, np.int64)
        for _ in range(leaves.bit_length() - 1):
            k *= 2
            k += tree[live, k] != best
        i = k - leaves
        j = right[live, i]
        after = right[live, j]
        new = ranks.merged[best]
        symbols[live, i] = new
        symbols[live, j] = -1
        right[live, i] = after
        left[live, after] = i
        before = left[live, i]
        some = before >= 0
        gone = np.minimum(j, leaves - 1)
        tree[live, leaves + gone] = ranks.none
        tree[live, leaves + i] = ranks(new, symbols[live, after])
        tree[live[some], leaves + before[some]] = ranks(symbols[live[some], before[some]], new[some])
        nodes = [leaves + gone, leaves + i, leaves + np.where(some, before, i)]
        for _ in range(leaves.bit_length() - 1):
            for n, node in enumerate(nodes):
                nodes[n] = node = node >> 1
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] < ranks.none]
    return symbols


class WordBpe:
    """Encoder and decoder for a vocabulary file of word-end BPE over bytes, lower case."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        vocab = d["model"]["vocab"]
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.token = {i: t for t, i in (vocab | special).items()}
        self.special = {t: (str(i), 1, t) for t, i in special.items()}
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + _END] for c in alphabet]
        self.merges = {}
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pieces = regex.compile(_PIECE)
        self.gaps = regex.compile(f"[{_SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.text = {i: str(i) for i in self.token}
        self.ranks = PairRanks(self.merges, max(self.token) + 1)
        self.words: dict[str, tuple[str, int, str]] = dict(self.special)

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        return [*[self.first[b] for b in raw[:-1]], self.last[raw[-1]]]

    def merge(self, pieces: list[list[int]]) -> list[list[int]]:
        """Merge many pieces: together by width, long ones each on their own."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            if len(p) > WIDE:
                out[n] = merge_word(p, self.merges)
            else:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(n)
        for width, at in by_width.items():
            table = np.full((len(at), width + 2), -1, np.int32)
            sizes = np.array([len(pieces[n]) for n in at])
            table[np.arange(width + 2) < sizes[:, None]] = [s for n in at for s in pieces[n]]
            merged = merge_words(table, self.ranks)
            kept = merged >= 0
            flat, ends = merged[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
            for n, start, end in zip(at, [0, *ends], ends, strict=False):
                out[n] = flat[start:end]
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache doesn't hold: ids and tokens joined by spaces, and their number."""
        found = [(w, self.pieces.findall(w.replace("Σ", "σ").lower())) for w in words]
        distinct = list({p for _, pieces in found for p in pieces})
        ids = dict(zip(distinct, self.merge([self.symbols(p) for p in distinct]), strict=True))
        text, token = self.text, self.token
        for w, pieces in found:
            own = ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]]
            self.words[w] = " ".join([text[i] for i in own]), len(own), " ".join([token[i] for i in own])

    def split(self, text: str) -> list[str]:
        """A text's words and special tokens."""
        words: list[str] = []
        for part in [text] if self.marks is None else self.marks.split(text):
            if part in self.special:
                words.append(part)
            elif part:
                clean = unicodedata.normalize("NFC", part)
                words += [w for w in self.gaps.split(clean) if w] if self.odd.search(clean) else clean.split()
        return words

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each whole text: ids joined by spaces, their number, and the decoded text."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[start:end]]
            new = {w for words in split for w in words if w not in self.words}
            if len(self.words) + len(new) > CACHE:
                self.words = dict(self.special)
                new = {w for words in split for w in words if w not in self.words}
            self.learn(new)
            for words in split:
                found = [f for f in map(self.words.__getitem__, words) if f[1]]
                yield " ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found])
            start = end

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    Returns ``id_col``, n_tokens, ids (space-joined decimal ids, only with ``keep_ids``), decoded
    (only with ``keep_ids``), ids_sha256, decoded_sha256.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_definition(vocabulary))

    names = ["n_tokens", *(("ids", "decoded") if keep_ids else ()), "ids_sha256", "decoded_sha256"]

    def make():
        bpe = WordBpe(shared.value)

        def encode(texts: list) -> list[list]:
            rows = []
            for ids, n, decoded in bpe.encode_many([t or "" for t in texts]):
                digests = hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                rows.append((n, ids, decoded, *digests) if keep_ids else (n, *digests))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]

        return encode

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    outputs = [(n, LongType() if n == "n_tokens" else StringType()) for n in names]
    return append_columns(picked, make, ["text"], outputs).drop("text").withColumnRenamed("id", id_col)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded text of every document; a null text counts as empty."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
