"""The pipeline's stages, and run() against a plain Python version."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wakeline.llm import bpe, decontamination, near_dup
from wakeline.llm.hashing import WordHash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of five kinds, with labels and a benchmark."""
    rng = random.Random(12)
    out = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(rng.choice([f"word{k}" for k in range(900)]) for _ in range(n))
    item = prose(30)
    shared = "\n".join(prose(12) for _ in range(8))
    rows = []
    for k in range(120):
        text = "\n".join(prose(20).capitalize() + "." for _ in range(4))
        kind = k % 6
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in prose(80).split())
        elif kind == 2:
            text += "\n" + shared + "\n" + prose(15)
        elif kind == 3 and rows:
            text = rows[-3][1].replace("word7 ", "word8 ")
        elif kind == 4:
            text += " " + item + " " + prose(9)
        rows.append((k, text, "en", "src", len(text)))
    rows += [(200, None, "en", None, None), (201, "", None, "src", 0), (0, rows[0][1], "en", "src", rows[0][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(k, 0 if k % 6 == 1 else 1, 0) for k in range(0, 120, 2)] + [(k, 0 if k % 6 == 1 else 1, 0) for k in range(1, 60, 6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def strip_lines(rows):
    """Line dedup in plain Python: runs of repeated pairs of lines, cut by content; the first occurrence of a chunk stays."""
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16)
    texts = sorted({(i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows})
    count = Counter(p for _, _, t in texts for p in zip(t.split("\n"), t.split("\n")[1:]))
    chunks = []
    for i, w, t in texts:
        lines = t.split("\n")
        again = [count[p] > 1 and "".join(p).strip(" \t\r\n") != "" for p in zip(lines, lines[1:])] + [False]
        start = None
        for n, on in enumerate(again):
            if on and start is None:
                start = n
            if not on and start is not None:
                hit = [False, *[(h(a) * 257 % 2147483647 + h(b)) % 2147483647 % 2 == 0 for a, b in zip(lines[start:n], lines[start + 1 : n + 1])]]
                for k in range(start + 1, n + 1):
                    if k == n or (hit[k - start] and not hit[k - start - 1] and k <= n - 2):
                        chunks.append((tuple(lines[start : k + 1]), i, w, start))
                        start = k + 1
                start = None
    first, gone = {}, {}
    for c, i, w, p in chunks:
        if first.setdefault(c, (i, w, p)) != (i, w, p):
            gone.setdefault((i, w), set()).update(range(p, p + len(c)))
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, hashlib.md5(t.encode()).hexdigest()), ()))) for i, t in rows]


def by_hand(spark, folder):
    """The stages after the first in plain Python; the first is judged on its own."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r)[:2] for r in corpus_pipeline.quality_classifier(spark, docs, folder).collect()]
    rows = strip_lines(rows)
    seen = WordHash()
    bags = [near_dup.bag(t, seen) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_dup.similarity(bags[i], bags[j]) >= near_dup.SIMILARITY:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    best = {}
    for r, row in zip(root, rows):
        best[r] = min(best.get(r, row), row)
    items = [decontamination.tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]

    def dirty(text):
        w = np.array(decontamination.tokens(text))
        return any(decontamination.verify(w, np.array(x), s) for x in items for s in range(-len(x), len(w)))

    return sorted((i, t) for i, t in best.values() if not dirty(t))


def test_stages_and_run_equal_plain_python(spark, folder):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    want = by_hand(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in want]
    coder = bpe.WordBpe(bpe._definition(vocabulary))
    ids = {i: e[0] for (i, _), e in zip(want, coder.encode_many([t for _, t in want]))}
    assert all(r["ids"] == ids[r["doc_id"]] for r in got)
    kept = {i for i, _ in want}
    assert not any(i % 6 in (1, 4) for i in kept) and not kept & {200, 201}
    assert {i for i in range(120) if i % 6 in (0, 5)} <= kept


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_run_over_empty_tables_and_odd_columns(spark, folder, tmp_path):
    pytest.importorskip("public_tokenizers")
    names = ("documents", "labels", "benchmark")
    for empty in (names, ("labels", "benchmark"), ("documents",)):
        out = tmp_path / "-".join(empty)
        for n in names:
            df = spark.read.parquet(f"{folder}/{n}.parquet")
            if n == "documents":
                df = df.where("doc_id < 12 or doc_id >= 200").selectExpr("*", "'k' as __key", "1 as __id", "array(2) as __whole", "'l' as __lines", "named_struct('a', 1) as row", "'w' as whole")
            (df.limit(0) if n in empty else df).write.parquet(f"{out}/{n}.parquet")
        got = corpus_pipeline.run(spark, str(out))
        assert {"doc_id", "n_tokens"} <= set(got.columns)
        assert (got.count() > 0) == ("documents" not in empty)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_over_a_test_table(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
