"""BPE, toxicity, resampling, line and suffix dedup, URL filters, fixity: brute force, SQL or held-out accuracy."""

import hashlib
import math
import os
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.llm import bpe, fixity, line_dedup, queries, resampling, suffix_dedup, toxicity, url_filter

DOC = "doc_id long, text string"
ODD = [(None, "text of no id"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, " \n\t "), (5, "é" * 5000), (2**62 + 1, "large id")]
FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).selectExpr("*", "'x' as id", "1 as score", "2 as n_tokens", "named_struct('a', 1) as marks", "'w' as whole", "'k' as n_bytes")


def frame(con, name, rows, columns):
    con.execute(f"CREATE TABLE {name} ({columns})")
    con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.no_truncation(), library.no_padding()
    return bpe.WordBpe(bpe._definition(vocabulary)), library


def agree(both, text):
    ours, library = both
    ids, n, decoded = next(ours.encode_many([text]))
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)) and n == len(want)
    assert decoded == library.decode(want, skip_special_tokens=False) == ours.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbBzéÉßΣσςİıñ'sStTredx12³½ \t\n\x0b\x1c\x85\xa0\u3000\u0301\u0308!?#$<|>中あ한👍\u200d\ufeff\x00ǅﬁ"), max_size=40))
def test_bpe_equals_the_library(both, text):
    agree(both, text)
    agree(both, f"{text}<|endoftext|>{text}")


def test_bpe_of_long_words_and_texts(both):
    for text in ("ab" * 5000, "the" * 40 + "'s", "z" * 64, "z" * 65, "<|startoftext|>", "It's THE end. " * 2000):
        agree(both, text)


def test_segment_tree_equals_rescanning(both):
    ours = both[0]
    rng = random.Random(3)
    for _ in range(200):
        s = ours.symbols("".join(rng.choice("theandxing") for _ in range(rng.randrange(1, 30))))
        want = list(s)
        while True:
            ranked = [(ours.merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in ours.merges]
            if not ranked:
                break
            _, i = min(ranked)
            want[i : i + 2] = [ours.merges[(want[i], want[i + 1])][1]]
        assert bpe.merge_word(list(s), ours.merges) == want == ours.merge([s])[0]


def test_bpe_frame(spark, odd, both, vocabulary):
    got = bpe.encode_documents(odd, vocabulary, keep_ids=True).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    for r in got:
        if r["doc_id"] in (1, 2, 4):
            assert (r["n_tokens"], r["ids"], r["ids_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(odd.limit(0), vocabulary).count() == 0


# Toxicity


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        own = rng.choices(plain, k=30)
        kind = k % 5
        own += {0: ["grobian"], 1: ["folk"], 2: ["grobian", "folk"], 3: ["vile"], 4: []}[kind]
        rng.shuffle(own)
        rows.append((k, " ".join(own)))
        labels.append((k, int(kind in (2, 3))))
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, y.where("doc_id < 1000"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == (t == 1) for i, t in labels if i >= 1000]
    assert np.mean(held) > 0.97


def test_toxicity_scores_equal_the_sum_over_pairs(spark):
    """Scores against the plain double sum over all pairs of a text's columns, and the gradients against differences of the loss."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices([f"word{j}" for j in range(40)], k=rng.randrange(0, 30)) + (["vile"] if k % 3 == 0 else []))) for k in range(300)]
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, y)
    place = {int(c): n for n, c in enumerate(model.columns)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(place) > 1
    for k, text in rows:
        words = {w.lower() for w in text.split()}
        own = sorted({place[c] for w in words for c in (toxicity._column(w), toxicity._column("^" + w[:4])) if c in place})
        pairs = sum(float(np.dot(model.v[i].astype(float), model.v[j].astype(float))) for n, i in enumerate(own) for j in own[:n])
        margin = model.w0 + sum(float(model.w[i]) for i in own) + pairs / max(1, len(own))
        assert abs(got[k] - 1 / (1 + math.exp(-max(-30, min(30, margin))))) < 1e-5
    # One step of size 1 from known weights moves each parameter by its gradient over its own root of squares.
    for penalty in (0.0, 2e-3):
        m = toxicity.FactorizationMachine(np.arange(5, dtype=np.int32))
        m.w[:] = [0.3, -0.2, 0.1, 0.5, -0.4]
        x, labels = [np.array([0, 1, 3]), np.array([2, 4]), np.array([], np.int64), np.array([1, 2, 3, 4])], np.array([1.0, 0, 0, 1])

        def loss(w0, w, v):
            total = 0.0
            for own, t in zip(x, labels):
                pairs = sum(float(v[i] @ v[j]) for n, i in enumerate(own) for j in own[:n]) / max(1, len(own))
                p = 1 / (1 + math.exp(-(w0 + float(sum(w[i] for i in own)) + pairs)))
                total -= (math.log(p) if t else math.log(1 - p)) * (0.5 / 0.5)
            return total + penalty / 2 * float((w * w).sum() + (v * v).sum())

        w, v, eps = m.w.astype(float), m.v.astype(float), 1e-5
        gw = np.array([(loss(0, w + eps * e, v) - loss(0, w - eps * e, v)) / (2 * eps) for e in np.eye(5)])
        gv = np.array([[(loss(0, w, v + eps * np.outer(e, f)) - loss(0, w, v - eps * np.outer(e, f))) / (2 * eps) for f in np.eye(4)] for e in np.eye(5)])
        before, start = m.w.astype(float), m.v.astype(float)
        calls = []
        margins = m.margins
        m.margins = lambda *a: calls.append((m.w.copy(), m.v.copy())) or margins(*a)
        m.fit(x, labels, steps=1, batch=4, rate=0.1, penalty=penalty)
        after_w, after_v = calls[1]
        assert np.allclose(after_w, before - 0.1 * gw / np.sqrt(0.1 + gw * gw), atol=1e-4)
        assert np.allclose(after_v, start - 0.1 * gv / np.sqrt(0.1 + gv * gv), atol=1e-4)


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(3, 1), (3, 0), (5, 1)], "doc_id long, toxic int")):
        got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), none)).count() == 0


@needs_data
def test_toxicity_query_held_out_accuracy(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1") if os.path.isdir(FOLDER.replace("sf0.001", "sf0.1")) else FOLDER
    got = queries.QUERIES["op5_toxicity"](spark, folder)
    both_ = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (both_.predicted == both_.toxic).mean() > 0.98
    assert both_[both_.toxic == 1].predicted.mean() > 0.9 and both_[both_.toxic == 0].predicted.mean() < 0.02


# Importance resampling


def junk_and_prose(n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        w = rng.choices([f"word{j}" for j in range(200)], k=rng.choice([6, 40, 200]))
        text = " ".join(w).capitalize() + "."
        bad = k % 4 == 0
        if bad:
            text = [" ".join(x.upper() + "!!" for x in w), " ".join(x + "%%%" for x in w), " ".join(w[:1] * len(w))][k % 3]
        rows.append((k, text))
        labels.append((k, int(not bad)))
    return rows, labels


def test_resampling_keeps_prose_and_rejects_junk(spark):
    rows, labels = junk_and_prose()
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'q' as importance", "array(1) as logit", "2 as __key", "map('a', 1) as __ID")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = resampling.select(docs, y.where("doc_id < 300"), keep=True)
    assert kept.columns == docs.columns
    kept = {r["doc_id"] for r in kept.collect()}
    good = {i for i, q in labels if q}
    assert len(good - kept) <= 3 and len(kept - good) <= 3
    slim = resampling.select(docs, y.where("doc_id < 300")).collect()
    assert {r["doc_id"] for r in slim} == kept


def test_resampling_takes_exactly_k(spark):
    rows, labels = junk_and_prose(200)
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")
    model = resampling.fit(docs, y)
    scored, (_, _, key) = resampling.keyed(docs, model)
    keys = [r[key] for r in scored.collect()]
    for k in (1, 17, 200, 500):
        chosen = resampling.select(docs, y, k=k).collect()
        least = sorted(keys, reverse=True)[min(k, len(keys)) - 1]
        assert len(chosen) == sum(x >= least for x in keys) >= min(k, len(keys))


def plain_buckets(text):
    """The hashed n-grams of a text, one by one in plain integers."""
    import xxhash

    def mixed(x):
        x = x % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return (x ^ x >> 31) % 2**resampling.BITS

    digest = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    words = [digest(w.strip(".,;:!?").lower() or w) >> 16 for w in text.split()]
    forms = [digest(resampling.shape(w)) % 2**16 for w in text.split()]
    out = [mixed(w + (1 << 60)) for w in words] + [mixed(f + (2 << 60)) for f in forms]
    out += [mixed((1 if a == b else b * 0x9E3779B97F4A7C15 + a) + (3 << 60)) for a, b in zip(words, words[1:])]
    return out + [mixed((b << 16 | a) + (4 << 60)) for a, b in zip(forms, forms[1:])]


def test_importance_and_draws_equal_plain_python(spark):
    """Importance by Counters; then, on its own logits, how often texts are drawn over many seeds."""
    rows, labels = junk_and_prose(160)
    # Texts between the kinds, so that some logits are near each other.
    rows += [(1000 + k, " ".join(a.split()[: k + 1] + b.split()[:9])) for k in range(12) for (_, a), (_, b) in [(rows[4 * k], rows[4 * k + 1])]]
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")
    model = resampling.fit(docs, y.where("doc_id < 100"))
    good = {i for i, q in labels if q and i < 100}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_buckets(t))
        target.update(plain_buckets(t) if i in good else ())
    size = 2**resampling.BITS
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    scored, (importance, logit, key) = resampling.keyed(docs, model)
    got = {r["doc_id"]: r for r in scored.collect()}
    for i, t in rows:
        own = plain_buckets(t)
        assert abs(got[i][importance] - sum(map(ratio, own)) / len(own)) < 1e-9
        assert abs(got[i][logit] - (got[i][importance] - model.boundary) / resampling.TEMPERATURE) < 1e-6
    k = round(sum(1 / (1 + math.exp(-min(700, max(-700, r[logit])))) for r in got.values()))
    assert resampling.expected_targets(scored, logit) == k
    assert {r["doc_id"] for r in resampling.select(docs, y.where("doc_id < 100")).collect()} == {i for i, _ in sorted(got.items(), key=lambda x: -x[1][key])[:k]}
    # The first draw of any set of texts falls on each in proportion to exp(logit).
    at = sorted(rows, key=lambda r: got[r[0]][logit])
    start = min(range(len(at) - 5), key=lambda n: got[at[n + 5][0]][logit] - got[at[n][0]][logit])
    own = at[start : start + 6]
    l = np.array([got[i][logit] for i, _ in own])
    draws = [int(np.argmax(model.keys([i for i, _ in own], [t for _, t in own], l * resampling.TEMPERATURE + model.boundary, seed)[1])) for seed in range(4000)]
    share = np.exp(l - l.max()) / np.exp(l - l.max()).sum()
    assert share.max() < 0.9 and np.abs(np.bincount(draws, minlength=len(own)) / 4000 - share).max() < 4 * np.sqrt(0.25 / 4000)


def test_resampling_bounds_what_repeated_ids_add(spark):
    rows, labels = junk_and_prose(80)
    docs, y = spark.createDataFrame(rows + rows[:20] * 5, DOC), spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r["doc_id"] for r in resampling.select(docs, y).collect()}.isdisjoint({i for i, q in labels if not q and len(rows[i][1].split()) > 30})


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1e3, 1e3) for _ in range(300)] + [0.0, 5.5, 5.5, 5.5, -1e-300, float("nan"), None, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    real = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in (1, 2, 5, 100, len(real)):
        assert resampling.kth_largest(df, "v", k) == real[k - 1]
    assert resampling.kth_largest(df, "v", 10**6) == float("-inf")


def test_gumbel_sampling_is_in_proportion():
    model = resampling.Resampler(np.zeros(2**resampling.BITS))
    hits = 0
    for seed in range(3000):
        _, key = model.keys([1, 2], ["a", "b"], np.array([np.log(3), 0.0]) * resampling.TEMPERATURE, seed)
        hits += key[0] > key[1]
    assert abs(hits / 3000 - 0.75) < 0.035


def test_resampling_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for y in (labels, labels.limit(0)):
        kept = resampling.select(odd, y, keep=True)
        assert kept.columns == odd.columns
        assert not {r["doc_id"] for r in kept.collect()} & {1, 2, 4}
    assert resampling.select(odd.limit(0), labels).count() == 0


# Line dedup


def lines_corpus():
    rng = random.Random(5)
    passage = [f"shared line {k} of the passage" for k in range(12)]
    rows = []
    for k in range(60):
        own = [f"own {k} {j}" for j in range(rng.randrange(1, 15))]
        if k % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[rng.randrange(3) :]
        if k % 7 == 0:
            own += ["", "", "", ""]
        rows.append((k if k % 11 else None, "\n".join(own)))
    return rows + [(70, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (80, None), (81, ""), (82, "\n\n\n"), (83, "one line"), (84, "one line"), (85, "ends\nwith\n")]


def test_line_dedup_equals_sql(spark):
    rows = lines_corpus()
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "'w' as id", "1 as place", "'k' as chunk")
    got = line_dedup.strip_repeats(df)
    assert got.columns == [*df.columns, "n_lines_removed", "n_chunks_removed"]
    con = duckdb.connect()
    frame(con, "docs", rows, "doc_id BIGINT, text VARCHAR")
    want = con.execute(
        f"WITH {line_dedup.LINE_DEDUP_CTE} SELECT d.doc_id, coalesce(kept, d.text), coalesce(n_lines_removed, 0), coalesce(n_chunks_removed, 0) "
        "FROM docs d LEFT JOIN stripped s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND md5(d.text) = s.whole"
    ).fetchall()
    got = [(r["doc_id"], r["text"], r["n_lines_removed"], r["n_chunks_removed"]) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[3] for r in got) > 20
    assert line_dedup.strip_repeats(df.limit(0)).count() == 0


def test_chunks_hold_all_lines_and_resist_shifts(spark):
    lines = [f"line {k}" for k in range(200)]
    df = spark.createDataFrame([(k, lines[k : 200 - j]) for k, j in ((0, 0), (3, 5), (198, 0), (197, 0), (196, 0))], "id int, lines array<string>")
    got = {r["id"]: [tuple(c) for c in r["c"]] for r in df.select("id", line_dedup.cut_lines(F.col("lines")).alias("c")).collect()}
    for k, j in ((0, 0), (3, 5), (198, 0), (197, 0), (196, 0)):
        assert [x for a, n in got[k] for x in lines[k : 200 - j][a : a + n]] == lines[k : 200 - j] and min(n for _, n in got[k]) >= 2
    whole, part = ({tuple(lines[k + a : k + a + n]) for a, n in got[k]} for k in (0, 3))
    assert len(part - whole) <= 2 and len(whole) > 30


def test_line_dedup_removes_whole_passages(spark):
    """Passages of two lines or more between unlike lines go whole but for their first occurrence, whatever stands around them."""
    rng = random.Random(13)
    passages = [[f"passage {k} line {j}" for j in range(2 + k % 7)] for k in range(20)]
    rows = [(k, n, p) for k in range(120) for n, p in enumerate(rng.sample(range(20), 3))]
    texts, want, first = [], {}, set()
    for k in range(120):
        lines, kept = [f"own {k}"], [f"own {k}"]
        for _, n, p in rows[3 * k : 3 * k + 3]:
            around = [f"between {k} {n}", *["common line"] * (n % 2), f"after {k} {n}"]
            lines += passages[p] + around
            kept += ([] if p in first else passages[p]) + around
            first.add(p)
        texts.append((k, "\n".join(lines)))
        want[k] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.strip_repeats(spark.createDataFrame(texts, DOC)).collect()}
    assert got == want


def test_line_dedup_leaves_other_columns_alone(spark):
    rows = [(k, f"own {k}\na line\nanother line\nlast {k}") for k in range(4)]
    names = ["__lines", "__id", "id", "row", "gone", "lines", "kept", "whole", "n_lines", "doc"]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    got = line_dedup.strip_repeats(df)
    assert got.columns == [*df.columns, "n_lines_removed", "n_chunks_removed"]
    for r in got.collect():
        assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
        assert r["n_lines_removed"] == (2 if r["doc_id"] else 0)


# Suffix dedup


def removed_by_brute_force(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, mask) if not g)
        out.append((str(i), len(t), int(mask.sum()), len(suffix_dedup.spans(mask)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    passages = [noise(n) for n in (300, 399, 420, 900)]
    rows = [(k, noise(rng.randrange(50, 700)) + rng.choice(passages)[rng.randrange(5) :] + noise(rng.randrange(300))) for k in range(30)]
    rows += [(40, "z" * 1500), (41, "xy" * 700 + "q"), (42, "word " * 300), (43, passages[3] * 2), (44, rows[0][1]), (0, rows[0][1]), (45, "short"), (46, "short"), (47, None), (48, ""), (None, passages[3]), (49, "z" * 399), (50, "\x00" * 800)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as n_bytes", "'w' as whole", "2 as marks", "3 as id")
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffix_dedup.cut_repeats(df).collect())
    assert got == removed_by_brute_force(rows)
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_splits_crowded_keys(spark):
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    # Passages between different texts: shorter than a window, nearly one and longer; runs of one byte; copies.
    passages = [noise(90), noise(250), noise(300), noise(345), noise(900)]
    rows = [(k, noise(rng.randrange(250, 500)) + passages[k % 5] + noise(rng.randrange(250, 500))) for k in range(100)]
    rows += [(200 + k, noise(50) + "z" * (380 + 9 * k) + "xy" * 220) for k in range(12)] + [(300, rows[4][1]), (301, rows[0][1])]
    df = spark.createDataFrame(rows, DOC)
    block = 6 * 736
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffix_dedup.cut_repeats(df, block=block).collect())
    assert got == removed_by_brute_force(rows)
    texts = df.selectExpr("md5(text) as whole", "text")
    filled, crowded = suffix_dedup._filters(texts, block)
    assert len(crowded) == len(suffix_dedup.WIDTHS) - 1
    dealt = suffix_dedup._segments(texts, filled, crowded).selectExpr("key", "segment", "octet_length(bytes) as n").distinct().groupBy("key").sum("n")
    assert dealt.agg({"sum(n)": "max"}).first()[0] <= block


def test_suffixes_are_sorted(monkeypatch):
    rng = random.Random(4)
    for alphabet in (b"ab", b"abcdefgh \n\xff\x00", b"a"):
        parts = [bytes(rng.choices(alphabet, k=rng.randrange(400, 900))) for _ in range(5)]
        parts += [parts[0][:450] + parts[1][:300], b"xy" * 300]
        sizes = np.array([len(p) for p in parts])
        s = suffix_dedup.Suffixes(np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes - 399)
        order, data = s.ordered(), s.data.tobytes()
        assert len(set(order.tolist())) == len(order)
        assert all(data[a : a + 400] <= data[b : b + 400] for a, b in zip(order, order[1:]))


# URL filters


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/75?x"), (2, None), (3, "nope"), (None, "x://com/en/"), (5, "a://b.com?x/en/"), (5, "a://org/es/#"), (7, "a://xorg/es/"),
        (8, "s://q.net/de/81"), (9, "s://q.example.net/de/81"), (9, "s://q.example.net/de/81"), (10, "s://example.com/en/7"), (11, "s://com/EN/"), (12, "://"),
        (13, "a\nb://x.com/en/\n"), (14, "s://" + "a." * 20 + "com/en/" + "p/" * 100), (15, ""), (16, "s://É.COM/en/é"), (17, "u://a://b.com/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as verdict")
    rules = spark.createDataFrame([*url_filter.RULES, ("com", None, "block")], "host string, path string, action string")
    con = duckdb.connect()
    frame(con, "pages", rows, "page_id BIGINT, url VARCHAR")
    want = sorted(map(str, con.execute(url_filter.OP6_SQL).fetchall()))
    for shapes in (256, 1):  # listed lengths, and all of them
        url_filter.SHAPES = shapes
        got = sorted(str(tuple(r)) for r in url_filter.filter_urls(df, rules).collect())
        assert got == want
    url_filter.SHAPES = 256
    assert {r["verdict"] for r in url_filter.filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_conflicting_rules_block(spark):
    df = spark.createDataFrame([(1, "s://a.b/x")], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/x", "allow"), ("b", "/x", "block"), ("b", "/", "allow")], "host string, path string, action string")
    assert url_filter.filter_urls(df, rules).first()["verdict"] == "block"


# Fixity


def test_audit_equals_comparison(spark):
    rng = random.Random(9)
    a, b = [], []
    for f in (None, 1, 2, 3):
        at = 0
        for _ in range(rng.randrange(1, 300)):
            d = f"{rng.random()}"
            kind = rng.random()
            if kind > 0.02:
                a.append((f, at, d))
            if kind < 0.97:
                b.append((f, at, d if kind < 0.95 else "rot"))
            at += rng.randrange(1, 500_000)
    a += a[:2]
    kinds = "file long, offset long, digest string"
    x, y = spark.createDataFrame(a, kinds).selectExpr("*", "1 as node"), spark.createDataFrame(b, kinds)

    def by_place(rows):
        out: dict = {}
        for f, o, d in rows:
            out.setdefault((f, o), []).append(d)
        return {k: ",".join(sorted(v)) for k, v in out.items()}

    left, right = by_place(a), by_place(b)
    want = {
        (*k, "corrupt" if k in left and k in right else "missing" if k in left else "extra", left.get(k), right.get(k)) for k in {*left, *right} if left.get(k) != right.get(k)
    }
    assert {tuple(r) for r in fixity.audit(x, y).collect()} == want
    assert fixity.audit(x, x).count() == 0 and fixity.audit(x.limit(0), y.limit(0)).count() == 0
    assert {r["state"] for r in fixity.audit(x, y.limit(0)).collect()} == {"missing"}


def test_audit_hashes_the_bytes_of_both_replicas(spark):
    a = [(f, 1000 * n, f"{f} {n}".encode()) for f in (None, 1, 2) for n in range(900)]
    b = [(f, o, p[:-1] + b"!" if o % 97_000 == 5000 else p) for f, o, p in a if o % 101_000 != 7000]
    b += [(2, 900_500, b"added"), (3, 0, b"added"), (1, 2_000_000, None)]
    kinds = "file long, offset long, payload binary"
    digest = lambda p: None if p is None else hashlib.sha256(p).hexdigest()
    left, right = {x[:2]: digest(x[2]) for x in a}, {x[:2]: digest(x[2]) for x in b}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in fixity.audit(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds)).collect()}
    for k in {*left, *right} - {(1, 2_000_000)}:
        if left.get(k) == right.get(k):
            assert k not in got
        else:
            assert got[k] == ("corrupt" if k in left and k in right else "missing" if k in left else "extra", left.get(k), right.get(k))
    assert got[(1, 2_000_000)][0] == "extra" and len({s for s, *_ in got.values()}) == 3
    pages = spark.createDataFrame([(1, "u", "é"), (5, "u", "é"), (7, "v", "x"), (None, None, None)], "page_id long, url string, html string")
    whole, damaged = ({tuple(r)[:2]: bytes(r["payload"]) for r in f.select("file", "offset", "payload").collect()} for f in (fixity.archive(pages, with_bytes=True), fixity.replica(pages)))
    assert len(whole) == 4 and len(damaged) == 3
    assert sorted(damaged[k] == whole[k] for k in damaged) == [False, True, True]


def test_archive_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (1, "u", "é"), (None, None, None), (5000, "v", "")], "page_id long, url string, html string")
    rows = sorted(map(tuple, fixity.archive(pages).select("file", "offset", "length").collect()))
    assert [(max(-1, r[0]), r[1]) for r in rows] == [(-1, 0), (0, 0), (0, rows[1][2]), (1, 0)]


# Registered queries with SQL


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).values.tolist())) for x in (got, want)]
    assert text[0] == text[1]


def test_shuffle_files_go_when_a_checkpoint_is_written(spark):
    from wakeline.llm import shared

    def shuffles() -> set[str]:
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for n in range(blocks.size()) if (x := blocks.apply(n).toString()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting, "false"), shuffles()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count")
    kept = shared.cut(df)  # df is still there, which keeps the files of its shuffles without the setting
    end = time.monotonic() + 20
    while (left := shuffles() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting, "false") == was
    assert kept.count() == df.count() == 7 and df.agg(F.sum("count")).first()[0] == 1000
