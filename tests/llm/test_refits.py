"""Operators without SQL against plain versions of their own: the classifier refitted in numpy, chunks cut byte by byte."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strikeframe.llm import decontaminate, quality, substring


def test_quality_as_numpy_fits_it(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))
    rows = []
    for i in range(300):
        low = i % 4 == 0
        words = [w.upper() + "!" if low and rng.random() < 0.7 else w for w in (word() for _ in range(rng.randint(3, 80)))]
        rows.append((i, " ".join(words), int(not low)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, F.col("doc_id") % 3 != 0).collect()}

    stats = {r.doc_id: (np.array(r.statistics), r.fold) for r in quality.with_statistics(docs, keep=["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect()}
    ids = [i for i, _, _ in rows if i % 3]
    x, fold = np.array([stats[i][0] for i in ids]), np.array([stats[i][1] for i in ids])
    y = np.array([float(rows[i][2]) for i in ids])
    model = quality.Model(x.mean(0), x.std(0), float(y.mean()))
    phi = model.features(x)
    solve = lambda a, b: np.linalg.solve(a.T @ a + quality.RIDGE * np.eye(a.shape[1]), a.T @ b)
    raw = np.empty(len(y))
    for k in range(quality.FOLDS):
        raw[fold == k] = phi[fold == k] @ solve(phi[fold != k], y[fold != k])
    bins = defaultdict(list)
    for r, v in zip(raw, y, strict=True):
        bins[round(max(-2.0, min(3.0, r)), 3)].append((r, v))
    blocks = []  # pool adjacent violators
    for b in sorted(bins):
        r, v = np.array(bins[b]).T
        blocks.append([r.sum(), v.sum(), len(r)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    every = np.array([stats[i][0] for i, _, _ in rows])
    want = np.clip(np.interp(model.features(every) @ solve(phi, y), [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]), 0, 1)
    assert max(abs(got[i] - w) for (i, _, _), w in zip(rows, want, strict=True)) < 1e-6


def plain_chunks(text):
    """Ends of chunks, by the rule of the module, a byte at a time."""
    codes = [int(c) for c in substring.GEAR]
    h = []
    for i in range(len(text)):
        h.append(sum(codes[text[i - k]] << k for k in range(min(i + 1, substring.WINDOW))) % 2**32)
    at = [i + 1 for i in range(len(text)) if h[i] < 2**32 // substring.ONE_IN and i + 1 >= substring.WINDOW]
    ends = {b for a, b in zip([-(10**9), *at], at) if b - a >= substring.SHORTEST} | ({len(text)} if text else set())
    for a, b in zip([0, *sorted(ends)], sorted(ends)):
        if b - a > substring.LONGEST:
            inner = range(a + substring.WINDOW - 1, b - 1)
            least, last = min(h[i] for i in inner), -(10**9)
            for i in inner:
                if h[i] == least and i + 1 >= last + substring.QUARTER:
                    ends.add(i + 1)
                    last = i + 1
    for a, b in zip([0, *sorted(ends)], sorted(ends)):
        ends |= set(range(a + substring.LONGEST, b, substring.LONGEST))
    return sorted(ends)


def plain_repeats(rows):
    first, chunks = {}, {}
    for i, text in sorted(rows):
        chunks[i] = [(a, b) for a, b in zip([0, *plain_chunks(text)], plain_chunks(text))]
        for a, b in chunks[i]:
            first[text[a:b]] = min(first.get(text[a:b], (i, a)), (i, a))
    out = {}
    for i, text in rows:
        runs = []
        for a, b in chunks[i]:
            source = first[text[a:b]]
            if source == (i, a):
                continue
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
                runs[-1][2].add(source[0])
            else:
                runs.append([a, b, {source[0]}])
        runs = [(a, b, sorted(s)) for a, b, s in runs if b - a >= substring.LEAST_RUN]
        if runs:
            out[i] = runs
    return out


def test_chunks_as_a_plain_chunker_cuts_them(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("abcdef é", k=n))
    shared = [noise(rng.randint(150, 700)) for _ in range(6)]
    rows = [(i, (noise(rng.randint(0, 300)) + rng.choice(shared) + noise(rng.randint(0, 90)) + rng.choice(shared)).encode()) for i in range(60)]
    rows += [(60, b"ab" * 900), (61, b"x" * 700), (62, b""), (63, b"ab" * 900)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: [(p.start, p.end, p.source_ids) for p in r.passages] for r in substring.repeats(docs).collect()}
    assert got == plain_repeats(rows)


def test_different_texts_of_one_id_lose_their_own_passages(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared, alone, other = noise(420), noise(440), noise(300)
    rows = [(1, shared, 0), (5, alone + shared, 1), (5, other + noise(100), 2), (5, alone + shared, 3), (None, shared, 4)]
    got = {r.at: r.kept_text for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, at int")).collect()}
    assert got[0] == shared and got[4] == shared and got[2] == rows[2][1] and got[1] == got[3]
    assert alone[:300] in got[1] and len(got[1]) < len(alone) + 200


def test_a_benchmark_in_parts_hits_alike(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(f"i{k}", text(rng.choice([3, 20, 40]))) for k in range(40)] + [("i1", text(15)), (None, text(14)), ("e", "")]
    docs = [(i, f"{text(30)}. {rng.choice(items)[1].upper()}, {text(9)} {items[i % 40][1]}") for i in range(50)] + [(1, None), (2, ""), (3, text(200)), (3, text(200))]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, `hit.n` int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    size = sum(len(t.encode()) for _, t in items)
    order = lambda df: sorted(map(repr, df.select("doc_id", "text", "hit_ranges", "item_ids", "n_words", "spans", "`hit.n`").collect()))
    whole = decontaminate.find_items(frame, bench, spans="spans")
    assert order(decontaminate.find_items(frame, bench, spans="spans", most_bytes=size // 10)) == order(whole)
    assert whole.where(F.size("item_ids") > 0).count() > 20


def test_clean_keeps_columns_of_any_name(spark):
    bench = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three", 5, [1], 2, "x"), (2, "nothing here", 6, [2], 3, "y"), (3, None, 7, None, None, None)], "doc_id long, text string, n_words int, hit_ranges array<int>, `a.b` int, item_ids string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(2, "nothing here", 6, [2], 3, "y"), (3, None, 7, None, None, None)]
