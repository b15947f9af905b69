"""Fuzzy candidates against every pair."""

import random

from strikeframe.operators import joins

NAMES = ["jon jones", "jones jon", "jom jones", "khabib nurmagomedov", "nurmagomedov khabibb", "habib nurmagomedov", "amanda nunes", "mandy nunez", "nunes a", "li", "il", "x", "", "aaaa aaab", "baaa aaaa", "max holloway", "holoway max", "rose", "roze namajunas", "rose namajunas"]


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 0.0


NAMES += ["a" * 30 + " " + "b" * 45, "a" * 29 + " " + "b" * 45, "o'neil-smith jo", "oneil smith jo", "li na", "na li", "lina", "ab", "abc"]


def test_every_pair(spark):
    for least, k in ((70.0, 3), (40.0, 50), (95.0, 5)):
        df = spark.createDataFrame([(n,) for n in NAMES], "a string")
        got = joins.fuzzy_top_k(df, df.withColumnRenamed("a", "b"), "a", "b", k, least).collect()
        want = set()
        for a in NAMES:
            best = sorted((-ratio(a, b), b) for b in NAMES if a != b and ratio(a, b) >= least)[:k]
            want |= {(a, b, round(-s, 9), i + 1) for i, (s, b) in enumerate(best)}
        assert {(r.l, r.r, round(r.score, 9), r["rank"]) for r in got} == want
        assert any(a.split()[0] != b.split()[0] for a, b, _, _ in want if a and b)


def test_random_names_and_few_candidates(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ren", "to", "shi", "bar", "dun", "el", "vo", "gri", "pas", "que", "zor"]
    name = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(2, 3))) for _ in range(2))
    names = sorted({name() for _ in range(300)} | {f"{n}x" for n in (name() for _ in range(30))})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = {(a, b) for a in names for b in names if a != b and ratio(a, b) >= 85.0}
    pairs = {(r.ln, r.rn) for r in joins.similar_pairs(df, df, 85.0).collect()}
    assert want <= pairs and len(pairs) < 0.25 * len(names) ** 2
    got = joins.fuzzy_top_k(df, df.withColumnRenamed("n", "m"), "n", "m", 1000, 85.0).collect()
    assert {(r.l, r.r) for r in got} == want and all(abs(r.score - ratio(r.l, r.r)) < 1e-9 for r in got)


def test_alias_candidates(spark):
    names = ["al bo", "al bo cy", "al", "al cy", "al bo bo", "bo al", "alan bo", "al boo", "al x y z", "al z y x"]
    df = spark.createDataFrame([(n,) for n in names], "q string")
    want = {}
    for a in names:
        found = []
        for b in names:
            x, y = a.split(), b.split()
            if a == b or x[0] != y[0]:
                continue
            both = len({*x[1:]} & {*y[1:]})
            told = (95 + min(both, 3), "same_first_plus_overlap") if both else (97, "canonical_extends_query") if b.startswith(a + " ") else (94, "query_extends_canonical") if a.startswith(b + " ") else None
            like = ratio(a, b)
            if like >= 70 and (told is None or int(like) > told[0]):
                told = (int(like), "same_firstname_fuzzy")
            if told:
                found.append((-told[0], told[1], b))
        want[a] = [(b, -s, r) for s, r, b in sorted(found)[:4]]
    got = {}
    for r in joins.alias_candidates(df, df.withColumnRenamed("q", "n"), "q", "n", 4, 70.0).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.n, r.score, r.reason))
    assert got == {a: w for a, w in want.items() if w}


def test_pairs_grow_with_similar_names(spark):
    """Names of one length over few letters: only what is left of both is a key, so chance pairs don't arise."""
    rng = random.Random(5)
    names = sorted({"ann " + "".join(rng.choices("0123456789abcdef", k=12)) for _ in range(1500)})
    close = [n[:-1] + "g" for n in names[:20]] + [n[1:] for n in names[20:30]]
    left, right = spark.createDataFrame([(n,) for n in close], "n string"), spark.createDataFrame([(n,) for n in names], "n string")
    want = {(a, b) for a in close for b in names if a != b and ratio(a, b) >= 92.0}
    pairs = [(r.ln, r.rn) for r in joins.similar_pairs(left, right, 92.0).collect()]
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and len(want) >= 20 and len(pairs) < 2 * len(want)
