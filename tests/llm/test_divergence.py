"""Source divergence against a plain count."""

import re
from collections import Counter, defaultdict

import pytest

from strikeframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def plain(rows, least, ranks):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    kept = {g: {t for t, n in c.items() if n >= least} for g, c in df.items()}
    p, q = {}, {}
    for (g, s), c in groups.items():
        total = sum(c[t] for t in kept[g])
        of_lang = Counter()
        for (g2, _), c2 in groups.items():
            if g2 == g:
                of_lang.update({t: c2[t] for t in kept[g]})
        v = len(kept[g])
        for t in kept[g]:
            p[g, s, t] = 1 + 10**9 * (c[t] + 5) // (total + 5 * v)
            q[g, t] = 1 + 10**9 * (of_lang[t] + 5) // (sum(of_lang.values()) + 5 * v)
    out = set()
    for g, s in groups:
        pairs = [(-sum(abs(p[g, s, t] - p[g, o, t]) for t in kept[g]), o.encode()) for g2, o in groups if g2 == g and o != s]
        own = [(q[g, t] - p[g, s, t], t.encode()) for t in kept[g] if groups[g, s][t] and p[g, s, t] > q[g, t]]
        out |= {(g, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)}
        out |= {(g, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(own)[:ranks], 1)}
    return out


ROWS = [
    (1, "The cat, the DOG\x00fox É é", "en", "a", "x", 1),
    (1, "The cat, the DOG\x00fox É é", "en", "a", "x", 1),
    (2, None, "en", "b", None, None),
    (3, "dog dog dog cat", "en", "c", "x", 1),
    (4, "cat " * 5000 + "fox", "en", "c", "x", 1),
    (5, "", None, None, "x", 1),
    (6, "cat 12 [x] dog", None, "a", "x", 1),
    (7, "der Hund", "de", "a", "x", 1),
    (8, "der Hund", "de", "b", "x", 1),
    (None, "the fox's dog", "en", "b", "x", 1),
]


@pytest.mark.parametrize("least, ranks", [(1, 50), (2, 50), (2, 1), (99, 50)])
def test_equals_a_plain_count(spark, least, ranks):
    got = divergence.audit(spark.createDataFrame(ROWS, SCHEMA), least, ranks, salts=3).collect()
    want = plain(ROWS, least, ranks)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
