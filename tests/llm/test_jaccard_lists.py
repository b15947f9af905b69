"""Lists that hold several components, with blocks of a few members."""

import random

import pytest

from strikeframe.llm import jaccard


@pytest.mark.parametrize("block", [2, 3, 512])
def test_links_across_blocks(spark, monkeypatch, block):
    from test_contracts import linked

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            words[at] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r) for r in got} == linked(rows)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {1}
