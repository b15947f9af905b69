"""Offsets and cuts against plain Python over characters."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F

from strikeframe.llm import bpe, decontaminate, substring


def test_token_offsets_and_cut_ids(spark):
    texts = ["aé漢字 b", "👩‍🚀🜁𐍈 zażółć", "", "plain words", "한국어 テキスト"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = bpe.read_ranks(shared.value[0])
    table = {i: t for t, i in ranks.items()}
    rows = bpe.unpacked(bpe.encode(docs, shared, offsets="spans")).collect()
    split = 0
    for r in rows:
        character = [k for k, c in enumerate(r.text) for _ in c.encode()]
        at, want = 0, []
        for i in r.token_ids:
            end = at + len(table[i])
            want.append((character[at], character[end - 1] + 1))
            at = end
        assert [tuple(s) for s in r.spans] == want and at == len(r.text.encode())
        split += any(a[1] > b[0] for a, b in zip(want, want[1:]))
    assert split  # some character lies in several tokens
    cut = spark.createDataFrame([(r.doc_id, r.ids[:4]) for r in rows], "doc_id long, ids binary")
    got = {r.doc_id: r for r in bpe.decode(cut, shared).withColumn("shown", bpe.as_text()).collect()}
    for r in rows:
        begin = b"".join(table[i] for i in r.token_ids[:1])
        assert bytes(got[r.doc_id].decoded) == begin and got[r.doc_id].shown.rstrip("�") == begin.decode("utf-8", "ignore")


def test_decontamination_spans(spark):
    words = [f"wörd{i}" for i in range(40)]
    text = "ßtart; " + ", ".join(words[:20]).upper().replace("Ö", "ö") + " — ende 漢字. " + " ".join(words[25:39])
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words[2:18])), (8, " ".join(words[25:40]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_items(docs, items, spans="spans").collect()}
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    want = [(at[a][0], at[b - 1][1]) for a, b in got[1].hit_ranges]
    assert [tuple(s) for s in got[1].spans] == want and len(want) == 2 and got[1].item_ids == ["8", "9"]
    assert got[2].spans == [] and got[3].spans == []


def test_replacement_characters_stay_and_characters_are_whole(spark):
    rng = random.Random(4)
    passage = " ".join(f"größe{rng.randrange(4000)}漢" for _ in range(80))
    rows = [(1, "lead � mark " + passage), (2, "another � start " + passage + " � end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in substring.without_repeats(docs).collect()}
    assert kept[1] == rows[0][1]
    assert kept[2].startswith("another � start ") and kept[2].endswith("� end") and len(kept[2]) < 0.5 * len(rows[1][1])
    assert substring.left_over("aé漢b".encode(), [{"start": 2, "end": 5}]).decode() == "aé漢b"
    assert substring.left_over("aé漢b".encode(), [{"start": 1, "end": 5}]).decode() == "a漢b"


def test_planted_passages_are_found(spark):
    """Of passages of 60 words that two to five texts share, nine in ten are found, and what is found is repeated."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    texts = [[word() for _ in range(rng.randrange(20, 300))] for _ in range(200)]
    planted = []
    for _ in range(60):
        passage = [word() for _ in range(60)]
        for d in rng.sample(range(200), rng.randrange(2, 6)):
            cut = rng.randrange(len(texts[d]) + 1)
            texts[d][cut:cut] = passage
            planted.append((d, " ".join(passage)))
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.passages for r in substring.repeats(docs).collect()}
    first = {}
    for d, p in planted:
        first[p] = min(d, first.get(p, d))
    later = [(d, p) for d, p in planted if d != first[p] and p in rows[d]]
    caught = sum(any(p in rows[d] and rows[d].encode()[x.start : x.end].decode("utf-8", "ignore")[8:-8] in p for x in got.get(d, [])) for d, p in later)
    assert len(later) > 60 and caught >= 0.9 * len(later)
    for d, passages in got.items():
        for x in passages:
            piece = rows[d].encode()[x.start : x.end]
            assert len(piece) >= substring.LEAST_RUN and any(piece[:60] in rows[s].encode() for s in x.source_ids)
