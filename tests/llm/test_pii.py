"""Planted cases of surrogates."""

import re

from strikeframe.llm import pii


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: r for r in pii.surrogates(docs, "key").collect()}


def test_masked_values_stay_and_other_scripts_change(spark):
    masks = ["password: ********", "token = ........", 'pwd="######" set']
    others = ["Mr Արամ", "password: !@#$%^&*", "write to երգ@երգ.org"]
    got = replaced(spark, masks + others)
    assert all(got[t].text == t and got[t].n_entities == 0 for t in masks)
    assert all(got[t].text != t and got[t].n_entities == 1 for t in others)
    assert "Արամ" not in got[others[0]].text and "!@#" not in got[others[1]].text and "երգ" not in got[others[2]].text


def test_forms_with_too_few_members(spark):
    """All listed names, all short surnames of one form, all values of one digit: no surrogate is free in the form."""
    texts = [f"Mr {n}" for n in pii.GIVEN["latin_m"]] + [f"Mr {a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"] + [f"password: *****{i}" for i in range(10)]
    got = replaced(spark, texts)
    new = [got[t].text for t in texts]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)

#: Texts that hold one entity only, and the part that mustn't stay.
ALONE = {
    "email": [("write to ann@example.org", "ann@")],
    "password": [("password: swordfish", "swordfish"), ("Token : opensesame", "opensesame"), ("pwd=swordfish", "swordfish")],
    "secret": [("sk_" + "abcdefgh" * 3, "abcdefgh"), ("pk-" + "qrstuvwx" * 3, "qrstuvwx"), ("AKIA" + "ABCDEFGH" * 2, "ABCDEFGH"), ("xoxb-" + "abcdefgh" * 2, "abcdefgh"), ("ghp_" + "abcdefgh" * 4, "abcdefgh"), ("abcdef" * 6, "abcdef" * 6)],
    "account": [("DE89 3704 0044 0532 0130 00", "3704 0044")],
    "ip": [("host 192.0.2.17 is up", "192.0.2.17")],
    "hardware": [("at ab:cd:ef:ab:cd:ef now", "ab:cd:ef:ab"), ("at AB-CD-EF-AB-CD-EF now", "AB-CD-EF-AB")],
    "ip6": [("at abcd:ef:abcd:ef:abcd:ef:abcd:ef now", "abcd:ef:abcd:ef")],
    "phone": [("call +49 30 1234567", "1234567"), ("call 030 1234567", "1234567"), ("call +49 (0)30 1234567", "1234567"), ("call 020 7946 0958", "7946 0958"), ("call 01 23 45 67 89", "23 45 67 89"), ("call (030) 123456", "123456"), ("call +1 555-123-4567", "123-4567")],
    "social": [("number 078-05-1120", "05-1120")],
    "card": [("card 4111 1111 1111 1111", "1111 1111 1111"), ("card 0123 4567 8901 2345", "4567 8901 2345")],
    "name": [("Mr Smith", "Smith"), ("Anna Becker", "Becker")],
}
NOT_ONE = ["on 01.02.2024 and 05-2024", "0.12345678 of 2024 12345", "a list: of things, 12:30", "no secret in here"]


def test_every_kind_alone(spark):
    assert set(ALONE) == set(pii.KINDS)
    rows = [(kind, text, part) for kind, cases in ALONE.items() for text, part in cases]
    got = replaced(spark, [text for _, text, _ in rows] + NOT_ONE)
    for kind, text, part in rows:
        assert got[text].entity_kinds == [kind] and got[text].n_entities == 1 and part not in got[text].text, got[text]
    assert all(got[t].text == t for t in NOT_ONE)
    # one number in three writings
    own = {re.sub("[^0-9]", "", got[t].text)[-9:] for t in ("call +49 30 1234567", "call 030 1234567", "call +49 (0)30 1234567")}
    assert len(own) == 1


def test_marks_in_the_text_and_columns_named_alike(spark):
    rows = [(1, "a￿b write to ann@example.org￿", 5, 6), (2, "￿", 5, 6), (3, "ann@example.org,bob@example.org", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int, row int")
    got = {r.doc_id: r for r in pii.surrogates(docs, "key").collect()}
    assert got[2].text == "￿" and got[2].n_entities == 0
    assert got[1].text.startswith("a￿b write to ") and got[1].text.endswith(".org￿") and "ann@" not in got[1].text
    assert got[3].n_entities == 2 and got[1].text[len("a￿b write to ") : -1] == got[3].text.split(",")[0]
    assert {(r.pieces, r.row) for r in got.values()} == {(5, 6)}


def test_whole_table_by_a_plain_finder(spark):
    """Every text of the table, cut by another engine's search for each kind in turn at every place."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kinds = [regex.compile(p.replace(r"\k<mask>", "(?P=mask)")) for p in pii.KINDS.values()]

    def found(text):
        out, at = [], 0
        while at < len(text):
            hit = next((m for k in kinds if (m := k.match(text, at))), None)
            if hit:
                out.append(hit.span())
            at = hit.end() if hit else at + 1
        return out

    new = {r.doc_id: r for r in pii.surrogates(docs, "key").collect()}
    pairs, originals = set(), set()
    for doc_id, text in docs.collect():
        spans = found(text or "")
        assert new[doc_id].n_entities == len(spans), text
        edges = [0, *[e for s in spans for e in s], len(text or "")]
        between = [text[edges[i] : edges[i + 1]] for i in range(0, len(edges) - 1, 2)] if text else [""]
        shape = regex.fullmatch("(.+?)".join(map(regex.escape, between)), new[doc_id].text or "", regex.DOTALL)
        assert shape, (text, new[doc_id].text)
        said = [text[a:b] for a, b in spans]
        originals |= set(said)
        pairs |= set(zip(said, shape.groups(), strict=True))
    assert len(pairs) > 20
    # one surrogate for each entity, one entity for each surrogate, none that was there before
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert not {b for _, b in pairs} & originals
