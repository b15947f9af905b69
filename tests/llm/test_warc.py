"""Pages without an id."""

from strikeframe.llm import warc


def test_pages_without_id(spark, tmp_path):
    long = "<p>" + "x" * 200
    pages = [(None, "u", long), (None, "u", long), (7, "v", long), (8, "v", long), (None, None, None), (-3, "w", "same")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    want = [(-3, "response", None), (7, "response", None), (8, "revisit", 7), *[(None, "response", None)] * 3]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(bytes(r.payload or b"") == long.encode() for r in got) == 3
