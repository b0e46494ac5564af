"""</head> is optional."""

from sparkwright.llm import blocks


def test_open_head():
    closed = "<html><head><meta charset=utf-8><title>T</title></head><body><p>text</p></body></html>"
    want = blocks.cut(closed)
    assert [t for _, t, _ in want] == ["text"]
    assert blocks.cut(closed.replace("</head>", "")) == want
    for page in ("<head><title>T</title><p>text", "<head><title>T</title>text", "<head><script>x</script><b>text</b>", "<head><template><p>no</p></template><div>text</div>", "<head><link rel=x><br>text"):
        assert [t for _, t, _ in blocks.cut(page)] == ["text"], page


def test_open_head_row(spark):
    prose = "This is a long paragraph of plain prose, with commas, and a full stop at its end. " * 4
    page = f"<html><head><title>T</title></head><body><article><p>{prose}</p><p>{prose}</p></article></body></html>"
    rows = blocks.extract(spark.createDataFrame([(1, "u", page), (2, "u", page.replace("</head>", ""))], "page_id long, url string, html string")).collect()
    assert len({(r["text"], r["n_chars"]) for r in rows}) == 1 and rows[0]["n_chars"] > 0
