"""WARC packages and HTML extraction."""

import hashlib
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from sparkwright.llm import blocks, train_blocks, warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    big = "<p>é" * 200
    rows = [(3, "http://a/b c?ü=1\r\nX: y", big, "clash"), (1, None, big, None), (2, "u", big, None), (5, "u", "small", None), (4, "u", "small", None), (6, "u", None, None), (7, "u", "", None), (8, "u", "x" * 300_000, None), (9, "u", "y" * 100, None), (10, "u", "y" * 100, None), (11, "u", "y" * 99, None), (12, "u", "y" * 99, None), (1, None, big, None), (None, "u", big, None), (None, "u", "lone" * 90, None)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for k, _, h, _ in rows:
        p = (h or "").encode()
        same = [a for a, _, b, _ in rows if b == h and a is not None]
        first = min(same) if same and len(p) >= 100 and sum(b == h for _, _, b, _ in rows) > 1 else None
        refers = first if first is not None and (k is None or k > first) else None
        want.append((k, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packages_are_plain_zip_files(tmp_path, monkeypatch):
    import gzip

    package = warc.Package(f"file://{tmp_path}")
    for i in range(5):
        body = f"page {i}".encode()
        package.add(i, warc.record(i, "http://x/", "response", hashlib.sha256(body).hexdigest(), None, body, len(body)))
    name, n = package.close()
    monkeypatch.setattr(warc, "RANGE", 10)
    back = list(warc.read_package(fs.LocalFileSystem(), f"{tmp_path}/{name}"))
    assert n == 5 and [(r["key"], r["payload"]) for r in back] == [(i, f"page {i}".encode()) for i in range(5)]
    with zipfile.ZipFile(tmp_path / name) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert gzip.decompress(z.read(warc.ARCHIVE)).count(b"WARC/1.1\r\n") == 5


def test_zip64_directories_and_damage(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than the plain directory can count
            z.writestr(f"m{i}", b"x")
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"hello")
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = warc.members(f)
        at, n = found["wide"]
        f.seek(at)
        assert len(found) == 66_001 and f.read(n) == b"hello"
    bad = tmp_path / "bad.zip"
    bad.write_bytes(b"no archive")
    with fs.LocalFileSystem().open_input_file(str(bad)) as f, pytest.raises(ValueError):
        warc.members(f)
    packed = tmp_path / "packed.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with fs.LocalFileSystem().open_input_file(str(packed)) as f, pytest.raises(ValueError):
        warc.members(f)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy &amp; save now.</div>
<article><h1>Title  of it</h1><p><b>First &lt;part&gt;<br>second part.<br><p>Third, with <a href="x">a link</a> inside &eacute;&#233;.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/p">Other story</a></li></ul></aside>
<section class="comments"><div class="comment"><p>I liked it a lot.</p></div></section>
<form><label>Your email</label><button>Subscribe</button></form><footer>&copy; site. All rights reserved.</footer>"""


def test_extraction_of_a_page(spark):
    rows = [(1, "u", PAGE, "clash", 5), (2, None, None, None, None), (3, "v", "", "", 0), (1, "u", PAGE, "again", 5), (4, "w", "<script>only()", "", 0), (5, "w", "<article>" + "<p>Long text of a page.</p>" * 3000 + "</article>", "", 1)]
    got = blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["text"] == "Title of it First <part> second part. Third, with a link inside éé."
    assert by[2]["text"] == by[3]["text"] == by[4]["text"] == "" and by[2]["url"] is None
    assert by[5]["text"] == " ".join(["Long text of a page."] * 3000) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_cutting_tolerates_broken_markup():
    for page in ("<", "<p", "a < b > c", "<p a='>x", "</p></div>", "<!-- open", "<b><i>x</b>y", "<p>" * 2000 + "deep", "&nbsp;&#x41;&bogus;", "<svg/><p>x", "<textarea><p>t</textarea>u"):
        assert all(t for _, t, _ in blocks.cut(page))
    assert [t for _, t, _ in blocks.cut("x<!-- y > --> z<p>\n a  b\t")] == ["x z", "a b"]


def test_labeller_on_pages_not_trained_on():
    assert train_blocks.accuracy(blocks.Labeller.load().w, seed=5, pages=150) > 0.98


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    x, y, m = train_blocks.padded([(r.normal(size=(n, blocks.WIDTH)).astype(np.float32), (r.random(n) > 0.5).astype(np.float32)) for n in (3, 5)])
    u = 3
    w = {"v": r.normal(size=2 * u), "c": np.zeros(1)}
    for d in "fb":
        w |= {f"wx{d}": r.normal(size=(blocks.WIDTH, 4 * u)) * 0.1, f"wh{d}": r.normal(size=(u, 4 * u)) * 0.3, f"b{d}": np.zeros(4 * u)}
    _, g = train_blocks.gradients(w, x.astype(float), y, m)
    for k in w:
        at = tuple(int(r.integers(n)) for n in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (train_blocks.gradients(up, x.astype(float), y, m)[0] - train_blocks.gradients(down, x.astype(float), y, m)[0]) / 2e-4
        assert abs(slope - g[k][at]) < 2e-3 + 0.05 * abs(slope), k


def test_one_page_or_many_give_the_same():
    labeller = blocks.Labeller.load()
    pages = [train_blocks.Writer(i).page().replace(train_blocks.YES, "").replace(train_blocks.NO, "") for i in range(40)]
    assert labeller.texts(pages, together=7) == [labeller.texts([p])[0] for p in pages]
    assert pa.array(labeller.texts([])).null_count == 0


def test_pages_that_are_hard_to_cut():
    import time

    began = time.time()
    got = blocks.Labeller.load().texts(["<a " * 350_000, "<div>x" * 100_000, "<b>" * 100_000 + "<div></div>" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<a \"'>x" * 100_000])
    assert len(got) == 5 and time.time() - began < 60
    assert [t for _, t, _ in blocks.cut("<a " * 5)] == ["<a <a <a <a <a"]
    assert [t for _, t, _ in blocks.cut("<math>a + b</math><object>c</object><p>d<canvas>e</canvas>")] == ["a + b", "c", "d", "e"]


def test_long_pages_are_read_in_runs(monkeypatch):
    labeller = blocks.Labeller.load()
    pages = [train_blocks.Writer(i).page().replace(train_blocks.YES, "").replace(train_blocks.NO, "") for i in range(12)]
    want = labeller.texts(pages)
    for run in (1, 7, 40):
        monkeypatch.setattr(blocks, "RUN", run)
        assert labeller.texts(pages) == want


def test_states_of_a_page_by_plain_loops():
    """The labeller's probabilities against a second version: one page, one block, one unit at a time."""
    import math

    w = {k: v.astype(float) for k, v in blocks.Labeller.load().w.items()}
    found = blocks.cut(train_blocks.Writer(3).page().replace(train_blocks.YES, "").replace(train_blocks.NO, ""))[:12]
    x, units = blocks.vectors(found).astype(float), len(w["whf"])

    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    sums = [float(w["c"].item())] * len(x)
    for d, way, at in (("f", range(len(x)), 0), ("b", range(len(x) - 1, -1, -1), units)):
        h, c = [0.0] * units, [0.0] * units
        for t in way:
            gate = [sum(x[t][i] * w[f"wx{d}"][i][j] for i in range(len(x[t]))) + sum(h[i] * w[f"wh{d}"][i][j] for i in range(units)) + w[f"b{d}"][j] for j in range(4 * units)]
            c = [sigmoid(gate[units + j]) * c[j] + sigmoid(gate[j]) * math.tanh(gate[3 * units + j]) for j in range(units)]
            h = [sigmoid(gate[2 * units + j]) * math.tanh(c[j]) for j in range(units)]
            sums[t] += sum(h[j] * w["v"][at + j] for j in range(units))
    got = blocks.Labeller.load().probabilities(lambda a, b: (blocks.vectors(found[a:b])[:, None, :], np.ones((b - a, 1), bool)), len(found), 5)[:, 0]
    assert np.allclose(got, [sigmoid(s) for s in sums], atol=1e-4)
