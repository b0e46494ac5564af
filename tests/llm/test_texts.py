"""SentencePiece, licenses, quality and pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from sparkwright.llm import licenses, quality, spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", " a  b ", "▁x", "x▁▁y", "\x00\x01", "naïve ﬁ Ａ", "日本語テキスト🙂🙃", "<s> </s> <unk>", "x" * 3000, "ab" * 40 + " " + "é" * 100, "12345 67,8", "\n\n\ttab\r\n", " " * 70, "word" * 20 + "▁" * 5, "́combining", "a" * 47, "b" * 48, "c" * 49]


def test_encoding_equals_the_library(spark):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("abcdeéñ ßt▁ \n.,0123") for _ in range(r.randint(1, 400))) for _ in range(200)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(3, texts[3], "twice", 1), (None, "null key", "", 0)]
    out = spm.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long"), MODEL, keep=True).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(out) == len(rows)
    for r in out:
        text = "null key" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert spm.encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_heap_and_batch_agree():
    m, r = spm.merger(MODEL), random.Random(1)
    units = list({"▁" + "".join(r.choice("abcdefghinorst") for _ in range(r.randint(1, 30))) for _ in range(500)})
    for u, ids in m.learn(units, check=True).items():
        assert np.frombuffer(ids, np.uint32).tolist() == m.encode_unit(u)


def test_license_scan(spark):
    notice = licenses.NOTICES["mit-permission"]
    w = notice.split()
    near = " ".join(w[:30] + ["changed"] + w[31:])
    filler = " ".join(f"word{i}" for i in range(900))
    texts = [filler, f"{filler} {notice.upper()} {filler}", f"{filler} {near}", "Released under the MIT License.", None, "", "released under the mit", f"{licenses.NOTICES['gpl-3.0-line']}\n{filler}\n{licenses.NOTICES['cc-by-nc-4.0-line']}", " ".join(w[:20]), filler * 20 + " released  UNDER the 'MIT' license"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "twice")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, template string")).collect()
    found = sorted((r["doc_id"], r["template"]) for r in got)
    assert found == [(1, "mit-permission"), (2, "mit-permission"), (3, "mit-line"), (3, "mit-line"), (7, "cc-by-nc-4.0-line"), (7, "gpl-3.0-line"), (9, "mit-line")]
    shares = {r["doc_id"]: r["containment"] for r in got}
    assert shares[1] == 1.0 and 0.8 <= shares[2] < 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_find_what_containment_finds():
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    templates = {f"t{i}": " ".join(r.choice(words) for _ in range(r.choice([4, 6, 9, 30, 70]))) for i in range(12)}
    known = licenses.groups(templates)
    for _ in range(60):
        name = r.choice(sorted(templates))
        text = [r.choice(words) for _ in range(r.randint(0, 200))]
        at = r.randint(0, len(text))
        text[at:at] = templates[name].split()
        hashes, _ = licenses.words(*licenses.buffers(pa.array([" ".join(text)])), licenses.LOWER, licenses.APART)
        found = {n for g in known for n in g.matches(licenses.shingles(hashes, g.k), 0.8)}
        assert name in found


def clean(r):
    vocabulary = [f"{a}{b}" for a in ("ta", "re", "mo", "lin") for b in ("n", "sel", "dor", "ka", "")]
    return ". ".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(4, 14))).capitalize() for _ in range(r.randint(1, 12))) + "."


def test_quality_holds_out_and_separates(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(800):
        good = r.random() < 0.7
        t = clean(r)
        t = t if good else r.choice([" | ".join(t.split()), " ".join(w + "$$$" for w in t.split()), t.upper() + "!!", " ".join(t.split()[:1] * 60)])
        rows.append((i, t, "en", "s", 0.5))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", "", "", 0.1), (902, "ok " * 50_000, "en", "s", 0.2), (7, rows[7][1], "en", "s", 0.5), (None, "Null key.", "en", "s", 0.1)]
    labels += [(None, 1, 0), (901, None, None), (77777, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    table = quality.feature_table(docs)
    model = quality.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.score_table(table, model).collect()
    assert len(got) == len(rows)
    known = {i: q for i, q, _ in labels if q is not None}
    held = [x for x in got if x["held_out"] and x["doc_id"] in known]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    assert np.mean([x["predicted"] == known[x["doc_id"]] for x in held]) > 0.97
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x["predicted"] for x in got)


def test_quality_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(quality.feature_table(docs), none)
    assert quality.kept(docs, model).count() == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score_table(quality.feature_table(empty), quality.fit(quality.feature_table(empty), none)).count() == 0


def test_scores_match_plain_densities(spark):
    r = np.random.default_rng(0)
    d = len(quality.FEATURES)
    m = quality.Model(None, np.zeros(d), np.ones(d), (np.zeros(d), np.ones(d)), (np.eye(d), np.eye(d) * 2), (0.0, -1.0), 4.0)
    x = r.normal(size=(5, d))
    want = 1 / (1 + np.exp(-((-1 - 0.5 * (((x - 1) * 2) ** 2).sum(axis=1)) - (-0.5 * (x**2).sum(axis=1))) / 4))
    assert np.allclose(m.score(x), want)
