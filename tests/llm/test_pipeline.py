"""The pipeline's stages over a small table, and the same with plain Python from the same model."""

import random
from itertools import combinations

import sentencepiece
import public_tokenizers

import corpus_pipeline as cp
from sparkwright.llm import quality
from sparkwright.llm.queries import ORACLE, QUERIES


def table(r):
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(260):
        t = ". ".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 12))).capitalize() for _ in range(r.randint(2, 8))) + "."
        if i % 10 == 9:
            t = " | ".join(t.split())
        elif i % 13 == 5 and rows:
            t = rows[-3][1]
        elif i % 13 == 6 and rows:
            t = rows[-2][1] + " tail"
        rows.append((i, t, "en", f"src{i % 6}", len(t)))
        labels.append((i, int(i % 10 != 9), 0))
    return rows, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = table(random.Random(8))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(quality.feature_table(docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import pyarrow as pa

    good = [r for r, s in zip(rows, model.score(quality.features(pa.array([r[1] for r in rows]))), strict=True) if s >= 0.7]
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].lower().split()] for i in range(len(w) - 4)} for r in good}
    root = {k: k for k in sets}
    for _ in range(5):
        for a, b in combinations(sorted(sets), 2):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    left = {k for k in root if root[k] == k}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r[0]: len(lib.encode(r[1], add_bos=True, add_eos=True)) for r in good if r[0] in left}
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want) < len(good) < len(rows)
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns


def test_every_operator_is_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "mixing", "tokens"]

def test_stages_with_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    line = "seven words of prose that say little. "
    rows = [
        (1, line * 3, "src1"), (1, "quite another text of the same id, with words enough for some shingles.", "src1"),
        (1, line * 3, "src1"), (2, line * 3 + "End.", None), (None, line * 3, "src2"), (None, None, None), (3, "", "src3"), (3, "", "src3"), (4, None, "x"),
        (5, "Long text here. " * 40_000, "src4"), (6, "Long text here. " * 40_000, "src4"), (7, line * 3, "src1"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumn("_bits", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("key", F.lit(3)).withColumn("row", F.lit(None).cast("string")).withColumn("maybe", F.create_map(F.lit("k"), F.lit(1)))
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for part, empty in ((labels, False), (labels.limit(0), True)):
        at = f"{tmp_path}/{empty}"
        part.write.parquet(f"{at}/labels.parquet")
        out = odd.limit(0) if empty else odd
        for name, stage in cp.STAGES:
            out = stage(spark, out, at)
            if name != "tokens":
                assert out.columns == odd.columns
            out.write.parquet(f"{at}/{name}")
            out = spark.read.schema(out.schema).parquet(f"{at}/{name}")
            if name in ("quality", "mixing"):
                continue
            ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))
            assert ids == ([] if empty else [1, 1, 3, 3, 4, 5, None, None]), name
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/False/near_duplicates").filter("doc_id = 1").collect()]
    assert sorted(texts) == sorted([rows[0][1], rows[1][1]])
