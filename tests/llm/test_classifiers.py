import duckdb
import numpy as np
import pyarrow as pa

from millrace.llm import langid, quality
from millrace.llm.queries import op3_language_id, op7_quality_classifier

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = op3_language_id(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_quality_held_out(spark):
    label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = op7_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    print("quality accuracy", np.mean([r.predicted == label[r.doc_id] for r in held]), len(held))
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, quality int"
    empty, labels = spark.createDataFrame([], schema), spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert langid.languages(empty).count() == 0 and quality.quality_scores(empty, labels).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", "x", 1), (3, "12 !!", None, None, None), (5, "the house is big", "en", None, 1), (5, "la maison est grande", "fr", None, 1), (6, "a" * 300_000, "de", None, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(docs).collect()}
    assert (None, "und") in got and (1, "und") in got and (3, "und") in got
    assert {r.predicted for r in quality.quality_scores(docs, labels).collect()} <= {0, 1}


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(4)
    codes = [c for family in langid.FAMILIES.values() for c in family[:5]][:70]
    alphabets = {c: [chr(97 + k) for k in rng.permutation(26)[:6]] for c in codes}
    text = lambda c: " ".join("".join(rng.choice(alphabets[c], 5)) for _ in range(60))
    rows = [(i, text(c), c) for i, c in enumerate(c for n, c in enumerate(codes) for _ in range(8 if n < 64 else 6))]
    got = {r.doc_id: r.lang_pred for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(codes) == 70 and all(np.mean([got[i] == c for i, _, c in rows if c in some]) > 0.8 for some in (codes[:64], codes[64:]))


def test_word_vectors_cover_documents_outside_the_sample(spark):
    rows = [(1, "good words here", 1), (3, "bad words there", 0), (4, "zebra quagga okapi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs, docs.where("quality is not null"))
    codes, _, _ = quality.word_codes(np.frombuffer(b"zebra quagga okapi", np.uint8), np.array([0, 18]))
    own = quality._unit(quality.index_vectors(quality.BUCKETS, 1).astype(np.float32))
    assert np.allclose(np.linalg.norm(model.words[codes] - own[codes], axis=1), 1, atol=1e-5)


def test_word_vectors_are_sums_over_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "B", "c", "d!", "é"], n)) for n in (0, 1, 2, 3, 50, 400)] + ["", None, "x " * 50_000]
    index, want = quality.index_vectors(quality.BUCKETS, 1).astype(np.int64), np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
    for text in texts[:-1]:
        data = (text or "").encode()
        codes, _, _ = quality.word_codes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for i, c in enumerate(codes):
            for j in range(max(0, i - quality.REACH), min(len(codes), i + quality.REACH + 1)):
                want[c] += index[codes[j]] * (i != j)
    code = quality.word_codes(np.frombuffer(b"x", np.uint8), np.array([0, 1]))[0][0]
    want[code] += index[code] * 2 * sum(50_000 - k for k in range(1, quality.REACH + 1))
    docs = spark.createDataFrame([(t or "",) for t in texts], "text string").coalesce(2)
    assert (quality.context_vectors(docs) == want).all()
    pairs = [p for text in texts[:6] for p in quality.neighbours(*(lambda c: (c[0], c[2]))(quality.word_codes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))))]
    whole, parts = np.zeros_like(want), np.zeros_like(want)
    quality.add_neighbours(pairs, index.astype(np.int8), whole)
    monkeypatch.setattr(quality, "PAIR_BLOCK", 3)
    quality.add_neighbours(pairs, index.astype(np.int8), parts)
    assert (whole == parts).all() and whole.any()


def test_steps_do_not_change_features():
    texts = ["Ab ab!! x", "", "ÉTÉ  9 | 8", "same same same"]
    v, s = np.random.rand(quality.BUCKETS, quality.WIDTH), np.random.rand(quality.SHAPES, quality.WIDTH)
    whole = quality.pooled(pa.array(texts), v, s)
    assert all(np.allclose(quality.pooled(pa.array([t]), v, s)[0], w, atol=1e-5) for t, w in zip(texts, whole, strict=True))
    assert all(np.allclose(langid.grams(pa.array([t]))[0], w) for t, w in zip(texts, langid.grams(pa.array(texts)), strict=True))
