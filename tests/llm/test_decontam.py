import random
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from millrace.llm import decontam
from millrace.llm.queries import op4_benchmark_decontamination

SF = "/root/testdata/sf0.01"


def norm(t):
    return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))


def distance_within(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_matches_dynamic_programming():
    rng = random.Random(3)
    for k in range(10_000):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90 if k < 200 else 25)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120 if k < 200 else 35)))
        got = decontam.best_match(p, decontam._masks(p), t, len(p))
        assert (got[0] if got else len(p)) == distance_within(p, t)


def test_exact_passages(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = op4_benchmark_decontamination(spark, SF).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = {(d, i) for d, t in docs for i, q in items if norm(q) in norm(t)}
    assert want <= got and {(r.doc_id, r.item_id) for r in rows if r.distance == 0} == want


def test_brute_force_with_errors(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(6, 20)))) for k in range(12)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(60)]
        if d % 2:
            letters = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 12)):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["k"], [letters[at], "k"]])
            text[30:30] = ["".join(letters)]
        docs.append((d, " ".join(text)))
    want = {}
    for d, t in docs:
        for i, q in items:
            n = distance_within(norm(q), norm(t))
            if n <= len(norm(q)) // decontam.CHARS_PER_ERROR:
                want[d, i] = n
    b = spark.createDataFrame(items, "item_id long, text string")
    f = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (decontam.BLOCK_CHARS, 200):
        rows = decontam.matches(f, b, block_chars=size).selectExpr("doc_id", "text", "inline(matches)").collect()
        assert {(r.doc_id, r.item_id): r.distance for r in rows} == want
        texts = dict(items)
        assert all(distance_within(norm(texts[r.item_id]), norm(r.text)[r.match_start : r.match_end]) == r.distance for r in rows)
        assert {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(f, b, size).collect()} == {(*k, n) for k, n in want.items()}
        assert {r.doc_id for r in decontam.clean(f, b, size).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_items_that_repeat_their_own_pieces():
    assert decontam.Block([(1, "one two six red one two six ten x")]).search("ona two six rad one two six ten x")[0]["distance"] == 2
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(3)]
        item = " ".join(rng.choice(words) for _ in range(rng.randrange(12, 40)))
        letters = list(item)
        for _ in range(rng.randrange(0, len(item) // decontam.CHARS_PER_ERROR + 2)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["k"], [letters[at], "k"]])
        text = " ".join([*rng.choices(words, k=rng.randrange(30)), "".join(letters), *rng.choices(words, k=rng.randrange(30))])
        n = distance_within(item, text)
        got = decontam.Block([(1, item)]).search(text)
        assert [g["distance"] for g in got] == ([n] if n <= len(item) // decontam.CHARS_PER_ERROR else [])
        assert all(distance_within(item, text[g["match_start"] : g["match_end"]]) == n for g in got)


def test_short_items_and_scripts_without_blanks(spark):
    passage = "光合作用是植物利用阳光把二氧化碳和水变成糖和氧气的过程它发生在叶绿体之中并且为地球上几乎所有的生命提供能量"
    items = spark.createDataFrame([(1, "What is photosynthesis?"), (2, passage), (3, "Sun?"), (4, "光合作用"), (5, "การสังเคราะห์ด้วยแสงของพืช"), (6, "?!")], "item_id long, text string")
    texts = ["so: what is photosyntesis, then", "前言" + passage.replace("阳", "太") + "后记", "the sun. is up", "sunny sunsun", "我们学光合作用了", "พืชใช้การสังเคราะห์ด้วยแสงของพืชทุกวัน", "", "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, items).collect()}
    assert got == {(0, 1, 1), (1, 2, 1), (1, 4, 0), (2, 3, 0), (4, 4, 0), (5, 5, 0)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {3, 6, 7}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 1), (1, None, 1), (2, "", None), (3, "x" * 400_000 + " a B, c d e f g", 1), (3, "x" * 400_000 + " a B, c d e f g", 1)], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q q q q q q"), (2, None), (3, "a")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontam.leaks(docs, items).collect()) == ["3", "3", "None"]
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.clean(docs, items).columns == docs.columns and decontam.clean(docs, items).count() == 2
    clash = docs.selectExpr("doc_id", "text", "7 as found", "8 as found_", "9 as _leaks")
    kept = decontam.clean(clash, items)
    assert kept.columns == clash.columns and {(r.found, r.found_, r._leaks) for r in kept.collect()} == {(7, 8, 9)}
    assert decontam.matches(docs, items).columns == docs.columns


def test_forms_of_a_text_find_one_another(spark):
    german = "Die Fußgänger überqueren die Straße hinter dem großen Möbelhaus während es regnet"
    hindi, other = "हिन्दी में लिखा हुआ एक छोटा सा वाक्य है", "हन्द मे लख हआ एक छट स वकय ह"  # the same consonants without their vowel signs
    thai, tone = "นี่คือประโยคสั้นๆที่เขียนเป็นภาษาไทย", "นคอประโยคสนๆทเขยนเปนภาษาไทย"
    wide = "Large models ﬁnd ﬂawed eﬃcient ｆｕｌｌ ｗｉｄｔｈ ½ letters"
    texts = [german, hindi, other, thai, tone, wide]
    forms = lambda t: {unicodedata.normalize(f, t) for f in ("NFC", "NFD", "NFKC", "NFKD")} | {t.upper() if t == german.replace("ß", "ss") else t}
    items = [(k, t) for k, t in enumerate(texts)]
    docs = [(k, "… xyz " + form + " qrs ´") for k, t in enumerate(texts) for form in sorted(forms(t))]
    docs += [(0, german.replace("ä", "ä\u00ad")), (1, hindi.replace("न्", "न्\u200d"))]
    b, f = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(f, b).collect() if r.distance == 0]
    assert sorted(got) == sorted((d, d) for d, _ in docs)
    for k, items_as in enumerate(("NFD", "NFKD")):
        b = spark.createDataFrame([(i, unicodedata.normalize(items_as, t)) for i, t in items], "item_id long, text string")
        assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(f, b).collect() if r.distance == 0) == sorted(got)
    assert all(i == d for d, i in {(r.doc_id, r.item_id) for r in decontam.leaks(f, b).collect()})  # no vowel signs, no match within the errors either


def test_the_engine_and_python_agree_on_plain_texts(spark):
    rng = random.Random(8)
    pool = [chr(c) for c in range(1, 0x2200) if not 0xD800 <= c < 0xE000]
    latin = [chr(c) for c in range(1, 0x180)] + list("–—‘’“”„•€")
    texts = ["".join(rng.choice(latin if k % 2 else pool) for _ in range(30)) for k in range(3000)] + [f"a{c}b {c}C" for c in pool]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontam.prepared(F.col("text")).alias("p")).collect()
    assert sum(r.p.done for r in rows) > 300
    for r in rows:
        assert (r.p.text if r.p.done else decontam.normal_form(r.p.text)) == decontam.normal_form(r.text), r.text.encode("unicode_escape")


def test_single_characters_on_request(spark):
    b = spark.createDataFrame([(1, "x"), (2, "字"), (3, "-"), (4, "")], "item_id long, text string")
    f = spark.createDataFrame([(1, "an x here"), (2, "ax"), (3, "漢字 list"), (4, "-")], "doc_id long, text string")
    assert decontam.leaks(f, b).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(f, b, min_chars=1).collect()) == [(1, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontam.clean(f, b, min_chars=1).collect()) == [2, 4]
