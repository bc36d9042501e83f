import random
import time

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk as C


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_cleaning_steps(spark):
    raw = "  a   b\t c\x00 “x” – https://x.example/a?b=1 me@x.example.com  \n\n\n\n d​ "
    out = one(spark, lambda c: T.clean(c, urls=True, emails=True), raw)
    assert out == 'a b c "x" -\n\nd'
    assert one(spark, T.clean, "   ") == "" and one(spark, T.clean, None) is None
    assert one(spark, lambda c: T.normalize_unicode(c), "ﬁ") == "fi"
    assert one(spark, T.remove_phones, "call 555-123-4567 now") == "call   now"
    assert one(spark, T.found_urls, "none here") is None
    assert one(spark, T.found_urls, "see http://a.example/x and https://b.example") == ["http://a.example/x", "https://b.example"]


def test_header_lines(spark):
    text = "\n".join(["Page 1", *"abcdef", "Page 2"])
    assert one(spark, lambda c: T.drop_headers_footers(c, "Page "), text) == "\n".join("abcdef")
    assert one(spark, lambda c: T.drop_headers_footers(c, "Page "), "Page 1\na") == "Page 1\na"


def test_html(spark):
    page = "<html><script>var x='</p>';</script><style>p{}</style><body><h1>A &amp; B</h1><!-- c --><p> text <b>bold</b></p></body></html>"
    assert one(spark, T.html_text, page) == "A & B\ntext\nbold"


def test_chunks_cover_text_and_stay_in_bounds(spark):
    text = ". ".join(f"sentence number {i} has some words in it" for i in range(60)) + ".\nlast line"
    docs = spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "document_id string, text string")
    for cut in (C.fixed, C.by_separators, C.sentence):
        rows = cut(docs, size=50, overlap=8).orderBy("chunk_index").collect()
        assert {r.document_id for r in rows} == {"d"} and len(rows) > 5
        assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.total_chunks for r in rows} == {len(rows)}
        assert all(r.token_count <= 50 and text[r.start_char : r.end_char] == r.content for r in rows)
        assert len({r.chunk_id for r in rows}) == len(rows)
        covered = set()
        for r in rows:
            covered |= set(range(r.start_char, r.end_char))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))
        assert all(b.start_char <= a.end_char for a, b in zip(rows, rows[1:], strict=False)) or cut is not C.fixed


def test_pages_and_whole(spark):
    docs = spark.createDataFrame([("d", "one\fTwo words\f \fthree")], "document_id string, text string")
    assert [(r.page_number, r.content) for r in C.pages(docs).orderBy("page_number").collect()] == [(1, "one"), (2, "Two words"), (4, "three")]
    assert C.whole(docs).count() == 1


def test_own_tokenizer_and_large_overlap(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    by_char = C.fixed(docs, size=10, overlap=2, pieces=lambda c: F.split(c, "")).orderBy("chunk_index").collect()
    assert by_char[0].content == text[:10].rstrip() and all(len(r.content) <= 10 for r in by_char)
    rows = C.fixed(docs, size=10, overlap=8).orderBy("chunk_index").collect()
    assert [r.content.split()[0] for r in rows] == [f"w{i}" for i in range(0, 91, 2)] and rows[-1].content.endswith("w99")


def test_packing_against_the_rule_in_turn():
    """Ends by running sums against adding piece after piece."""
    rng = random.Random(3)
    for _ in range(500):
        counts = [rng.choice([0, 1, 2, 3, 9, 14]) for _ in range(rng.randrange(30))]
        size, overlap = rng.randrange(1, 13), rng.randrange(0, 6)
        want, cur = [], []
        for k, n in enumerate(counts):
            if sum(counts[x] for x in cur) + n > size:
                if cur:
                    want.append((cur[0], cur[-1] + 1))
                room = min(overlap, size - n)
                cur = [x for i, x in enumerate(cur) if sum(counts[y] for y in cur[i:]) <= room]
            cur.append(k)
        want += [(cur[0], cur[-1] + 1)] if cur else []
        got = C.packed(counts, [2] * len(counts), size, overlap)
        assert [x[:2] for x in got] == want and [x[2] for x in got] == [2 * a for a, _ in want]


def test_a_long_text_is_chunked_in_seconds(spark):
    text = " ".join(f"word{k}." if k % 9 == 0 else f"word{k}" for k in range(1_000_000))
    start = time.time()
    n, most = C.by_separators(spark.createDataFrame([(1, text)], "document_id long, text string"), size=128, overlap=16).agg(F.count("*"), F.max("token_count")).first()
    assert n > 5000 and most <= 128 and time.time() - start < 120
