import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions.sqlfuncs import register
from lectern.operators import documents as D
from lectern.operators import embedding as E
from lectern.plans.ingest import ingest_chunks
from lectern.sources import files as FS
from lectern.sources import tables as TB


def chunks(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r.content for r in D.chunk(df, **kw).orderBy("chunk_index").collect()]


def test_fixed(spark):
    got = chunks(spark, "A" * 120, strategy="fixed", size=50, overlap=10)
    assert [len(c) for c in got] == [50, 50, 40]
    long = "".join(random.Random(1).choice("ab c") for _ in range(60_000))
    want = [long[s : s + 50].strip() for s in range(0, len(long), 40) if s == 0 or s + 10 < len(long)]
    assert chunks(spark, long, strategy="fixed", size=50, overlap=10) == [w for w in want if w]
    assert chunks(spark, "", strategy="fixed") == []


@pytest.mark.parametrize("strategy", ["fixed", "sentence_aware", "paragraph_aware"])
def test_overlap_must_be_smaller(spark, strategy):
    with pytest.raises(ValueError):
        chunks(spark, "a", strategy=strategy, size=50, overlap=50)


def test_sentence_spans_follow_the_rule():
    rnd = random.Random(5)
    for _ in range(300):
        size = rnd.randint(20, 60)
        overlap = rnd.randint(0, size - 1)
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(1, 30))]
        spans = D._spans(lengths, size, overlap)
        cost = lambda a, b: sum(n + 1 for n in lengths[a:b])
        assert spans[0][0] == 0 and spans[-1][1] == len(lengths)
        done = 0
        for k, (a, b) in enumerate(spans):
            assert b > done, "every span takes a new unit"
            assert b == done + 1 or cost(a, b) <= size
            if b < len(lengths):
                assert cost(a, b + 1) > size, "a unit that fits is taken"
                nxt = spans[k + 1][0]
                assert cost(nxt, b) <= overlap, "the tail fits the overlap"
                assert nxt == a or cost(nxt - 1, b) > overlap, "the tail is the longest that fits"
            done = b


def test_sentence_and_paragraph_texts(spark):
    text = "One two. Three four! Five six? " + "x" * 70 + ". Seven."
    got = chunks(spark, text, size=25, overlap=12)
    assert got[0] == "One two. Three four!" and got[1].startswith("Three four!"[:0] + "Five") or got[1].startswith("Three")
    assert max(len(c) for c in got) <= 25 + 12 and got[-1].endswith("Seven.")
    paras = chunks(spark, "aaa\n\nbbb\n\n" + "c" * 40, strategy="paragraph_aware", size=15, overlap=3)
    assert paras[0] == "aaa\n\nbbb" and all(len(p) <= 15 for p in paras)


def test_pages_share_one_index(spark):
    df = spark.createDataFrame([(7, ["first page", "  ", "second page"])], "id int, p array<string>")
    pages = df.select("id", F.transform("p", lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text"))).alias("pages"))
    for strategy in ("fixed", "sentence_aware"):
        rows = D.chunk_document(pages, strategy=strategy, size=100, overlap=10).orderBy("chunk_index").collect()
        assert [(r.chunk_index, r.page_number, r.content) for r in rows] == [(0, 1, "first page"), (1, 3, "second page")]
        assert rows[0].metadata.token_estimate == 2 and rows[0].metadata.strategy == strategy


def test_line_and_paragraph_pages(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(130))))], "id int, text string")
    rows = D.paginate_lines(df).orderBy("page_number").collect()
    assert [(r.page_number, r.line_start, r.line_end) for r in rows] == [(1, 0, 60), (2, 60, 120), (3, 120, 130)]
    empty = D.paginate_lines(spark.createDataFrame([(1, "")], "id int, text string")).collect()
    assert [(r.page_number, r.text, r.line_end) for r in empty] == [(1, "", 0)]
    paras = spark.createDataFrame([(1, ["a" * 2000, " ", "b" * 1500, "c"]), (2, [])], "id int, paras array<string>")
    got = {(r.id, r.page_number): (len(r.text), r.paragraph_count) for r in D.paginate_paragraphs(paras).collect()}
    assert got == {(1, 1): (3502, 2), (1, 2): (1, 1), (2, 1): (0, None)}


def test_uploads(spark):
    df = spark.createDataFrame([("a.txt", 1), ("b.exe", 1), ("c.pdf", 0), ("d.docx", 26 << 20)], "filename string, file_size long")
    ok, bad = D.validate_files(df)
    assert [r.filename for r in ok.collect()] == ["a.txt"]
    assert {r.filename: r.reason for r in bad.collect()} == {
        "b.exe": "unsupported_extension", "c.pdf": "empty_file", "d.docx": "file_too_large",
    }


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("héllo\nworld".encode())
    (tmp_path / "l.txt").write_bytes("héllo".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in FS.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": "héllo\nworld", "l.txt": "héllo"}
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "broken.docx").write_bytes(b"nope")
    rows = {r.path.rsplit("/", 1)[1]: r for r in FS.read_docx(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].paras == ["One\tx", ""] and rows["broken.docx"].error_message


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    docs = spark.createDataFrame([(i, "u", f"text of document {i}. " * 40) for i in range(20)], "doc_id long, user_id string, text string")
    first = ingest_chunks(docs, "fixed").drop("metadata")
    TB.write_chunks(first, path, buckets=4)
    TB.write_chunks(ingest_chunks(docs.where("doc_id < 3").withColumn("text", F.lit("new")), "fixed").drop("metadata"), path, buckets=4)
    now = TB.read_chunks(spark, path)
    assert {r.doc_id for r in now.where("content = 'new'").collect()} == {0, 1, 2}
    assert now.where("doc_id >= 3").count() == first.where("doc_id >= 3").count() and now.where("doc_id < 3").count() == 3
    TB.delete_chunks(spark, path, docs.where("doc_id <> 5"), buckets=4)
    assert {r.doc_id for r in TB.read_chunks(spark, path).collect()} == {5}


def test_changed_chunks_are_made_once(spark, tmp_path):
    path, seen = str(tmp_path / "chunks"), str(tmp_path / "seen")

    def count(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    kind = "doc_id long, chunk_index int, content string"
    first = spark.createDataFrame([(i, k, f"old {i}") for i in [*range(30), None] for k in range(5)], kind)
    TB.write_chunks(first, path, buckets=4)
    changed = [(i, k, f"new {i}") for i in [3, 7, 40, None] for k in range(2)]
    TB.write_chunks(spark.createDataFrame(changed, kind).mapInArrow(count, kind), path, buckets=4)
    # A null key replaces none.
    kept = [tuple(r) for r in first.collect() if r.doc_id not in (3, 7, 40)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, TB.read_chunks(spark, path).collect()), key=key) == sorted(kept + changed, key=key)
    assert len(open(seen).read()) == len(changed)
    # Nothing changes without chunks.
    TB.write_chunks(first.where("false"), path, buckets=4)
    assert TB.read_chunks(spark, path).count() == len(kept) + len(changed)


def test_windows_of_long_texts(spark):
    texts = ["", " ", "a", *("".join(chr(97 + i * i % 23) if i % 5 else "é 日😀"[i % 4] for i in range(n)) for n in (9, 10, 11, 64, 505, 513, 4000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.fixed_chunks("t", 10, 3).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: D.split_text(t, "fixed", 10, 3) for i, t in enumerate(texts)}


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "One. Two. Three.")], "id int, text string").createOrReplaceTempView("d")
    rows = spark.sql("SELECT id, c.* FROM d, LATERAL chunk_text(d.text, 'sentence_aware', 10, 5) c ORDER BY chunk_index").collect()
    assert rows[0].content == "One. Two." and rows[-1].content.endswith("Three.")
    assert spark.sql("SELECT nfkc('ﬁ')").first()[0] == "fi"


def test_embedding(spark):
    import numpy as np
    import pandas as pd

    df = spark.createDataFrame([(1, "a b\nc"), (2, "d")], "id int, content string")

    def encoder(batches):
        for texts in batches:
            yield pd.Series([np.array([float(len(t)), 0.0], dtype="float32") for t in texts])

    got = {r.id: list(r.embedding) for r in E.embed(df, encoder, dim=2).collect()}
    assert got == {1: [5.0, 0.0], 2: [1.0, 0.0]}
    hashed = E.embed(df, dim=16)
    assert all(len(r.embedding) == 16 for r in hashed.collect())
    assert E.validate_dim(hashed, 8, "drop").count() == 0
    with pytest.raises(Exception, match="expected 8 dimensions"):
        E.validate_dim(hashed, 8).collect()
