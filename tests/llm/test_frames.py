"""Token files: exact round trip, single documents, damage, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import frames, tokens

ODD = [
    "", "  ", "<|endoftext|>x <|ENDOFTEXT|> y", "It's WE'LL 'S ''s", "été É é ́x", "abc123def 4.5 !!!", "tab\there\r\n", "\x00\x1f \x1cx",
    "日本語 😀 ok", "İ ΣΑΣ ß ﬁ ÀÞ×÷ÿ", "a|b 'x <|z", "x" * 3000 + " " + "1" * 300,
]


def reference():
    t = Tokenizer.from_file(tokens.path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, tokens.END]


def test_ids_equal_the_tokenizer():
    rng = np.random.default_rng(3)
    signs = list("aAbBzZ 019.,'|<>!\n\t\x00éÉÑ×ßİ́ 日 ")
    texts = ODD + ["".join(rng.choice(signs, int(rng.integers(0, 30)))) for _ in range(800)]
    want, ids = reference(), tokens.Ids(tokens.path())
    for size in (1, 60, 1 << 22):
        got = [ids_[b[i] : b[i + 1]].tolist() for _, ids_, b in ids.blocks(pa.array(texts), size) for i in range(len(b) - 1)]
        assert got == [want(t) for t in texts]


def test_a_batch_of_texts_is_cut_in_bounded_memory():
    import tracemalloc

    ids, texts = tokens.Ids(tokens.path()), pa.array(["some plain words of a text, 12 of them or more. " * 40] * 2500)
    tracemalloc.start()
    n = sum(len(got) for _, got, _ in ids.blocks(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n % len(texts) == 0 and peak < 32 << 20


def test_pieces_of_earlier_blocks_are_kept_within_a_bound(monkeypatch):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)]
    texts, want = pa.array([" ".join(words[i % 7 :]) + " it's 日本" for i in range(60)] + ["long" * 99] * 2), reference()
    for bound, most in ((1 << 16, 120), (16, 10**6)):
        monkeypatch.setattr(tokens, "KNOWN", bound)
        ids, calls = tokens.Ids(tokens.path()), []
        plain = ids._plain
        monkeypatch.setattr(ids, "_plain", lambda piece: calls.append(piece) or plain(piece))
        got = [ids_[b[i] : b[i + 1]].tolist() for _, ids_, b in ids.blocks(texts, 500) for i in range(len(b) - 1)]
        assert got == [want(t) for t in texts.to_pylist()]
        assert len(calls) <= most and len(ids.known) < bound and len(ids.older) <= bound
        assert not any(len(p) > tokens.KNOWN_BYTES for p in [*ids.known, *ids.older])


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    from lectern.llm import common, packing

    log, before, pieces = str(tmp_path / "sizes"), spark.conf.get(common.BATCH_SETTING), packing.pieces

    def sizes(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{b.nbytes}\n")
            yield b

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    monkeypatch.setattr(packing, "pieces", lambda d, **o: pieces(d.mapInArrow(sizes, "doc_id long, text string"), **o))
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == 3000 * 801
    assert max(map(int, open(log).read().split())) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_SETTING) == before


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t) for i, t in enumerate(ODD)]
    return out + [(5, "same row")] * 3 + [(5, "another text"), (None, "no id"), (None, None), (70, None), (-4, "minus " * 900)]


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_round_trip(spark, rows, tmp_path):
    want_ids = reference()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    for name, options in (("one", {}), ("small", {"frame_ids": "64", "file_ids": "300"})):
        path = str(tmp_path / name)
        frames.write(docs, path, **options)
        got = sorted(frames.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=key)]
        assert sorted((key((r.doc_id,)), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((key(r), want_ids(r[1])) for r in rows)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)
        digest = frames.read(spark, path, content="digest")
        assert digest.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and digest.count() == len(rows)
        some = frames.read(spark, path, ids=[5, 70, 10**9]).collect()
        assert sorted(r.doc_id for r in some) == [5, 5, 5, 5, 70]
        # Plain zstandard readers unpack the ids alone, in order.
        plain = b"".join(
            zstandard.ZstdDecompressor().stream_reader(open(f"{path}/{f['name']}", "rb"), read_across_frames=True).read()
            for f in __import__("json").load(open(f"{path}/{frames.MANIFEST}"))["files"]
        )
        assert plain == b"".join(r.ids for r in got)


def test_single_documents_unpack_their_frames_alone(tmp_path):
    path = str(tmp_path / "f.tok.zst")
    docs = [np.arange(n, dtype="<u4") + n for n in (10, 200, 1, 64, 63, 65, 500, 2)]
    with pa.OSFile(path, "wb") as out:
        w = frames.FrameWriter(out, frame_ids=64)
        for i, d in enumerate(docs):
            w.add(i if i != 2 else None, d)
        w.finish()
    with pa.OSFile(path, "rb") as source:
        r = frames.FrameReader(source)
        assert r.document(4).tolist() == docs[4].tolist() and r.frames_read <= 2
        assert [r.document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
        assert r.wanted([3, 0, None]).tolist() == [0, 3] and r.total == sum(map(len, docs))
    data = bytearray(open(path, "rb").read())
    data[len(data) // 3] ^= 1
    open(path, "wb").write(data)
    with pa.OSFile(path, "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        [frames.FrameReader(source).document(i) for i in range(len(docs))]


def test_empty_table_and_lost_attempts(spark, tmp_path):
    path = str(tmp_path / "none")
    frames.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert frames.read(spark, path).count() == 0
    path = tmp_path / "lost"
    frames.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(path))
    # The file of an attempt that reported nothing is in no manifest.
    (path / "part-000000-0000-lost.tok.zst").write_bytes(b"half a file")
    assert [r.doc_id for r in frames.read(spark, str(path)).collect()] == [1]
