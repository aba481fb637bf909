import random
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions import vectors as vec

ALPHABET = "aB9_ \t\n\r.!?-éßÉ中½²  ​“—…ﬁ\x00\x07\x85İ٣'/\\"


def samples(n=400, seed=3):
    rnd = random.Random(seed)
    return ["", " ", "\n", "a\n", "\r\n\r\n", "a \n\n\n\n b"] + [
        "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 60))) for _ in range(n)
    ]


def column(spark, expr, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", expr("t")).orderBy("i").collect()]


def same(spark, expr, rule, texts=None):
    texts = samples() if texts is None else texts
    for t, got in zip(texts, column(spark, expr, texts), strict=True):
        assert got == rule(t), repr(t)


def marks(t):
    t = unicodedata.normalize("NFKC", t)
    for k, v in V.CHAR_REPLACEMENTS.items():
        t = t.replace(k, v)
    return t


def spaces(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
    return "\n".join(x.strip() for x in t.splitlines()).strip()


def test_normalize_unicode(spark):
    same(spark, tx.normalize_unicode, marks)


def test_stable_ranges_are_stable(spark):
    pattern = re.compile(f"[{tx._STABLE}]")
    for i in range(0x20, 0x10000):
        c = chr(i)
        if not 0xD800 <= i <= 0xDFFF and pattern.match(c):
            n = unicodedata.normalize("NFKC", c)
            assert n == c or marks(c) == V.CHAR_REPLACEMENTS.get(c), hex(i)


def test_control_and_space(spark):
    same(spark, tx.strip_control, lambda t: re.sub(V.CONTROL_CHARS, "", t))
    same(spark, tx.clean_whitespace, spaces)
    same(spark, tx.clean, lambda t: spaces(re.sub(V.CONTROL_CHARS, "", marks(t))))
    same(spark, tx.trim_py, str.strip)


def test_clean_cases(one):
    out = one(tx.clean, "Zero​width﻿space\x00and\x08control")
    assert not set("​﻿\x00\x08") & set(out)
    assert one(tx.clean, "ﬁne") == "fine"
    assert one(tx.clean, "   \n\t  ") == "" and one(tx.clean, "") == ""


def test_lines(spark):
    same(spark, tx.split_lines, str.splitlines)


def test_tokens(spark):
    same(spark, tx.tokenize, lambda t: re.findall(r"\b[a-zA-Z0-9_]+\b", t.lower()), [t.replace("İ", "i") for t in samples()])
    keep = [t.replace("İ", "i").replace("½", "").replace("²", "") for t in samples()]
    rule = lambda t: [w for w in re.findall(r"\b[a-zA-Z0-9_\-\.]+\b", t.lower()) if len(w) > 2 and w not in V.KEYWORD_STOPWORDS]
    same(spark, tx.extract_keywords, rule, keep)
    same(
        spark, lambda c: F.array_sort(tx.memory_tokens(c)),
        lambda t: sorted({w for w in re.findall(r"\b\w+\b", t.lower()) if len(w) > 1 and w not in V.MEMORY_STOPWORDS}), keep,
    )


def test_keys_and_counts(spark):
    plain = [t.replace("İ", "i") for t in samples()]
    same(spark, tx.dedup_key, lambda t: " ".join(t.lower().split()), plain)
    same(spark, tx.est_tokens, lambda t: 0 if not t else max(1, -(-len(t) // 4)))
    same(spark, tx.chunk_tokens, lambda t: max(1, len(t) // 4))
    same(spark, tx.word_count, lambda t: max(1, len(t.split())))
    same(spark, tx.byte_size, lambda t: len(t.encode()))
    same(spark, tx.session_title, lambda t: " ".join(t.split()[:5]) + ("..." if len(t.split()) > 5 else ""))
    same(spark, lambda c: tx.truncate_cache(c, 20), lambda t: t[:20] + V.CACHE_TRUNCATED if len(t) > 20 else t)


def test_query_normalise(one):
    assert one(tx.normalize_query, "   What   is   pgvector?  \x00 ") == "What is pgvector?"


def test_file_names(one):
    cases = {
        "../../etc/passwd": "passwd", "a b\\c d.txt": "c_d.txt", "..hidden": "hidden", ".env": "doc_.env", "é": "doc_",
        "a....b...c.txt": "ab.c.txt", "x/": "doc_",
    }
    for name, want in cases.items():
        assert one(tx.sanitize_filename, name) == want, name
    for name, want in {"a.TXT": ".txt", "/x.y/file": "", "a.tar.gz": ".gz", ".bashrc": ""}.items():
        assert one(tx.file_extension, name) == want, name


def test_masks_and_sources(one):
    masked = one(tx.mask_error, "key=abc123 Bearer abcdefghijkl sk-0123456789abc")
    assert masked == "key=[REDACTED] [REDACTED_TOKEN] [REDACTED_KEY]"
    assert one(tx.cited_sources, "[Source 10] [Source 2][Source 10]") == [2, 10]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([], [], 0.0), ([0.0], [0.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([1.0], [-1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    for r in df.select(vec.cosine("a", "b").alias("got"), "want").collect():
        assert r.got == r.want
