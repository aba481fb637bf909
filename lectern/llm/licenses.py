"""License scans by diagonal voting.

All rolling word k-grams of the texts are joined with the grams of the templates on their hash (and the gram itself). A
hit at word ``i`` of the text and ``j`` of the template votes for the diagonal ``i - j``. Votes are added up per text,
template and diagonal; diagonals at most ``DRIFT`` apart are merged to a span, so that inserted or dropped words don't
break a template. A span counts when it holds at least the template's share of distinct grams. As every vote was compared
word by word, a diagonal with all grams of a template is the template itself, verified. Phrases of ``BASE`` count only so.

Results: a null or empty text has no word and no span. Repeated rows give repeated rows; a null id is kept. An empty table
gives an empty one. Extra columns are not read. Python chains the hits of spans with enough of them, nothing else.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import lower_ascii, text_of
from lectern.operators.sizing import cut_lineage

K = 3
DRIFT = 3
SHARE = 0.8
PASSAGE = 60
SHORTEST = 12
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Openings of the public texts of licenses.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
_COUNT = "\n"


def _passages() -> list[tuple[str, str]]:
    """Passages of the license texts and their labels. Paragraphs shorter than ``SHORTEST`` words go with the next one."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        label, held = path.name.split(".")[0], []
        paragraphs = [re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", p.lower()).split() for p in re.split(r"\n\s*\n", path.read_text())]
        for no, w in enumerate(paragraphs):
            held += w
            if len(held) < SHORTEST and no < len(paragraphs) - 1:
                continue
            n = -(-len(held) // PASSAGE)
            for i in range(n):
                words = held[i * len(held) // n : (i + 1) * len(held) // n]
                if len(words) >= SHORTEST:
                    out.append((" ".join(words), label))
            held = []
    return list(dict.fromkeys(out))


def _chains(i: np.ndarray, j: np.ndarray, n: int, share: float) -> list[tuple[int, int, float]]:
    """Spans ``(start, end, share)`` of the hits at words ``i`` of the text and ``j`` of a template of ``n`` words.

    No chain crosses a gap wider than the template, so the stretches between such gaps are searched apart.
    """
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    cut = np.flatnonzero(np.diff(i) > n + DRIFT) + 1
    return [s for a, b in zip(np.split(i, cut), np.split(j, cut)) for s in _stretch(a, b, n, share)]


def _stretch(i: np.ndarray, j: np.ndarray, n: int, share: float) -> list[tuple[int, int, float]]:
    out = []
    while K * len(i) >= share * n:
        best, back = np.full(len(i), K), np.full(len(i), -1)
        for p in range(1, len(i)):
            a = int(np.searchsorted(i, i[p] - n - DRIFT))
            di, dj = i[p] - i[a:p], j[p] - j[a:p]
            new = np.where((di > 0) & (dj > 0) & (np.abs(di - dj) <= DRIFT), best[a:p] + np.minimum(K, np.minimum(di, dj)), 0)
            if len(new) and new.max() > K:
                back[p] = a + int(new.argmax())
                best[p] = new.max()
        p = end = int(best.argmax())
        if best[end] < share * n:
            break
        while back[p] >= 0:
            p = back[p]
        out.append((int(i[p]), int(i[end]) + K, min(1.0, float(best[end]) / n)))
        rest = (i < i[p]) | (i >= i[end] + K)
        i, j = i[rest], j[rest]
    return sorted(out)


def _chained(share: float):
    @F.pandas_udf("array<struct<start:int,end:int,share:double>>")
    def chained(i: pd.Series, j: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "share": v} for s, e, v in _chains(np.array(a), np.array(b), m, share)] for a, b, m in zip(i, j, n)])

    return chained


def _template_rows(base: dict[str, str], more: dict[str, str] | list[tuple[str, str]]) -> list[tuple]:
    rows = []
    for no, (phrase, label) in enumerate([*base.items(), *(more.items() if isinstance(more, dict) else more)]):
        w = phrase.split()
        n = len(w) - K + 1
        rows += [(" ".join(w[j : j + K]), no, label, no < len(base), j, n) for j in range(n)]
    return rows


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", base: dict[str, str] = BASE, more: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """``key, n_words, spans`` of every row; a span has ``label, base, start, end, share`` in words.
    ``more`` are templates to use instead of the openings and passages."""
    spark = docs.sparkSession
    t = text_of(text)
    words = F.filter(F.split(lower_ascii(t), WORD_BREAK, -1), lambda w: w != "")
    d = docs.select(F.col(key).alias("id"), F.xxhash64(t, F.length(t)).alias("h"), words.alias("w"))
    starts = F.when(F.size("w") >= K, F.sequence(F.lit(0), F.size("w") - K)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get("w", i + j) for j in range(K)]).alias("g"), i.alias("i")))
    # One more entry carries the number of words.
    number = F.array(F.struct(F.lit(_COUNT).alias("g"), F.size("w").alias("i")))
    g = d.select("id", "h", F.explode(F.concat(number, grams)).alias("x")).select("id", "h", F.col("x.g").alias("gram"), F.col("x.i").alias("at"))
    g = g.withColumn("code", F.xxhash64("gram"))
    kind = "gram string, template int, label string, base boolean, place int, n_grams int"
    table = spark.createDataFrame([(_COUNT, -1, None, False, 0, 0), *_template_rows(base, [*TEMPLATES.items(), *_passages()] if more is None else more)], kind)
    # As many rows as the templates have grams.
    votes = g.join(F.broadcast(table.withColumn("code", F.xxhash64("gram"))), ["code", "gram"])
    per = votes.groupBy("id", "h", "template", "label", "base", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("n")
    )
    # Written once: filters of its three uses would be pushed below the exchange and the texts read for each.
    per = cut_lineage(per)
    exact = per.where(F.col("base") & (F.size("places") == F.col("n_grams"))).select(
        "id", "h", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + (K - 1)).alias("end"), "label", "base", F.lit(1.0).alias("share")
    )
    by = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT
    run = per.where("template >= 0 and not base").withColumn("run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(by))
    hits = F.transform("places", lambda p: F.struct((p + F.col("diagonal")).alias("i"), p.alias("j")))
    run = run.groupBy("id", "h", "template", "label", "base", "n_grams", "run").agg(F.flatten(F.collect_list(hits)).alias("hits"))
    # Fewer hits than this cannot cover the share of words.
    n = F.col("n_grams") + (K - 1)
    run = run.where(K * F.size("hits") >= share * n).withColumn("spans", _chained(share)(F.col("hits.i"), F.col("hits.j"), n))
    found = run.select("id", "h", "label", "base", F.explode("spans").alias("s")).select("id", "h", "s.start", "s.end", "label", "base", "s.share")
    kept = exact.unionByName(found)
    spans = kept.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "base", "share"))).alias("spans"))
    # The counting entry of equal rows came once for each.
    rows = per.where("template < 0").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("diagonal").alias("n_words"), F.col("n").alias("rows"))
    out = rows.join(spans, rows["_id"].eqNullSafe(spans["id"]) & (rows["_h"] == spans["h"]), "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,base:boolean,share:double>>")
    return out.select(
        F.col("_id").alias(key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("spans", none).alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_row"),
    ).drop("_row")
