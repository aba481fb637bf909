"""Whole license texts: bodies without their opening, changed, inserted and dropped words."""

import re
from pathlib import Path

import numpy as np
import pytest

from lectern.llm import licenses

FOLDER = Path(licenses.__file__).parent / "license_texts"
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
HEADER = "Licensed under the Apache License, Version 2.0"


def scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [{(s.label, s.start, s.end, round(s.share, 3)) for s in r.spans if not s.base} for r in sorted(rows, key=lambda r: r.doc_id)]


def test_bodies_are_found(spark):
    names = sorted(p.name for p in FOLDER.glob("*.txt"))
    bodies = ["\n".join((FOLDER / n).read_text().split("\n")[-120:]) for n in names]
    got = scan(spark, [*bodies, "Some code. " + WARRANTY + " End.", "nothing of the kind is said in this text " * 20])
    for name, spans in zip(names, got):
        assert name.split(".")[0] in {s[0] for s in spans}, name
    assert {s[0] for s in got[-2]} == {"mit"} and got[-1] == set()
    # The warranty is found from its first word, behind "some code", to its last.
    assert min(s[1] for s in got[-2]) == 2 and max(s[2] for s in got[-2]) == 2 + len(re.findall("[A-Z]+", WARRANTY))


@pytest.mark.parametrize("change", ["replace", "insert", "drop"])
def test_altered_words_do_not_break_a_template(spark, change):
    w = WARRANTY.split()
    out = []
    for i, x in enumerate(w):
        hit = i % 12 == 6
        out += {"replace": ["zzz" if hit else x], "insert": [x, "zzz"] if hit else [x], "drop": [] if hit else [x]}[change]
    got = scan(spark, [" ".join(out), "licensed under the apache notice version 2 0", " ".join(np.random.default_rng(1).permutation(w))])
    assert {s[0] for s in got[0]} == {"mit"}
    assert {s[0] for s in got[1]} == {"apache-2"}
    assert got[2] == set(), "words out of order"


def test_chains_hold_the_order():
    i = np.arange(20)
    assert licenses._chains(i + 5, i, 22, 0.8) == [(5, 27, 1.0)]
    assert licenses._chains(i + 5, i[::-1], 22, 0.8) == []
    both = licenses._chains(np.concatenate((i, i + 24)), np.concatenate((i, i)), 22, 0.8)
    assert both == [(0, 22, 1.0), (24, 46, 1.0)]
