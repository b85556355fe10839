"""The divergence verdict against its definition, document by document."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from sigspark.llm import op5_quality as op

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def classes_of(text: str) -> list[int]:
    """Lower-case letters, upper-case letters, digits, white space, stops, symbols, the rest."""
    out = [0] * 7
    for c in text:
        kind = next((k for k, p in enumerate([r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[ \t\n\x0b\f\r]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>@_=+/\\^~{}\[\]]"]) if matches(p, c)), 6)
        out[kind] += 1
    return out


def matches(pattern: str, c: str) -> bool:
    import regex

    return regex.fullmatch(pattern, c) is not None


def common_of(text: str, lang: str) -> list[int]:
    found = Counter(re.split(r"[ \t-\r.,;:!?'\"()]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
    own = [found[w] for w in op.COMMON.get(lang, [])]
    words = len(re.findall(r"[^ \t-\r]+", text))
    return [*own, max(0, words - sum(own))]


def distance(a, b) -> float | None:
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    half = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(half(x, y) + half(y, x) for x, y in zip(p, q, strict=True)) / 2))


def test_distances_and_verdicts(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    sums: dict[str, list] = {}
    for d in docs:
        if d["lang"] in op.COMMON:
            held = sums.setdefault(d["lang"], [[0] * 7, [0] * (len(op.COMMON[d["lang"]]) + 1)])
            for into, own in zip(held, (classes_of(d["text"] or ""), common_of(d["text"] or "", d["lang"])), strict=True):
                into[:] = [x + y for x, y in zip(into, own, strict=True)]
    got = {r["doc_id"]: r for r in op.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rejected = 0
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        n_words = len(re.findall(r"[^ \t-\r]+", text))
        by_class = distance(classes_of(text), sums[d["lang"]][0]) if len(text) >= 200 and d["lang"] in sums else None
        by_word = distance(common_of(text, d["lang"]), sums[d["lang"]][1]) if n_words >= 40 and d["lang"] in sums else None
        assert r["class_distance"] == (None if by_class is None else pytest.approx(by_class, abs=1e-9))
        assert r["common_distance"] == (None if by_word is None else pytest.approx(by_word, abs=1e-9))
        limit = math.sqrt(0.04 + 1.25 * len(op.COMMON.get(d["lang"], [])) / (8 * math.log(2) * max(n_words, 1)))
        far = (by_class or 0) > 0.3 or (by_word is not None and by_word > limit)
        assert r["kept"] == (not r["base_failed"] and not far), d["doc_id"]
        rejected += far
    assert rejected > 0


def test_a_text_of_millions_of_words(spark):
    line = "the old house and the road to it was on the way that was for all by this river as it is in a land"
    text = "\n".join(f"{line} {i}" for i in range(60_000))
    (r,) = op.quality(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()
    assert r["n_words"] == 60_000 * 26 and r["n_dup_lines"] == 0 and r["base_failed"]
