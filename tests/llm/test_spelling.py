"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from areastats.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(counts):
    best = {}
    for w, n in counts.items():
        around = [v for v in counts if abs(len(v) - len(w)) <= 1 and near(v, w)]
        top = min(around, key=lambda v: (-counts[v], v), default=None)
        form = top if top is not None and counts[top] and counts[top] >= 2 * n else None
        best[w] = (form, len(around))
    rows = set()
    for w, (form, size) in best.items():
        root = w
        while best[root][0] is not None:
            root = best[root][0]
        rows.add((w, form, root, counts[w], size, counts[form] if form is not None else None))
    return rows


def rows_of(df):
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found))
    return set(found)


def vocabulary(seed, size, letters="abeilé", longest=7):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(size)}
    return {w: rng.choice([1, 2, 3, 4, 8, 30, 100, 1000]) for w in words}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("tile", [3, 1024])
def test_all_words(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    counts = vocabulary(tile, 600)
    assert rows_of(spelling.group_variants(table(spark, counts))) == brute(counts)


def test_comparison_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "COMPARED_LETTERS", 10)
    words = sorted(w for w in vocabulary(3, 400) if len(w) == 4)
    longer = sorted(w for w in vocabulary(4, 400) if len(w) == 5)
    codes = [spelling._codes("".join(x), len(x)) for x in (words, longer)]
    i, j = spelling.near_pairs(codes[0], codes[0], True)
    assert set(zip(i.tolist(), j.tolist())) == {
        (a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b])
    }
    i, j = spelling.near_pairs(*codes, False)
    assert set(zip(i.tolist(), j.tolist())) == {
        (a, b) for a in range(len(words)) for b in range(len(longer)) if near(words[a], longer[b])
    }


def test_edges(spark):
    long = "ab" * 20_000
    rows = [
        ("apple", 9), ("aple", 1), ("apple", 1), (None, 5), ("", 1), ("a", 4), ("b", None), (long, 6), (long + "c", 3),
        (long[:-1], 2), ("tie", 8), ("tia", 8), ("ti", 2), ("日本", 1), ("日木", 2), ("chain", 2), ("chains", 4), ("chairs", 8),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "word string, n long, block string")
    counts = {}
    for w, n in rows:
        if w is not None:
            counts[w] = counts.get(w, 0) + (n or 0)
    got = rows_of(spelling.group_variants(df))
    assert got == brute(counts)
    assert ("ti", "tia", "tia", 2, 2, 8) in got and ("chain", "chains", "chairs", 2, 1, 4) in got
    assert rows_of(spelling.group_variants(df.filter("word = 'none'"))) == set()


def test_query_against_brute_force(spark):
    counts = Counter()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert rows_of(queries.QUERIES["op11_spelling_variants"](spark, SF)) == brute(counts)


def test_texts(spark):
    schema = "doc_id long, text string, word string, run int"
    docs = spark.createDataFrame(
        [(1, "Ünder ÀB×c d1e", "x", 1), (2, None, "x", 1), (2, "", "x", 1), (None, "ab", "x", 1), (None, "ab", "x", 1)], schema
    )
    runs = spelling.letter_runs(docs)
    assert Counter(r.run for r in runs.collect()) == {"Ünder": 1, "Àb×c": 1, "d": 1, "e": 1, "ab": 2}
    written = runs.select(spelling.slipped(runs["doc_id"], runs["run"], 1).alias("w"))
    assert all(len(r.w) in (0, 1, 3, 4) for r in written.collect())
    assert {tuple(r) for r in spelling.count_words(runs, "run", 2, 2).collect()} == {("ab", 2)}
    assert spelling.group_variants(spelling.count_words(spelling.letter_runs(docs.limit(0)), "run")).count() == 0
