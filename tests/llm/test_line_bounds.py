"""Short lines and more than one edit against a comparison of all lines."""

import random

import pytest

from areastats.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("edits", "least_chars", "most"), [(1, 1, 20), (2, 1, 24), (2, 16, 24), (3, 4, 10)])
def test_lines_within_edits(spark, edits, least_chars, most):
    rng, texts = random.Random(edits * 10 + least_chars), ["Page 12 of 40\nPage 13 of 40", "Read more >\nRead more >>"]
    for _ in range(12):
        base = "".join(rng.choice("abcdé") for _ in range(rng.randint(5, most)))
        near = [base]
        for _ in range(8):
            line = rng.choice(near)
            for _ in range(rng.randint(1, 3)):
                p, new = rng.randrange(len(line) + 1), rng.choice("abcdé")
                line = rng.choice([line[:p] + new + line[p:], line[:p] + new + line[p + 1 :], line[:p] + line[p + 1 :]]) or "x"
            near.append(line)
        rng.shuffle(near)
        texts += ["\n".join(near[k : k + 3]) for k in range(0, len(near), 3)]
    firsts, want = [], {}
    for i, text in enumerate(texts):
        equal = close = 0
        kept = []
        for line in text.split("\n"):
            if line in firsts:
                equal += 1
                continue
            if len(line) >= least_chars and any(len(x) >= least_chars and distance(x, line) <= edits for x in firsts):
                close += 1
            else:
                kept.append(line)
            firsts.append(line)
        want[i] = (equal, close, "\n".join(kept))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = line_dedup.dedup_lines(docs, edits=edits, least_chars=least_chars).collect()
    assert {r["doc_id"]: (r["n_equal"], r["n_near"], r["text"]) for r in rows} == want
