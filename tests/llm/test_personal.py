"""Validated spans by a plain scan, and keys beside other spans."""

import random
import re
import time

import pytest

from areastats.llm import pii


# The kinds as plain patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_scan(text):
    """The validated spans of a text, kind by kind."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    passes = {
        "email": lambda s: True,
        "ip": lambda s: all(int(part) <= 255 for part in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    return sorted(
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if passes[kind](m.group())
    )


def secret(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))


@pytest.fixture(scope="module")
def known():
    """Texts that teach the trees what a key looks like, and plain long words that are none."""
    rng = random.Random(5)
    texts = [f'{rng.choice(["token", "api_key"])}="{secret(rng)}"' for _ in range(400)]
    texts += [" ".join(["/usr/share/" + "/".join(rng.choice(["words", "lib", "doc"]) for _ in range(4))] * 2) for _ in range(200)]
    return texts


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(9)
    pieces = ["a@b.com", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "x", " ", ",", "é", "7", ":", "@", "\n", "+49"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(400)]
    few = ["a", "b", "@", ".", "-", "_", "%", "1", "2", "..", " "]
    texts += ["".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += ["a@b.c_d@e.f.g%h@i", "a@b.c.x@y.z", "1.2.3.4.5.6.7.8.9", "1.2.3.4-1.2.3.4", "a@b.c@d.e@f.g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_personal(docs).collect():
        mine = sorted((s["kind"], s["start"], s["end"]) for s in row["spans"] if s["rank"] >= 0)
        assert mine == plain_scan(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_keys_beside_an_email_without_blanks(spark, known):
    rng = random.Random(6)
    one, two, three = secret(rng), secret(rng), secret(rng)
    asked = [
        f'{{"email":"a@b.com","api_key":"{one}"}}',
        f"mail=a@b.com&token={two}",
        f'{{"token":"{one}","mail":"a@b.com","token":"{two}","more":"x@y","api_key":"{three}"}}',
    ]
    docs = spark.createDataFrame(list(enumerate(asked + known)), "doc_id long, text string")
    found = {r["doc_id"]: {asked[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]} for r in pii.find_personal(docs).collect() if r["doc_id"] < len(asked)}
    assert {"a@b.com", one} <= found[0] and {"a@b.com", two} <= found[1]
    assert {"a@b.com", one, two} <= found[2]


def test_best_spans_that_do_not_overlap(spark):
    rng, rows = random.Random(2), []
    for row in range(60):
        for kind in ("handle", "number", "key"):
            at = 0
            for _ in range(rng.randrange(12)):
                at += rng.randrange(4)
                end = at + rng.randint(1, 9)
                rows.append((row, kind, -1, at, end, rng.randrange(5) / 4))
                at = end
    want = set()
    for row, *_ in rows:
        taken = []
        for r in sorted((r for r in rows if r[0] == row), key=lambda r: (r[5], r[4] - r[3], -r[3], r[1]), reverse=True):
            if all(r[3] >= t[4] or t[3] >= r[4] for t in taken):
                taken.append(r)
        want |= {r[:5] for r in taken}
    table = spark.createDataFrame(rows, "row long, kind string, rank int, start int, end int, score double")
    assert {tuple(r) for r in pii._best_apart(table).collect()} == want


def test_only_a_span_that_overlaps_lies_on_a_base_span(spark):
    rng = random.Random(4)
    rows = [(row, rng.choice([0, 1, -1, -1]), (at := rng.randrange(60)), at + rng.randint(1, 9), i) for i, row in enumerate([*range(40)] * 9)]
    table = spark.createDataFrame(rows, "row long, rank int, start int, end int, i int")
    got = {r["i"]: r["on_base"] for r in pii._beside_base(table).collect() if r["rank"] < 0}
    assert got == {
        i: any(r[0] == row and r[1] >= 0 and r[2] < end and start < r[3] for r in rows)
        for row, rank, start, end, i in rows
        if rank < 0
    }


@pytest.mark.parametrize("wide", [False, True])
def test_long_runs_end_in_seconds(spark, wide):
    """None of these may take the stack or the square of its length."""
    n = 100_000 if wide else 20_000
    texts = [
        "1" * n, "1 " * (n // 2), "1-" * (n // 2), "x a@b" + ".c" * (n // 2), "A" * n + " x@y.de", "a" * n + "@" + "b" * n,
        "1." * (n // 2), "+1" + " " * n, "a@b.cd " * 20_000, "1.2.3.4 " * 20_000, "+" * n, "@" * n, "a.b@" * (n // 4), "k" * n + "=" * n,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    started = time.monotonic()
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    assert time.monotonic() - started < 90
    for k, text in enumerate([] if wide else texts):
        if k not in (0, 4, 5):  # the plain scan takes the square of these
            mine = sorted((s["kind"], s["start"], s["end"]) for s in found[k] if s["rank"] >= 0)
            assert mine == plain_scan(text), text[:20]
    assert ("email", n + 1, n + 7) in {(s["kind"], s["start"], s["end"]) for s in found[4]}
    assert not [s for s in found[5] if s["kind"] == "email"]


def test_redacted_rows(spark, known):
    rows = [(1, "write to a@b.com or 1.2.3.4!"), (1, "nothing"), (1, None), (None, "x +49 30 1234567 y"), (2, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(100 + k, t, 7) for k, t in enumerate(known[:20])], "doc_id long, text string, row int")
    got = sorted((str(r["doc_id"]), r["text"] or str(r["text"])) for r in pii.redact(docs).collect() if r["doc_id"] is None or r["doc_id"] < 100)
    assert got == sorted(
        [("1", "write to [EMAIL] or [IP]!"), ("1", "nothing"), ("1", "None"), ("None", "x [PHONE] y"), ("2", "")]
    )


def test_recall_of_keys(spark, known):
    """Keys after names that mark none, which the labels of the fit take for no keys."""
    rng = random.Random(8)
    hidden = [(1000 + k, f'{rng.choice(["sig", "value", "auth"])}="{secret(rng)}" and then plain words') for k in range(12)]
    docs = spark.createDataFrame(hidden + list(enumerate(known)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    assert sum(any(s["end"] - s["start"] == 32 for s in found[k]) for k, _ in hidden) >= 11
    plain = [k for k, t in enumerate(known) if t.startswith("/usr")]
    assert sum(bool(found[k]) for k in plain) <= len(plain) // 20


def test_the_trees_are_fitted_on_all_candidates(spark, monkeypatch):
    seen = []
    real = pii.GBTClassifier.fit

    def fit(self, rows, *more):
        seen.append(rows.agg({"weight": "sum"}).first()[0])
        return real(self, rows, *more)

    monkeypatch.setattr(pii.GBTClassifier, "fit", fit)
    texts = spark.range(30_000).selectExpr(
        "id as doc_id", "concat('call ', if(id % 2 = 0, '+', ''), 4915100000000 + id, ' now') as text"
    )
    found = pii.find_personal(texts)
    assert found.count() == 30_000
    assert 0.7 * 30_000 < seen[0] < 0.8 * 30_000
