"""Groups against all pairs, and how many pairs are listed where many unlike texts share passages."""

import random

import numpy as np
import pytest

from areastats.llm import ngram_join, segments


def shingle_sets(texts, length):
    sets = {}
    for i, text in texts:
        words = (text or "").lower().split()
        if words:
            n = min(length, len(words))
            sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return sets


def brute(texts, length, percent):
    sets = shingle_sets(texts, length)
    least = {i: i for i, _ in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: find(i) for i, _ in texts}


def groups(spark, texts, length, percent):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in ngram_join.shingle_components(docs, length=length, percent=percent).collect()}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.insert(k, f"n{rng.randrange(10**6)}"), lambda: words.pop(k), lambda: words.__setitem__(k, f"n{rng.randrange(10**6)}")])()
        words = words or ["x"]
    return words


def families(seed, sizes, copies):
    rng, texts = random.Random(seed), []
    for n in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(changed(rng, base, rng.randrange(5))) for _ in range(copies)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("crowded", [1, 64])
@pytest.mark.parametrize("length, percent", [(5, 80), (3, 90)])
def test_groups_equal_all_pairs(spark, monkeypatch, crowded, length, percent):
    """At 80 percent the sets of 4 to 18 and 28 to 62 shingles sign deletion segments."""
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    texts = families(length, [*range(6, 24, 2), *range(30, 70, 4), 120, 300], 14)
    want = brute(texts, length, percent)
    assert groups(spark, texts, length, percent) == want
    assert 30 < len(set(want.values())) < len(texts) - 60
    used = {b.deletion for n in range(4, 62) for b, _ in segments.bands_of(n, segments.Threshold(percent))}
    assert (max(used) > 0) == (percent == 80)


def template(n, own=1, words=25, seed=0):
    """Texts of one template, each with words of its own in the middle."""
    half = (words - own) // 2
    head, tail = [f"t{k}" for k in range(half)], [f"u{k}" for k in range(words - own - half)]
    return [(i, " ".join([*head, *[f"own{seed}x{i}x{k}" for k in range(own)], *tail])) for i in range(n)]


def test_unlike_texts_of_a_template_are_not_paired(spark, monkeypatch):
    listed = []
    real = ngram_join.ShingleJoin._possible

    def counted(self, pairs, shared):
        listed.append(pairs.count())
        return real(self, pairs, shared)

    monkeypatch.setattr(ngram_join.ShingleJoin, "_possible", counted)
    totals = []
    for n in (500, 1000, 2000):
        listed.clear()
        found = groups(spark, template(n), 3, 90)
        assert found == {i: i for i in range(n)}
        totals.append(sum(listed))
    assert totals[2] <= 4.2 * max(totals[0], 1) and totals[2] <= 40 * 2000


@pytest.mark.parametrize("percent", [80, 90])
def test_links_within_crowds(spark, monkeypatch, percent):
    """Copies that change a little lie in a crowd of unlike texts that share their passages."""
    monkeypatch.setattr(ngram_join, "CROWDED", 8)
    rng, texts = random.Random(percent), []
    for size in (30, 40, 90, 200):
        passage = [f"p{size}x{k}" for k in range(size)]
        for k in range(40):
            mine = [*passage, *[f"q{size}x{k}x{j}" for j in range(size // 3 + k % 5)]]
            texts.append(" ".join(mine))
            texts += [" ".join(changed(rng, mine, rng.randrange(1, 4))) for _ in range(k % 3)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    want = brute(texts, 3, percent)
    assert groups(spark, texts, 3, percent) == want
    assert len(set(want.values())) < len(texts) - 40


def test_prefixes_meet():
    """Similar sets share an item of their prefixes, in any order of the items."""
    rng = random.Random(1)
    for percent in (50, 80, 90):
        threshold, met = segments.Threshold(percent), 0
        for _ in range(3000):
            b = rng.randint(1, 60)
            common = rng.randint(0, b)
            a = common + rng.randint(0, b - common)
            if not a or not threshold.similar(common, a, b):
                continue
            items = rng.sample(range(10**6), a + b - common)
            x, y = sorted(items[:a]), sorted(items[a - common :])
            own, prefix, _ = ngram_join.prefix_lengths(a, threshold)
            of = dict(ngram_join.prefix_lengths(b, threshold)[2])
            assert set(x[:prefix]) & set(y[: of[own]])
            met += 1
        assert met > 100


def test_common_shingles_are_counted_in_all_texts(spark):
    """A passage of 30 of 30,000 texts, whose ids share any remainder of their hash that a draw may leave out."""
    passage = "one two three four five six seven eight"
    ids = [r["id"] for r in spark.range(30_000).filter("pmod(xxhash64(id), 3) <> 0").limit(30).collect()]
    own = "concat('a', id, ' b', id, ' c', id, ' d', id)"
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id").selectExpr(
        "doc_id", f"if(doc_id in ({', '.join(map(str, ids))}), '{passage}', {own.replace('id', 'doc_id')}) as text"
    ).unionAll(spark.sql("select null as doc_id, null as text")).repartition(5)
    table = np.unpackbits(ngram_join.common_places(docs, 3))
    assert table[ngram_join._place(ngram_join.shingles(passage.encode(), 3))].all()
    rare = ngram_join.shingles(b"a1 b1 c1 d1", 3)
    assert not table[ngram_join._place(rare)].any() and table.sum() < ngram_join.PLACES / 100
    counts = ngram_join.place_counts(docs, 3)
    assert counts.sum() == 2 * (30_000 - 30) + 6 * 30
