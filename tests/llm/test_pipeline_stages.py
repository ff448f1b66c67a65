"""Every stage of the pipeline on its own input, and the whole run, against plain computations."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from areastats.llm import mixing, quality

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts of skewed sources, copies, near copies, contaminated and poor texts."""
    rng = random.Random(12)
    plain = lambda n: " ".join(rng.choice(["the", "of", "and"]) if k % 4 == 0 else f"word{rng.randrange(3000)}" for k in range(n))
    items = [plain(40) for _ in range(5)]
    texts = [plain(rng.randint(60, 140)) for _ in range(90)]
    texts += [texts[k] for k in range(0, 12)]
    texts += [" ".join(texts[k].split()[:-1] + ["changed"]) for k in range(20, 30)]
    texts += [texts[k] + " " + items[k % 5] for k in range(40, 46)]
    texts += ["too short", "", None, "# $ % & " * 40, ("same three words " * 40)]
    rows = [(i, t, "en", "big" if rng.random() < 0.7 else rng.choice(["mid", "small", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def kept(spark, folder, stage, docs=None):
    return sorted(tuple(r) for r in STAGES[stage](spark, docs if docs is not None else docs_of(spark, folder), folder).collect())


def test_names():
    assert list(STAGES) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]


def test_quality_rules(spark, folder):
    def passes(text):
        words = re.findall("[^ \t-\r]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            return False
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        values = {
            "word_length": sum(map(len, words)) / len(words),
            "symbols": sum(text.count(c) for c in quality.SYMBOLS) / len(words),
            "shouts": sum(text.count(c) for c in quality.SHOUTS) / len(words),
            "stop_words": sum(w.lower() in quality.STOP_WORDS for w in words) / len(words),
            "repeated_lines": (len(lines) - len(set(lines))) / len(lines),
        }
        return all((r.least is None or values[r.name] >= r.least) and (r.most is None or values[r.name] <= r.most) for r in quality.RULES)

    rows = [tuple(r) for r in docs_of(spark, folder).collect()]
    assert kept(spark, folder, "quality_rules") == sorted(r for r in rows if passes(r[1]))


def test_ngram_jaccard_join(spark, folder):
    docs = docs_of(spark, folder).filter("text is not null")
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    sets = {}
    for i, r in rows.items():
        words = r[1].lower().split()
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    least = {i: i for i in rows}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    want = sorted(r for i, r in rows.items() if find(i) == i)
    assert kept(spark, folder, "ngram_jaccard_join", docs) == want and len(rows) - len(want) >= 20


def test_benchmark_decontamination(spark, folder):
    words_of = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = words_of(r["text"])
        n = min(13, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1) if n}

    def clean(text):
        words, hit = words_of(text), set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        return not hit or 20 * len(hit) < len(words)

    rows = [tuple(r) for r in docs_of(spark, folder).collect()]
    want = sorted((r for r in rows if clean(r[1])), key=str)
    got = STAGES["benchmark_decontamination"](spark, docs_of(spark, folder), folder)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(rows) - len(want) == 6


def test_mixing_sources(spark, folder):
    """Each document once per epoch of its source, which the plain shares foretell."""
    docs = docs_of(spark, folder)
    got = Counter(r["doc_id"] for r in STAGES["mixing_sources"](spark, docs, folder).collect())
    epochs = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        epochs[r["doc_id"]] = max(epochs[r["doc_id"]], r["epoch"] + 1)
    assert got == Counter(epochs) and set(got) == {r["doc_id"] for r in docs.collect()}
    sizes = Counter(r["source"] for r in docs.collect())
    dealt = Counter()
    for r in docs.collect():
        dealt[r["source"]] += got[r["doc_id"]]
    targets = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    for source in sizes:  # within a block at either end
        share = targets[source] / sum(targets.values()) * sum(dealt.values())
        assert abs(dealt[source] - share) <= 2 * mixing.BLOCK_ROWS


def test_sharding(spark, folder):
    docs = docs_of(spark, folder)
    rows = STAGES["sharding"](spark, docs, folder).collect()
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    shard = {}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(text_of)) and all(0 <= r["shard"] < corpus_pipeline.SHARDS for r in rows)
    assert all(shard.setdefault(text_of[r["doc_id"]], r["shard"]) == r["shard"] for r in rows)


def test_run_is_its_stages(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    want = Counter(r["doc_id"] for r in docs.collect())
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in found) == want and len(found) > 60
