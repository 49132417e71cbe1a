"""The near-duplicate stage by SimHash, held against all pairs."""

import re
from collections import Counter

import numpy as np


def groups(texts):
    """The least index reachable from each text by pairs of a similarity of 0.8 or more, by comparing all."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "One\tTWO", "one two three four five", "one two three four five five", "x " * 400, "x " * 90]
    for _ in range(20):  # a chain: first and last are far apart
        words = list(rng.choice(vocabulary, int(rng.integers(20, 200))))
        for _ in range(int(rng.integers(2, 12))):
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
    passage = list(rng.choice(vocabulary, 100))
    texts += [" ".join([*passage, *rng.choice(vocabulary, int(rng.integers(5, 40)))]) for _ in range(120)]  # about as similar as it takes
    return texts + texts[20:50]


def test_stage_links_by_fingerprints_in_trees(spark, monkeypatch):
    """The pipeline's stage gets texts of near fingerprints from the vantage-point trees, and the exact check has the last word."""
    import corpus_pipeline
    from terrella.llm import simhash

    seen, links = [], simhash.links

    def spied(fps, rows, **options):
        out = links(fps, rows, **options)
        seen.append(({r["fp"] for r in fps.collect()}, [tuple(r) for r in out.collect()]))
        return out

    monkeypatch.setattr(simhash, "links", spied)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())
    assert kept == sorted(set(groups(texts)))
    ((fps, found),) = seen
    assert fps <= {int.from_bytes(simhash.fingerprint(t or "", 5), signed=True) for t in texts} and len(fps) > 100 and found


def test_links_of_any_order_of_shingles(spark):
    """In one block and bucket or many, the groups are those of all pairs."""
    from terrella.llm import nearcopies

    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = groups(texts)
    for options in ({}, {"block_bytes": 20_000, "bucket_bytes": 30_000, "bucket": 500}):
        root = {r["doc_id"]: r["root"] for r in nearcopies.near_copies(docs, **options).collect()}
        least = {}
        for i in range(len(texts)):
            least.setdefault(root[i], i)
        assert [least[root[i]] for i in range(len(texts))] == want


def test_shared_passages_come_last(spark):
    """Texts that only share a passage do not meet, also where few of all texts hold it."""
    from terrella.llm import nearcopies

    rng = np.random.default_rng(3)
    own = lambda: " ".join(f"u{x}" for x in rng.integers(0, 10**9, 80))
    texts = [f"{' '.join(f'p{i // 3}x{k}' for k in range(40))} {own()}" for i in range(60)]  # each passage in three texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.marked(docs, block_bytes=4_000, bucket_bytes=4_000).collect()
    prefixes = [np.frombuffer(r["prefix"], np.uint64).tolist() for r in rows]
    assert [r["size"] for r in rows] == [116] * 60 and {len(p) for p in prefixes} == {116 - 93 + 1}
    assert max(Counter(x for p in prefixes for x in p).values()) == 1


def test_odd_rows(spark):
    from terrella.llm import nearcopies

    schema = "doc_id long, text string, node string, root int, size int, prefix int, `a.b` int, fp int, _text_key int"
    rows = [(1, "a b c d e f", "n", 1, 2, 3, 4, 5, 6), (2, "a b c d e f", "n", 1, 2, 3, 4, 5, 6), (None, "a b c d e f", None, None, None, None, None, None, None), (3, None, None, 0, 0, 0, 0, 0, 0), (4, "", "", 0, 0, 0, 0, 0, 0), (5, "z", None, 7, 0, 0, 0, 0, 0), (5, "y", None, 8, 0, 0, 0, 0, 0), (5, "y", None, 8, 0, 0, 0, 0, 0)]
    kept = nearcopies.deduplicated(spark.createDataFrame(rows, schema))
    assert kept.schema.names == ["doc_id", "text", "node", "root", "size", "prefix", "a.b", "fp", "_text_key"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (3, None), (5, "z"), (5, "y")], key=str)
    assert nearcopies.deduplicated(spark.createDataFrame([], schema)).count() == 0
