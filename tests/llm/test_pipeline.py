"""The stages in order, each held against what it should do to its own input."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary, 55))
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(40, 120))))
        if i % 9 == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif i % 10 == 1:
            text = f"{text} {passage} {' '.join(rng.choice(vocabulary, 10))}"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(1000 + i, rows[2][1], "en", "s", 0) for i in range(20)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(600) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from terrella.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(common.written(stage(spark, held[-1], sf_dir), name.replace(" ", "-")))
    raw, good, single, cut, packed = (d.collect() for d in held)
    assert [d.columns for d in held[:4]] == [docs.columns] * 4
    kept = {r["doc_id"] for r in good}
    assert sum(i in kept for i in range(600) if i % 9) > 520 and sum(i in kept for i in range(0, 600, 9)) < 7
    assert Counter(r["text"] for r in single).most_common(1)[0][1] == 1 and {r["text"] for r in single} == {r["text"] for r in good}
    assert len(cut) == len(single)
    before = {r["doc_id"]: r["text"] for r in single}
    shared = [r for r in cut if r["doc_id"] % 10 == 1 and r["doc_id"] % 9 and r["doc_id"] < 600]
    assert shared and all(len(before[r["doc_id"]].split()) - len(r["text"].split()) in (55, 56, 57) for r in shared)
    assert all(r["text"] == before[r["doc_id"]] for r in cut if r["doc_id"] % 10 != 1 and r["doc_id"] < 600)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in cut}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)
    assert len(raw) == 620


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n[2:3].isdigit()} == {f"op{i}" for i in range(1, 11)}


def test_near_copies_of_five_word_shingles_go(spark):
    """Pairs of similarity 0.8 or more lose one text however far apart their fingerprints are, less similar ones none; one doc_id may have two texts."""
    import corpus_pipeline
    from terrella.llm import simhash

    rng = np.random.default_rng(21)
    vocabulary = [f"word{i}" for i in range(3000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, want, apart = [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (None, "a b")], {None, 5000, 5002}, 0
    for i in range(120):
        one = rng.choice(vocabulary, 200)
        two = one.copy()
        for at in rng.integers(0, 200, i // 12 + 1):
            two[at] = "changed"
        a, b = shingles(one.tolist()), shingles(two.tolist())
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two).upper())]
        near = len(a & b) >= 0.8 * len(a | b)
        want |= {2 * i} if near else {2 * i, 2 * i + 1}
        x, y = (int.from_bytes(simhash.fingerprint(t)) for _, t in rows[-2:])
        apart += near and (x ^ y).bit_count() > 4
    assert apart > 10
    rows += [(9000, "one two three four five six"), (9000, "seven eight nine ten eleven twelve"), (9000, "seven eight nine ten eleven twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert sorted(i for i, _ in got if i is not None and i < 9000) == sorted(i for i in want if i is not None)
    assert sorted(t for i, t in got if i == 9000) == sorted({t for i, t in rows if i == 9000}) and (None, "a b") in got


def _groups(texts):
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


def test_near_copies_by_brute_force(spark):
    from terrella.llm import minhash

    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "One\tTWO", "one two three four five", "one two three four five five", "x " * 400, "x " * 90]
    for _ in range(25):  # each one drifts from the one before, so that first and last are far apart but joined by a chain
        words = list(rng.choice(vocabulary, int(rng.integers(20, 200))))
        for _ in range(int(rng.integers(2, 12))):
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
    passage = list(rng.choice(vocabulary, 100))
    texts += [" ".join([*passage, *rng.choice(vocabulary, int(rng.integers(5, 40)))]) for _ in range(150)]  # about as similar as it takes
    texts += texts[20:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    root = {r["doc_id"]: r["root"] for r in minhash.near_copies(docs).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(root[i], i)
    assert [least[root[i]] for i in range(len(texts))] == _groups(texts)
    assert sorted(r["doc_id"] for r in minhash.deduplicated(docs).collect()) == sorted(set(_groups(texts)))


def test_near_copies_of_odd_rows(spark):
    from terrella.llm import minhash

    schema = "doc_id long, text string, node string, root int, size int, shingle int, `a.b` int, key int, _text_key int"
    rows = [(1, "a b c d e f", "n", 1, 2, 3, 4, 5, 6), (2, "a b c d e f", "n", 1, 2, 3, 4, 5, 6), (None, "a b c d e f", None, None, None, None, None, None, None), (3, None, None, 0, 0, 0, 0, 0, 0), (4, "", "", 0, 0, 0, 0, 0, 0), (5, "z", None, 7, 0, 0, 0, 0, 0), (5, "y", None, 8, 0, 0, 0, 0, 0), (5, "y", None, 8, 0, 0, 0, 0, 0)]
    kept = minhash.deduplicated(spark.createDataFrame(rows, schema))
    assert kept.schema.names == ["doc_id", "text", "node", "root", "size", "shingle", "a.b", "key", "_text_key"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (3, None), (5, "z"), (5, "y")], key=str)
    assert minhash.deduplicated(spark.createDataFrame([], schema)).count() == 0
