"""Each operator against a brute-force version, on texts with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from terrella.llm import balltree, fmindex, interleave, licenses, media, ngrams, packing, pieces, quality, simhash, substrings, wordhash
from terrella.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Él", "naïve", "日本", "x" * 50]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", "en", "b", 3), (4, "a b c", "en", None, 5)]
    for i in range(5, n):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        if i % 7 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = passage.split()
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        rows.append((i, text, "en", "a" if i % 3 else f"s{i % 5}", len(text)))
    rows += [(n + i, rows[20][1], "en", "a", 0) for i in range(10)]  # copies
    rows += [rows[30], rows[30]]  # the same row again
    rows.append((n + 50, " ".join(["again"] * 80), "en", "a", 0))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names the operators use inside.
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("score", F.lit(1)).withColumn("shard", F.lit(9)).withColumn("length", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in pieces.encode(docs, MODEL).collect())
    want = []
    for i, text, *_ in rows:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        plain = lib.decode(ids)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), plain))
    assert got == sorted(want)


def test_pieces_on_odd_strings():
    import sentencepiece

    lib, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.vocabulary(MODEL)
    table = pieces.ChunkTable(v, lib)
    rng = np.random.default_rng(1)
    odd = ["", " ", "  ", "\n", " \n", "\n ", "▁a", "a▁b", "<s>", "\x00a", "é日本\U0001F600", "x" * 500, "ab" * 300 + " " * 40 + "z"]
    odd += ["".join(rng.choice(list("ab the\n  \n▁é日\U0001F600\t\rxyz<>s0.,!"), int(rng.integers(1, 80)))) for _ in range(400)]
    for text in odd:
        chunks = v.chunks(text)
        table.learn(set(chunks))
        data = b"".join(table[c] for c in chunks)
        ids = [v.begin, *struct.unpack(f"<{len(data) // 4}I", data), v.end]
        assert ids == lib.encode(text, add_bos=True, add_eos=True), text
        assert v.decode(ids) == lib.decode(ids)
    for _ in range(300):
        ids = rng.integers(0, 400, int(rng.integers(1, 12))).tolist()
        ids = [i for i in ids if i > 2]
        assert v.decode(ids) == lib.decode(ids)
    long = list("thetionthe" * 30)
    assert v._by_heap(long[:]) == v._by_scan(long[:])


def test_a_wrong_chunk_is_noticed():
    class Wrong:
        def encode(self, chunks, num_threads):
            return [[0]] * len(chunks)

    with pytest.raises(AssertionError):
        pieces.ChunkTable(pieces.vocabulary(MODEL), Wrong()).learn({"the"})


def brute_top(vectors, k):
    out = {}
    for q, x in vectors:
        if q % 20 == 0:
            scores = sorted((-int(np.dot(x, y)), i) for i, y in vectors if i != q)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("shard,per_task", [(16_384, 8_192), (40, 3)])
def test_top_k(spark, shard, per_task):
    rng = np.random.default_rng(2)
    data = [(i, rng.integers(-3, 4, 6) / 64) for i in range(300)]  # small whole numbers: many ties
    rows = [(i, [float(c) for c in x]) for i, x in data] + [(1000, None), (1020, [None, 1.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] + [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = {}
    for r in balltree.top_k(table, F.col("vec_id") % 20 == 0, shard=shard, per_task=per_task).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_top([(i, np.floor(64 * x)) for i, x in data], 20)


def test_top_k_of_clusters_with_a_hot_vector(spark, monkeypatch):
    """A third of all rows are one vector, the rest lie in far clusters: no task holds the hot ball, far balls are not visited."""
    rng = np.random.default_rng(4)
    centres = np.eye(6) * 20
    data = [(i, np.floor(rng.integers(-1, 2, 6) + centres[i % 6]) / 64) for i in range(400)] + [(i, centres[0] / 64) for i in range(400, 600)]
    table = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in data], "vec_id long, embedding array<double>")
    seen = []
    settle = balltree.CoarseBalls.settle
    monkeypatch.setattr(balltree.CoarseBalls, "settle", lambda balls, *found: (settle(balls, *found), seen.append(balls))[0])
    got = {}
    for r in balltree.top_k(table, F.col("vec_id") % 20 == 0, k=5, shard=40, per_task=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_top([(i, np.floor(64 * x)) for i, x in data], 5)
    balls = seen[0]
    assert balls.shards.max() > 1 and len(balls.centres) > 4
    asked = np.array([np.floor(64 * x) for i, x in data if i % 20 == 0])
    kth = np.array([got[i][-1][2] for i, _ in data if i % 20 == 0], float)
    at, _ = balls.visits(asked, kth)
    assert len(at) < len(asked) * (balls.shards.sum() - 1) / 2


def test_top_k_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in balltree.top_k(table, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert balltree.top_k(table.filter("vec_id > 9"), F.col("vec_id") % 20 == 0).count() == 0


def test_license_scan(spark, nothing):
    text = licenses.KNOWN["MIT"]
    shouted = "Copyright (c) 2021 Somebody\n\n" + text.upper().replace(",", " ,")
    rows = [(1, text), (2, shouted), (3, text + " but not quite"), (4, None), (5, ""), (6, "Copyright 2020 A"), (7, licenses.KNOWN["Apache-2.0-header"].replace("License", "Licence")), (8, "Роман в стихах. " * 9 + text), (9, "The MIT License (MIT)\n\nCopyright (c) Jane Doe\n\n" + text), (10, "ISC License\n" + text)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "Apache-2.0-header", 8: None, 9: "MIT", 10: None}
    assert licenses.scan(nothing).count() == 0


def test_licenses_wrapped_anywhere_under_any_notice(spark):
    import textwrap

    notices = ["", "Copyright (c) 2021 Somebody", "Copyright Jane Doe", "Copyright (c) The Foo Authors", "(c) 1999-2004 A. B.", "© Jane Doe", "Copyright 2020 A\nAll rights reserved."]
    rows, want = [], {}
    for name in licenses.KNOWN:
        for width in (40, 55, 60, 66, 70, 72, 76, 79, 80, 100):
            body = "\n\n".join(textwrap.fill(p, width) for p in licenses.KNOWN[name].split("\n\n"))
            for notice in notices:
                want[len(rows)] = name
                rows.append((len(rows), f"{notice}\n\n{body}"))
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_license_files(spark, tmp_path):
    (tmp_path / "Long-1.0.txt").write_text("A licence of\nits own, and long.")
    (tmp_path / "Other").write_text("Another one")
    known = licenses.known_texts(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "a LICENSE of its own and long"), (2, "another"), (3, "another one!")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, known).collect()} == {1: "Long-1.0", 2: None, 3: "Other"}


def test_license_sql_finds_the_same(spark, rows):
    """The SQL of the query over planted licences, untitled, titled and with notices, and texts that have none."""
    import duckdb
    import pandas as pd

    planted = [(10_000 + i, f"{notice}\n\n{text}") for notice in ("", "Copyright (c) 2021 Somebody") for i, (_, text) in enumerate(licenses.known_rows())]
    texts = [(r[0], r[1]) for r in rows[:60]] + [(i + 500 * k, t) for k, (i, t) in enumerate(planted)] + [(8, "日本語 " + licenses.KNOWN["MIT"]), (9, "ÉÀ straße Ünï")]
    documents = pd.DataFrame(texts, columns=["doc_id", "text"])
    want = duckdb.connect().register("documents", documents).execute(licenses.scan_sql()).fetchall()
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] is not None for r in got) == len(planted)


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return "0" * 16
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def brute_components(points, radius):
    label = list(range(len(points)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(points))]


def test_simhash(docs, rows):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id").collect()}
    points = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components([int(p, 16) for p in points], 4)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r[0]), r[0])
    assert got == {(r[0], p, least[root]) for r, p, root in zip(rows, points, roots, strict=True)}


@pytest.mark.parametrize("shard", [40, 100_000])
def test_links_lose_nothing(spark, shard):
    """A dense cluster, chains and scattered points, over many shards and in one."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 250)]
    points = set(base)
    for b in base[:60]:
        points.add(b ^ sum(1 << int(i) for i in rng.choice(64, 4, replace=False)))
    points |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64)
    fps = spark.createDataFrame([(int(x),) for x in signed], "fp long").repartition(3)
    forest = simhash.links(fps, len(points), shard=shard)
    edges = forest.collect()
    assert len(edges) < 12 * len(points)
    assert all((int(np.int64(e["a"]).view(np.uint64)) ^ int(np.int64(e["b"]).view(np.uint64))) >= 0 for e in edges)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges or [(0, 0)], "a long, b long")).collect()}
    mine = [roots.get(int(x), int(x)) for x in signed]
    want = brute_components(points, 4)
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(want)) == len(set(mine))


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert ids == sorted(set(groups.values()))


def test_two_texts_of_one_id_are_told_apart(spark):
    rows = [(5, "one two three four five"), (7, "one two three four five"), (7, "six seven eight nine ten"), (7, "six seven eight nine ten"), (8, "Six seven eight nine ten"), (None, "one two three four five")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media(docs, rows):
    got = {r["doc_id"]: r for r in media.store_text(docs).collect()}
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() == hashlib.sha256(media.from_tiles(r["media"]).tobytes()).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_image_forms():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.decode(b"P5 # c\n7 5\n255\n" + grey.tobytes()) == grey).all()
    wide = (grey.astype(np.uint16) * 300)
    assert (media.decode(b"P5\n7 5\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    colour = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(b"P6\n7 5\n255\n" + colour.tobytes()) == colour).all()
    bits = grey % 2
    assert (media.decode(b"P4\n7 5\n" + np.packbits(np.pad(bits, ((0, 0), (0, 1))), axis=1).tobytes()) == (1 - bits) * 255).all()
    stride = (7 * 3 + 3) // 4 * 4
    pixels = np.zeros((5, stride), np.uint8)
    pixels[:, :21] = colour[::-1, :, ::-1].reshape(5, 21)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + pixels.size, 0, 0, 54, 40, 7, 5, 1, 24, 0, pixels.size, 0, 0, 0, 0)
    assert (media.decode(head + pixels.tobytes()) == colour).all()
    palette = np.zeros((256, 4), np.uint8)
    palette[:, 0] = palette[:, 1] = palette[:, 2] = np.arange(256)
    indexed = np.zeros((5, 8), np.uint8)
    indexed[:, :7] = grey
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + 1024, 40, 7, -5, 1, 8, 0, 0, 0, 0, 256, 0)
    assert (media.decode(head + palette.tobytes() + indexed.tobytes())[:, :, 0] == grey).all()
    # Old core header with a palette of three bytes; fields of 5, 6 and 5 bits; 5, 5 and 5 bits.
    head = struct.pack("<2sIHHIIHHHH", b"BM", 0, 0, 0, 26 + 768, 12, 7, 5, 1, 8)
    assert (media.decode(head + np.ascontiguousarray(palette[:, :3]).tobytes() + indexed[::-1].tobytes())[:, :, 0] == grey).all()
    packed = np.zeros((5, 8), "<u2")
    packed[:, :7] = (colour[:, :, 0] >> 3).astype(int) << 11 | (colour[:, :, 1] >> 2).astype(int) << 5 | colour[:, :, 2] >> 3
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 66, 40, 7, -5, 1, 16, 3, 0, 0, 0, 0, 0) + struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    got = media.decode(head + packed.tobytes())
    assert got.dtype == np.uint8 and (abs(got.astype(int) - colour) <= 8).all() and media.decode(head + np.full((5, 8), 0xFFFF, "<u2").tobytes()).min() == 255
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 7, -5, 1, 16, 0, 0, 0, 0, 0, 0)
    assert media.decode(head + np.full((5, 8), 0x7C00, "<u2").tobytes()).tolist() == [[[255, 0, 0]] * 7] * 5
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize():
    x = np.random.default_rng(4).random((12, 18))
    np.testing.assert_allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean((1, 3)))
    np.testing.assert_allclose(media.area_resize(x, 5, 7).mean(), x.mean())
    fine = np.repeat(np.repeat(x, 5, 0), 7, 1)
    np.testing.assert_allclose(media.area_resize(x, 5, 7), fine.reshape(5, 12, 7, 18).mean((1, 3)))
    tall = np.random.default_rng(5).integers(0, 256, (2 * media.STRIP_ROWS + 70, 6)).astype(np.uint8)  # over three strips
    n = len(tall)
    np.testing.assert_allclose(media.area_resize(tall, 2, 3), tall.reshape(2, n // 2, 3, 2).mean((1, 3)))
    np.testing.assert_allclose(media.area_resize(tall, 9, 5), np.repeat(np.repeat(tall.astype(float), 9, 0), 5, 1).reshape(9, n, 5, 6).mean((1, 3)))


def test_image_table(spark):
    buffer = io.BytesIO()
    buffer.write(b"P5\n9 8\n255\n" + bytes(range(72)))
    table = spark.createDataFrame([(1, bytearray(buffer.getvalue()), 5), (2, None, 6), (3, bytearray(b"P5\n9"), 7), (4, bytearray(b"P5\n0 4\n255\n"), 8), (5, bytearray(b"P6\n4 0\n255\n"), 8)], "id long, content binary, height long")
    got = {r["id"]: r for r in media.image_features(table).collect()}
    assert got[1]["height"] == 8 and got[1]["feature"] == "ff" * 8 and got[2]["error"] and got[3]["error"]
    assert [(got[i]["height"], got[i]["width"], got[i]["feature"], got[i]["error"]) for i in (4, 5)] == [(4, 0, "0" * 16, None), (0, 4, "0" * 16, None)]


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rows = [*rows, (7000, "a <|endoftext|> b", "en", "a", 17), (7001, "<|endoftext|><|endoftext|>\n", "en", "a", 0), (7002, "<|endoftext| >", "en", "a", 0)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[-3:], SCHEMA), allowMissingColumns=True)
    got = packing.pack_documents(docs, BYTE_BPE, length=64).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in by_doc[i]})
        assert b"".join(p[4] for p in parts) == np.array(ids, "<u4").tobytes()
        assert all(zlib.crc32(p[4]) == p[3] and p[2] * 4 == len(p[4]) for p in parts)
        assert all(p[2] == 64 for p in parts[1:]) and [p[1] for p in parts] == np.cumsum([0] + [p[2] for p in parts[:-1]]).tolist()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 64
    assert len(got) == sum(len(v) for v in by_doc.values())
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 64) + 2


def test_best_two_fit_uses_up_everything():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 20, replace=False), rng.integers(1, 50, 20), strict=True)}
        used = Counter()
        for lengths, copies in packing.best_two_fit(counts, 100):
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] += copies
        assert used == Counter(counts)
    # 60 + 30 leaves 10; two of 20 fit the gap that 30 leaves more tightly.
    assert sorted(packing.best_two_fit({60: 1, 30: 1, 20: 2}, 100)[0][0]) == [20, 20, 60]


@pytest.mark.parametrize("options", [{}, {"hot_spans": 1, "block_bytes": 9_000, "bucket_bytes": 5_000}, {"hot_spans": 12, "block_bytes": 3_000, "bucket_bytes": 40_000}, {"window": 12, "gram": 5, "block_bytes": 5_000}, {"window": 3}, {"window": 75, "gram": 5}])
def test_substrings(docs, rows, options):
    w = options.get("window", 35)
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    want = []
    for r, x in zip(rows, words, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = True
        kept = [a for a, g in zip(x, gone, strict=True) if not g]
        want.append((r[0], len(x), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted(tuple(r) for r in substrings.duplicate_words(docs, **options).collect()) == sorted(want)
    assert sum(x[2] for x in want) > 0


def test_substrings_keep_columns_of_any_name(spark):
    """Names that the operator uses inside, or that need quotes, come back as they were."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a {passage} b", "x", 7, "r", 3), (2, f"c  d\t{passage}", None, 8, None, None), (None, passage, "y", None, "s", 1), (3, None, "z", 1, "t", 2)]
    names = ["doc_id", "text", "_rid", "block", "a.b", "c0"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, y long, z string, w int").toDF(*names)
    cut = substrings.without_repeats(docs)
    assert cut.columns == names
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([(1, "a b", "x", 7, "r", 3), (2, "c  d\t", None, 8, None, None), (None, "", "y", None, "s", 1), (3, None, "z", 1, "t", 2)], key=str)


def test_texts_without_repeats(docs, rows):
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    want = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substrings.duplicate_words(docs).collect()}
    before = {r[0]: r[1] for r in rows}
    for r in cut.collect():
        assert len(WORD.findall(r["text"] or "")) == want[r["doc_id"]]
        if before[r["doc_id"]] is not None and len(WORD.findall(before[r["doc_id"]])) == want[r["doc_id"]]:
            assert r["text"] == before[r["doc_id"]]


def test_index():
    rng = np.random.default_rng(6)
    text = rng.integers(1, 4, 300)
    index = fmindex.FMIndex(text, 4)
    plain = text.tolist()
    ends = np.arange(300)
    got = index.matching_statistics(text, ends, np.minimum(ends + 1, 12))
    for e in range(300):
        best = 0
        for n in range(1, min(12, e + 1) + 1):
            p = plain[e - n + 1 : e + 1]
            if sum(plain[i : i + n] == p for i in range(300 - n + 1)) < 2:
                break
            best = n
        assert got[e] == best
    order = fmindex.suffix_order(text)
    assert [plain[i:] for i in order] == sorted(plain[i:] for i in range(300))


def test_word_hashes():
    texts = ["", "a b\tc", "é  日本\n", "a", "x" * 100]
    hashes, owner = wordhash.text_words([t.encode() for t in texts])
    words = [(w, i) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert len(hashes) == len(words) and owner.tolist() == [i for _, i in words]
    assert len({int(h) for h in hashes}) == len({w for w, _ in words}) and hashes[0] == hashes[-2]
    long = [b"y" * n for n in range(1, 200)] + [b"y" * n + b"z" for n in range(200)]
    assert len(np.unique(wordhash.text_words(long)[0])) == len(long)
    a, b = b"a", b"b"
    for _ in range(13):  # a polynomial hash cannot tell these apart from 1,024 bytes on
        a, b = a + b, b + a
        assert len(np.unique(wordhash.text_words([a, b])[0])) == 2


def lm_tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), "</>"]


def test_lm_base(docs, rows):
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 5 != 1:
            train.update(lm_tokens(r[1]))
    total, kinds = sum(train.values()), len(train)
    got = sorted(ngrams.score_texts(docs, block_bytes=2_000).collect(), key=lambda r: r["doc_id"])
    for g, r in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        t = lm_tokens(r[1])
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), total)
        assert g["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 1)
        assert g["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t), rel=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_automaton_sums_to_one_in_every_state():
    rng = np.random.default_rng(7)
    stream = rng.integers(1, 6, 4000)
    base = 6
    counts = np.bincount(stream, minlength=base)
    counts[stream[-1]] += 0
    pairs, triples = Counter(), Counter()
    for a, b in zip(stream, stream[1:], strict=False):
        pairs[int(a) * base + int(b)] += 1
    for a, b, c in zip(stream, stream[1:], stream[2:], strict=False):
        triples[(int(a) * base + int(b)) * base + int(c)] += 1
    kept = {k: v for k, v in pairs.items() if v > 170}
    kept3 = {k: v for k, v in triples.items() if v > 30 and k // base in kept}
    a = ngrams.Automaton(counts, kept, kept3, int(counts.sum()), 0.0, (0.6, 0.8), base, 1)
    for s in range(len(a.state)):
        score, _ = a.step(np.full(base - 1, s), np.arange(1, base))
        assert (10**score).sum() == pytest.approx(1, abs=2e-3)
    # Side by side or one by one: the same scores.
    words = rng.integers(0, 6, 500)
    first = np.zeros(500, bool)
    first[[0, 100, 101, 350]] = True
    rare = np.where(words == 0, -3.0, 0.0)
    state, want = 0, []
    for w, f in zip(words, first, strict=True):
        state = a.start if f else state
        if w == 0:
            want.append(a.fall[state] - 3.0)
            state = 0
        else:
            x, y = a.step(np.array([state]), np.array([w]))
            want.append(x[0])
            state = int(y[0])
    np.testing.assert_allclose(a.read(words, first, rare), want)


def brute_backoff(rows):
    """Scores of a backoff model as its formulas say, gram by gram: no automaton, no hashes, no blocks."""
    stream = {i: ["</>", *lm_tokens(t)] for i, t in rows}
    grams = [Counter(), Counter(), Counter()]
    for i, x in stream.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            grams[0].update((w,) for w in x[1:])
            for n in (1, 2):
                grams[n].update(tuple(x[k : k + n + 1]) for k in range(len(x) - n))
    words, pairs = grams[0], {g: c for g, c in grams[1].items() if c >= 2}
    of_kept = {g: c for g, c in grams[2].items() if g[:2] in pairs and g[1:] in pairs}
    triples = {g: c for g, c in of_kept.items() if c >= 2}
    # A pair whose first word is the start shares the end's count, as a text begins in the state of an end.
    total, seen = sum(words.values()), [Counter(c.values()) for c in (words, grams[1], of_kept)]
    takes = [s[1] / (s[1] + 2 * s[2]) if s[1] and s[2] else d for s, d in zip(seen, (0.5, 0.75, 0.75), strict=True)]
    ones, twos = seen[0][1], seen[0][2]
    unseen = max(1.0, ones * ones / (2 * max(twos, 1)))
    after = {}
    for g in [*pairs, *triples]:
        after.setdefault(g[:-1], []).append(g[-1])

    def left(history, cut, table, whole):
        return max(1 - sum((table[(*history, w)] - cut) / whole for w in after[history]), 1e-12)

    def probability(history, w):
        if not history:
            return (words[(w,)] - takes[0]) / total if words[(w,)] else takes[0] * len(words) / total / unseen
        n, table = len(history), pairs if len(history) == 1 else triples
        whole = words[history] if n == 1 else pairs.get(history, 0)
        if (*history, w) in table:
            return (table[(*history, w)] - takes[n]) / whole
        lower = probability(history[1:], w)
        if history not in after:
            return lower
        if history not in weights:
            weights[history] = left(history, takes[n], table, whole) / max(1 - sum(probability(history[1:], x) for x in after[history]), 1e-12)
        return weights[history] * lower

    weights = {}
    return {i: sum(math.log10(probability(tuple(x[max(0, k - 2) : k]), x[k])) for k in range(1, len(x))) for i, x in stream.items()}


def test_scores_are_those_of_a_backoff_model(spark):
    """Over so many tokens that a share of 5e-6 would be three of them: pairs seen twice count at every size."""
    rng = np.random.default_rng(12)
    common = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(common[min(int(z), 2000) - 1] for z in rng.zipf(1.3, 2600))) for i in range(240)]
    rows = [(i, f"{t} left{i // 2} right{i // 2} end{i // 2}") for i, t in rows]
    want = brute_backoff(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for got in ngrams.score_texts(table, block_bytes=400_000, bucket_bytes=300_000).collect():
        assert got["score"] == pytest.approx(want[got["doc_id"]], rel=1e-9)


def test_scores_of_the_odd_corpus(docs, rows):
    want = Counter()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    if any(len(set(x)) > 1 for x in texts.values()):
        raise AssertionError("the brute force knows one text by doc_id")
    unique = [(i, x[0]) for i, x in texts.items()]
    want = brute_backoff(unique)
    table = docs.dropDuplicates(["doc_id"])
    for got in ngrams.score_texts(table, block_bytes=3_000, bucket_bytes=2_000).collect():
        assert got["score"] == pytest.approx(want[got["doc_id"]], rel=1e-9)


def test_quality(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["the", "of", "and", "river", "mountain", "walks", "slowly", "green", "house", "over"]
    rows, marks = [], []
    for i in range(1500):
        words = list(rng.choice(vocabulary, 60))
        bad = i % 7 == 0
        text = "!! ".join(w.upper() for w in words) if bad and i % 2 else "### ".join(words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text))
        if i % 3:
            marks.append((i, int(not bad), 0))
    rows += [(9000, None), (9001, ""), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(i, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def plain_risk(p, u, prior, w):
    """The non-negative unbiased risk as its formula says, row by row."""
    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(-z, 0)
    right = sum(loss(float(x @ w)) for x in p) / len(p)
    wrong = sum(loss(-float(x @ w)) for x in p) / len(p)
    return prior * right + max(0.0, sum(loss(-float(x @ w)) for x in u) / len(u) - prior * wrong)


def test_quality_minimises_the_risk():
    """Against plain descent on numerical slopes of the same risk."""
    rng = np.random.default_rng(14)
    p, n = rng.normal(1, 1, (150, 2)), rng.normal(-1, 1, (60, 2))
    u = np.concatenate([rng.normal(1, 1, (140, 2)), n])
    centre, scale, w = quality.fit(p, u, 0.7)
    standard = lambda x: np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])
    ps, us, plain = standard(p), standard(u), np.zeros(3)
    for _ in range(150):
        slope = [(plain_risk(ps, us, 0.7, plain + 1e-5 * e) - plain_risk(ps, us, 0.7, plain - 1e-5 * e)) / 2e-5 for e in np.eye(3)]
        plain -= 0.5 * np.array(slope)
    assert plain_risk(ps, us, 0.7, w) <= plain_risk(ps, us, 0.7, plain) + 0.01
    got = quality.margins(u, (centre, scale, w))
    assert np.mean((got > 0) == (us @ plain > 0)) > 0.95


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior_needs_no_negatives(share):
    rng = np.random.default_rng(15)
    positive, unlabelled = rng.normal(1.5, 1, (4000, 3)), np.concatenate([rng.normal(1.5, 1, (int(6000 * share), 3)), rng.normal(-1.5, 1, (6000 - int(6000 * share), 3))])
    assert quality.class_prior(positive, rng.permutation(unlabelled)) == pytest.approx(share, abs=0.06)


def test_quality_scores_follow_the_features(spark, docs, rows):
    """Against features counted character by character and a plain weighted sum; the sample is bounded whatever a doc_id repeats."""
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    (centre, scale, w), _ = model
    for r in quality.score(docs, model).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        x = [0.0] * quality.WIDTH
        if text:
            data, words, lines = text.encode(), text.split(), text.split("\n")
            x[:128] = [math.sqrt(data.count(bytes([b])) / len(data)) for b in range(128)]
            part = lambda test: sum(map(test, data)) / len(data)
            lower, upper, digits, wide = part(lambda b: 97 <= b < 123), part(lambda b: 65 <= b < 91), part(lambda b: 48 <= b < 58), part(lambda b: b > 127)
            most = [c for _, c in Counter(words).most_common(3)] or [0]
            many, n = len(words) >= 8, max(1, len(words))
            x[128:] = [
                lower, upper, digits, lower + upper + wide, wide, 1 - lower - upper - wide - digits - part(lambda b: b == 32 or 9 <= b < 14), upper / (lower + upper + 1e-3),
                sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1), most[0] / n * many, sum(most) / n * many, len(data) / n / 20, math.log1p(len(words)) / 10,
                1 - len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)) / 10,
            ]
        z = float(np.clip((np.array(x, np.float32) - centre) / scale, -8, 8) @ w[:-1] + w[-1])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4) and r["predicted"] == (r["score"] >= 0.3)
    one = spark.createDataFrame([(3, f"text {i % 400}") for i in range(900)], "doc_id long, text string")
    p, u = quality.sampled(one, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), 20, 30)
    assert len(p) <= 40 and len(u) <= 60


def test_quality_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert quality.score(nothing, quality.train(nothing, none)).count() == 0


@pytest.mark.parametrize("each", [8, 100_000])
def test_interleave(docs, rows, each):
    got = interleave.interleave(docs, shards=16, rows_per_bucket=each).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for stratum, n in Counter(r["stratum"] for r in got).items():
        shares = Counter(r["shard"] for r in got if r["stratum"] == stratum)
        assert all(abs(shares[s] - n / 16) <= 2 for s in range(16))


def test_interleave_is_the_same_for_every_bucket_size(docs):
    rows = [sorted(tuple(r) for r in interleave.interleave(docs, rows_per_bucket=n).collect()) for n in (10, 1000)]
    assert rows[0] == rows[1]


def test_empty_tables(nothing):
    assert pieces.encode(nothing, MODEL).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert media.store_text(nothing).count() == 0
    assert packing.pack_documents(nothing, BYTE_BPE).count() == 0
    assert substrings.duplicate_words(nothing).count() == 0
    assert ngrams.score_texts(nothing).count() == 0
    assert interleave.interleave(nothing).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e", "en", "s", 0), (None, "a b c d e", "en", "s", 0), (None, None, None, None, None), (5, "q r s", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame([(None, [1.0]), (0, [2.0]), (0, [2.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in balltree.top_k(vectors, F.col("vec_id") % 20 == 0).collect()) == [(0, 1)]
    labels = spark.createDataFrame([(None, 1, 0), (5, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 4
    for n in (pieces.encode(docs, MODEL).count(), simhash.near_duplicates(docs).count(), media.store_text(docs).count(), packing.pack_documents(docs, BYTE_BPE).count(), substrings.duplicate_words(docs).count(), ngrams.score_texts(docs).count(), interleave.interleave(docs).count(), licenses.scan(docs).count()):
        assert n == 4
