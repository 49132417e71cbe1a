"""Removal of repeated passages: every window of words that also starts anywhere else goes.

Windows meet in buckets chosen by their content: a window's key is the least hash among its grams of a few words, so
equal windows have equal keys, and neighbouring windows mostly share one and travel as a single span. Blocks of texts ask
buckets of keys; what occurs once under its key is dropped. Of each different span one block sends the words. A bucket is a
shard: its spans are indexed by a compressed FM-index over a wavelet matrix, in which each place counts as often as its
span occurs, and backward search gives the matching statistics of all spans; those that reach a window's length are
reported, and the shard answers every block that holds the span with the windows that repeat. The index decides every window.

A key of very many different spans would make its shard large. Such spans are cut into their windows, which are dealt anew, each by the
hash of all its words; windows that occur once are dropped, and one copy of each other is indexed in the same way.

Equal spans and windows are known by two 64-bit hashes together, of a gram or of all their words.

Cases: a null text counts as empty; texts of fewer words than a window keep all; texts of any length are read whole; repeated rows repeat each other and lose all their
windows; rows without doc_id are treated like others; an empty table gives no rows; `duplicate_words` drops other columns, `without_repeats` keeps all, whatever
their names.
"""

from __future__ import annotations

import functools
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.blocks import BLOCK_BYTES, BUCKET_BYTES, Dealt, asked_of, asked_table, block_of, bytes_of, released, shared_out
from terrella.llm.common import written
from terrella.llm.fmindex import FMIndex
from terrella.llm.wordhash import mixed, prefix_sums, run_hashes, word_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW, GRAM = 35, 8
#: Different spans of a key beyond which they are cut into windows.
HOT_SPANS = 10_000
#: The rounds of questions: how often keys occur, how often spans do, and which of their windows repeat.
KEYS, SPANS, REPEATS = 0, 1, 2
#: Windows that one span may have, as their marks fit one number.
MARKS = 62
ASKED = "block long, part long, keys binary, found binary, words binary"
ANSWERED = "block long, part long, found binary"


def spans(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, content hash, start, number of windows and times of each run of windows that share their least gram.

    owner: the text each word is of; windows lie in one text. One word said over and over gives the same window at each place:
    such a row of equal spans of one window is given once, with the times it stands there.
    """
    n = len(hashes)
    if n < window:
        empty = np.array([], np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    grams = n - gram + 1
    sums = prefix_sums(hashes)
    least = run_hashes(sums, np.arange(grams), np.arange(gram, n + 1))
    place, width, wanted = np.arange(grams, dtype=np.int32), 1, window - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    whole = owner[window - 1 :] == owner[: n - window + 1]
    place = np.where(whole, place, -1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    first, count = first[whole[first]], count[whole[first]]
    key, content = least[first], run_hashes(sums, first, first + count + window - 1)
    again = np.zeros(len(first), bool)
    again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1]) & (count[1:] == 1) & (count[:-1] == 1) & (first[1:] == first[:-1] + 1)
    head = np.flatnonzero(~again)
    return key[head], content[head], first[head], count[head], np.diff(np.append(head, len(first)))


def repeated_windows(symbols: np.ndarray, sigma: int, base: np.ndarray, count: np.ndarray, times: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Span and offset of each window that occurs more than once among all spans.

    symbols: the spans' words, each span closed by symbol 0; base: where each begins; count: its windows; times: how often it occurs. A
    window can only repeat where each of its grams does, which is looked up first. Then each span's last open window is searched
    backwards through the whole span: the longest repeated run that ends there settles all windows inside it.
    """
    weights = np.repeat(times, count + window)
    index = FMIndex(symbols, sigma, weights)
    sums = prefix_sums(mixed(symbols.astype(np.uint64) + np.uint64(1)))
    grams = len(symbols) - gram + 1
    _, number = np.unique(run_hashes(sums, np.arange(grams), np.arange(gram, grams + gram)), return_inverse=True)
    single = np.concatenate([[0], np.cumsum(np.bincount(number, weights[:grams])[number] < 2)])
    span = np.repeat(np.arange(len(base)), count)
    offset = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    at = base[span] + offset
    may = single[at + window - gram + 1] == single[at]
    span, offset = span[may], offset[may]
    found = np.zeros(len(span), bool)
    left = np.arange(len(span))
    while len(left):
        last = left[np.append(span[left][1:] != span[left][:-1], True)]
        ends = base[span[last]] + offset[last] + window - 1
        longest = index.matching_statistics(symbols, ends, ends - base[span[last]] + 1)
        # Of each open window: the run found in its span reaches back to this offset.
        reach = (offset[last] + window - longest)[np.searchsorted(last, left)]
        settled = offset[left] >= reach
        found[left[settled]] = True
        settled[np.searchsorted(left, last)] = True
        left = left[~settled]
    return span[found], offset[found]


def grouped(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs, where each different one begins in it, and the number of each pair."""
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.array([], bool)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


class Block:
    """The words of a block's texts and their spans."""

    def __init__(self, texts: list[bytes], buckets: int, window: int, gram: int):
        self.buckets, self.window = buckets, window
        self.data = b"\n".join(texts)
        self.words, self.begin = word_hashes(self.data)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.owner = np.searchsorted(stops, self.begin, side="right")
        key, self.content, self.first, self.count, self.times = spans(self.words, self.owner, window, gram)
        self.key = mixed(key)  # the least of many hashes is small
        self.distinct, self.of = np.unique(self.key, return_inverse=True)
        self.dealt = Dealt(self.distinct, buckets)

    def ask_keys(self, block: int) -> list[tuple]:
        """Occurrences and different spans of each key."""
        order, at, _ = grouped(self.key, self.content)
        kinds = np.bincount(self.of[order[at]], minlength=len(self.distinct))
        return self.dealt.asked(block, KEYS, np.bincount(self.of, self.times, len(self.distinct)).astype(np.int64), kinds)

    def take_keys(self, found: dict[int, bytes]) -> None:
        """Keep what may repeat, cut the spans of hot keys into windows: items, each with a key, a content, its first word, windows and times."""
        code = self.dealt.answered(found, KEYS, 1)[0][self.of]
        plain, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 3)
        of = np.repeat(hot, self.count[hot])
        first = self.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(self.count[hot]) - self.count[hot], self.count[hot])
        whole = run_hashes(prefix_sums(self.words), first, first + self.window) if len(of) else np.array([], np.uint64)
        self.hot = np.repeat([False, True], [len(plain), len(of)])
        self.item_key = np.concatenate([self.key[plain], mixed(whole)])
        self.item_content = np.concatenate([self.content[plain], self.key[of]])
        self.item_first, self.item_times = np.concatenate([self.first[plain], first]), np.concatenate([self.times[plain], self.times[of]])
        self.item_count = np.concatenate([self.count[plain], np.ones(len(of), np.int64)])
        order, at, self.which = grouped(self.item_key, self.item_content)
        #: The first item of each different one.
        self.one = order[at]
        self.kinds = Dealt(self.item_key[self.one], self.buckets)

    def ask_spans(self, block: int) -> list[tuple]:
        """Occurrences of each different item, doubled, and odd if it is a window of a hot key."""
        n = np.bincount(self.which, self.item_times, len(self.one)).astype(np.int64)
        return self.kinds.asked(block, SPANS, self.item_content[self.one], 2 * n + self.hot[self.one])

    def take_spans(self, found: dict[int, bytes]) -> None:
        code = self.kinds.answered(found, SPANS, 1)[0]
        self.open = np.flatnonzero(code)
        self.weight = np.where(code & 1, code >> 1, 0)[self.open]
        self.asks = Dealt(self.item_key[self.one[self.open]], self.buckets)

    def text_of(self, first: int, words: int) -> bytes:
        stop = first + words
        return b" ".join(self.data[self.begin[first] : self.begin[stop] if stop < len(self.begin) else len(self.data)].split())

    def ask_repeats(self, block: int) -> list[tuple]:
        """Each item that is left, with the words of those that this block is the owner of."""
        item = self.one[self.open]
        rows, first, words = [], self.item_first[item], self.item_count[item] + self.window - 1
        for (_, a, b), row in zip(self.asks.runs, self.asks.asked(block, REPEATS, self.item_content[item], self.weight), strict=True):
            mine = [i for i in self.asks.order[a:b].tolist() if self.weight[i]]
            told = b"\n".join([self.text_of(first[i], words[i]) for i in mine])
            rows.append((*row, len(told).to_bytes(8, "little") + pa.compress(told, codec="zstd", asbytes=True)))
        return rows

    def gone(self, found: dict[int, bytes]) -> np.ndarray:
        """Which of the block's words repeated windows cover."""
        marks = np.zeros(len(self.one), np.int64)
        marks[self.open] = self.asks.answered(found, REPEATS, 1)[0]
        marks = marks[self.which]
        steps = np.zeros(len(self.words) + 1, np.int64)
        for offset in range(MARKS):
            at = np.flatnonzero(marks >> offset & 1)
            if len(at):
                start = self.item_first[at] + offset
                np.add.at(steps, start, 1)
                np.add.at(steps, start + self.window + self.item_times[at] - 1, -1)
        return np.cumsum(steps[:-1]) > 0


def asked_rows(rows: list[tuple]) -> pa.Table:
    words = pa.array([r[4] if len(r) > 4 else b"" for r in rows], pa.binary())
    return asked_table(rows).append_column("words", words)


def answered_rows(group: pa.Table, values: np.ndarray, size: list[int]) -> pa.Table:
    return pa.table({"block": group["block"], "part": group["part"], "found": shared_out(values, size)})


def key_facts(hot_spans: int):
    def run(group: pa.Table) -> pa.Table:
        """1 for keys that occur twice or more, 3 for those of very many different spans, 0 for others."""
        keys, (n, kinds), size = asked_of(group)
        _, of = np.unique(keys, return_inverse=True)
        twice, many = np.bincount(of, n) > 1, np.bincount(of, kinds) > hot_spans
        return answered_rows(group, (twice * (1 + 2 * many))[of][None], size)

    return run


def span_facts(group: pa.Table) -> pa.Table:
    """Occurrences (two for more) of each item, doubled, and odd for its first block; 0 for windows of hot keys that occur once."""
    keys, (content, n), size = asked_of(group)
    order, at, which = grouped(keys, content.view(np.uint64))
    total = np.bincount(which, n >> 1, len(at))
    out = 2 * np.minimum(total, 2).astype(np.int64)[which]
    out[order[at]] += 1
    return answered_rows(group, np.where((n & 1 > 0) & (total[which] < 2), 0, out)[None], size)


def searched(window: int, gram: int):
    def run(group: pa.Table) -> pa.Table:
        """Marks of the windows of each item that repeat."""
        keys, (content, weight), size = asked_of(group)
        told = [pa.decompress(w[8:], int.from_bytes(w[:8], "little"), codec="zstd", asbytes=True) for w in group["words"].to_pylist()]
        texts = [t.split(b" ") for part in told if part for t in part.split(b"\n")]
        number: dict[bytes, int] = {}
        symbols = np.array([number.setdefault(w, len(number) + 1) if w else 0 for t in texts for w in (*t, b"")], np.int64)
        count = np.array([len(t) - window + 1 for t in texts], np.int64)
        owned = np.flatnonzero(weight)
        found, offset = repeated_windows(symbols, len(number) + 1, np.cumsum(count + window) - count - window, count, weight[owned], window, gram)
        _, at, which = grouped(keys, content.view(np.uint64))
        marks = np.zeros(len(at), np.int64)
        np.bitwise_or.at(marks, which[owned[found]], np.int64(1) << offset)
        return answered_rows(group, marks[which][None], size)

    return run


def _by_block(docs: DataFrame, function, schema: str, *, window: int, gram: int, hot_spans: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """Apply `function` to the columns of each block of `docs` (named c0, c1, ..) and to the block's words that repeated windows cover."""
    gram = max(min(gram, window), window - MARKS + 1)
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    size = bytes_of(own, text)
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    rows = own.withColumn("block", block_of(doc_id, text, blocks))
    texts = rows.select("block", F.coalesce(text, F.lit("")).cast("binary").alias("text")).repartition("block")
    rounds: list[DataFrame] = []

    def settled(asked: DataFrame, answer) -> None:
        rounds.append(written(asked.groupBy("part").applyInArrow(answer, ANSWERED), "spans"))
        released()

    def told(by: DataFrame, function, schema: str) -> DataFrame:
        return by.groupBy("block").cogroup(functools.reduce(DataFrame.unionAll, rounds).groupBy("block")).applyInArrow(function, schema)

    def block_from(column: pa.ChunkedArray, answers: pa.Table | None = None) -> tuple[Block, dict[int, bytes]]:
        found = dict(zip(answers["part"].to_pylist(), answers["found"].to_pylist(), strict=True)) if answers is not None else {}
        block = Block(column.to_pylist(), buckets, window, gram)
        if answers is not None:
            block.take_keys(found)
        return block, found

    def ask_keys(group: pa.Table) -> pa.Table:
        return asked_rows(block_from(group["text"])[0].ask_keys(group["block"][0].as_py()))

    def ask_spans(group: pa.Table, answers: pa.Table) -> pa.Table:
        return asked_rows(block_from(group["text"], answers)[0].ask_spans(group["block"][0].as_py()))

    def ask_repeats(group: pa.Table, answers: pa.Table) -> pa.Table:
        block, found = block_from(group["text"], answers)
        block.take_spans(found)
        return asked_rows(block.ask_repeats(group["block"][0].as_py()))

    def apply(group: pa.Table, answers: pa.Table) -> pa.Table:
        column = group[text].cast(pa.binary()).fill_null(b"")
        block, found = block_from(column, answers)
        block.take_spans(found)
        return function(group, block, block.gone(found))

    settled(texts.groupBy("block").applyInArrow(ask_keys, ASKED), key_facts(hot_spans))
    settled(told(texts, ask_spans, ASKED), span_facts)
    settled(told(texts, ask_repeats, ASKED), searched(window, gram))
    return told(rows.repartition("block"), apply, schema)


def _options(window: int = WINDOW, gram: int = GRAM, hot_spans: int = HOT_SPANS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> dict:
    return {"window": window, "gram": gram, "hot_spans": hot_spans, "block_bytes": block_bytes, "bucket_bytes": bucket_bytes}


def duplicate_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row. Options: window, gram, hot_spans, block_bytes, bucket_bytes."""

    def run(group: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        n = np.bincount(block.owner, minlength=group.num_rows)
        removed = np.bincount(block.owner[gone], minlength=group.num_rows)
        ends, hashes = np.cumsum(n), []
        for i, text in enumerate(group["c1"].cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[ends[i] - n[i] : ends[i]].tolist(), strict=True) if not g]
            hashes.append(sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": group["c0"], "n_words": pa.array(n), "n_removed": pa.array(removed), "kept_sha256": pa.array(hashes, pa.string())})

    return _by_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string", **_options(**options))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs`, all rows and columns; repeated words are cut out of the text with the white space after them, and n_chars follows where there is such a column."""
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(group: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        n = np.bincount(block.owner, minlength=group.num_rows)
        ends, cut = np.cumsum(n), np.unique(block.owner[gone])
        columns = [group[f"c{i}"] for i in range(len(names))]
        texts = columns[at].to_pylist()
        for i in cut.tolist():
            places = [m.span() for m in WORDS.finditer(texts[i])]
            stops = [p[0] for p in places[1:]] + [len(texts[i])]
            texts[i] = texts[i][: places[0][0]] + "".join(texts[i][p[0] : stop] for p, stop, g in zip(places, stops, gone[ends[i] - n[i] : ends[i]].tolist(), strict=True) if not g)
        columns[at] = pa.array(texts, pa.string())
        if chars is not None:
            sizes, changed = columns[chars].to_pylist(), set(cut.tolist())
            columns[chars] = pa.array([len(texts[i]) if i in changed else x for i, x in enumerate(sizes)], columns[chars].type)
        return pa.Table.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    schema = docs.toDF(*(f"c{i}" for i in range(len(names)))).schema
    return _by_block(docs, run, schema, **_options(**options)).toDF(*names)


def op7_substring_dedup(spark, sf_dir):
    from terrella.llm.common import table

    return duplicate_words(table(spark, sf_dir, "documents"))
