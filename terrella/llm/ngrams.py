"""Language-model scoring with a weighted backoff automaton.

Tokens are words and one end per text. Words have absolutely discounted frequencies over the whole training vocabulary;
what the discount frees goes to unseen words, whose number is estimated from the words seen once and twice. Pairs and
triples seen twice or more in training become states and arcs of an automaton, at every size of the input; each order's discount
comes from how many of its grams were seen once and twice, counted before any is left out (of triples, those of two kept pairs). The
probability that a history's arcs leave over goes down a failure arc to the next shorter history, normalised by what that history
gives to the words left. A text's score is the sum of the log10 probabilities along its path; the state after a token follows from its last two words.

No part of the model is collected or broadcast: it grows with the input and stays dealt out. Texts are grouped into blocks of
bounded size. A block sends its distinct words and pairs, and then the triples made of two kept pairs, with their training counts to buckets of their hashes, and each
bucket sends back the sums, in the order it was asked, and names for each key one asking block its owner. A history's totals over
all its arcs come the same way from the owners of the arcs. With both a block builds the part of the automaton that its own texts
can reach, with the scores and weights of the whole, and reads its texts.

Words, pairs and triples are known by 64-bit hashes (two of one hash would share a count). A key has one row in a block however often it occurs, so that no bucket grows
with a common word or pair.

Cases: a null text counts as empty and is its end alone; a null doc_id is a training row; words never seen in training have
count 0; repeated rows each count and each give a row; without training rows N and V are 0, the base score is log10 of 0.5 / 0.5 per token, and the
model spreads its mass over one unseen word; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.blocks import ASKED, BLOCK_BYTES, BUCKET_BYTES, Dealt, asked_of, asked_table, block_of, bytes_of, released, shared_out
from terrella.llm.common import batches, text_of, written
from terrella.llm.wordhash import mixed, text_words

#: Stands for the end among word hashes.
END = np.uint64(1)
#: Least occurrences of a kept pair or triple. Words, pairs and triples: the rounds in which sums are asked for; then histories of one and two words.
LEAST, WORDS, PAIRS, TRIPLES, HISTORIES = 2, 0, 1, 2, 3
#: What is taken from a kept pair or triple where none was seen once or none twice.
CUT = 0.75


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text followed by its end, and the text each is of."""
    hashes, owner = text_words([t.encode().lower() for t in texts])  # bytes.lower changes A-Z only
    out = np.full(len(hashes) + len(texts), END, np.uint64)
    out[np.arange(len(hashes)) + owner] = hashes
    return out, np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)) + 1)


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15) + b)


def discount_of(ones: int, twos: int, otherwise: float = CUT) -> float:
    """What absolute discounting takes from each count, by how many grams were seen once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else otherwise


ANSWERED = "block long, part long, found binary, total long, kinds long, ones long, twos long"


def add_up(group: pa.Table) -> pa.Table:
    """Each block's keys with the sums over all blocks; counts are doubled, and odd where the block is the key's owner. Facts of the first sums on the first row."""
    keys, values, size = asked_of(group)
    order = np.argsort(keys)
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(values[:, order], at, axis=1)
    back = np.empty_like(values)
    back[:, order] = sums[:, np.cumsum(new) - 1]
    first = sums[0]
    facts = [int(first.sum()), int((first > 0).sum()), int((first == 1).sum()), int((first == 2).sum())]
    if len(values) == 1:
        back *= 2
        back[:, order[at]] += 1
    return pa.table({"block": group["block"], "part": group["part"], "found": shared_out(back, size)} | {n: pa.array([x] + [0] * (len(size) - 1), pa.int64()) for n, x in zip(("total", "kinds", "ones", "twos"), facts, strict=True)})


class Block:
    """The tokens of a block's texts as places among its distinct words, and its distinct pairs and triples."""

    def __init__(self, group: pa.Table, buckets: int):
        held, owners, n = [], [], 0
        for chunk in batches(iter(group.select(["text"]).to_batches()), 4_000_000, "text"):
            token, owner = tokens(text_of(chunk.column(0)))
            held.append(token)
            owners.append(owner + n)
            n += chunk.num_rows
        owner = np.concatenate(owners)
        self.words, self.token = np.unique(np.concatenate(held), return_inverse=True)
        kinds = len(self.words)
        self.end = int(np.searchsorted(self.words, END))
        self.first = np.concatenate([[True], owner[1:] != owner[:-1]])
        self.training = ~group["held_out"].to_numpy(zero_copy_only=False)[owner]
        before = np.concatenate([[self.end], self.token[:-1]])
        before[self.first] = self.end
        # A text begins in the state of an end, so what is before an end never counts.
        pairs, self.pair = np.unique(before * kinds + self.token, return_inverse=True)
        self.a, self.b = pairs // kinds, pairs % kinds
        self.buckets = buckets
        self.keys = [mixed(self.words), pair_keys(self.words[self.a], self.words[self.b])]
        self.dealt = [Dealt(k, buckets) for k in self.keys]
        self.c, self.mine = [], []

    def counts(self) -> list[np.ndarray]:
        """Training counts of the block's words and pairs."""
        return [np.bincount(x[self.training], minlength=len(k)) for x, k in zip((self.token, self.pair), self.keys, strict=True)]

    def take(self, answers: dict[int, bytes], round_: int) -> None:
        """Counts over all texts (c) and which keys this block is the owner of (mine)."""
        found = self.dealt[round_].answered(answers, round_, 1)[0]
        self.c.append(found >> 1)
        self.mine.append((found & 1) > 0)

    def triples(self, least: int) -> np.ndarray:
        """Find the triples whose two pairs are kept, as those of every kept triple are; gives their training counts."""
        kept = self.c[PAIRS][self.pair] >= least
        at = np.flatnonzero(~self.first[1:] & kept[1:] & kept[:-1]) + 1
        triples, which = np.unique(self.pair[at - 1] * len(self.words) + self.token[at], return_inverse=True)
        self.history, self.w = triples // len(self.words), triples % len(self.words)
        #: The triple that ends at each token; -1: none.
        self.triple = np.full(len(self.token), -1)
        self.triple[at] = which
        #: The pair that ends each triple.
        self.shorter = np.zeros(len(triples), np.int64)
        self.shorter[which] = self.pair[at]
        self.keys.append(pair_keys(self.keys[PAIRS][self.history], self.words[self.w]))
        self.dealt.append(Dealt(self.keys[TRIPLES], self.buckets))
        return np.bincount(which[self.training[at]], minlength=len(triples))

    def histories(self, order: int, least: int) -> tuple[np.ndarray, Dealt]:
        """Places of the words (0) or pairs (1) that may be histories, and their keys dealt out."""
        at = np.flatnonzero(self.c[order] >= least)
        return at, Dealt(self.keys[order][at], self.buckets)

    def arcs(self, order: int, least: int) -> list[np.ndarray]:
        """Of each word (0) or pair (1): number, counts and shorter counts of the kept arcs out of it that this block owns."""
        history, lower = (self.a, self.c[WORDS][self.b]) if order == WORDS else (self.history, self.c[PAIRS][self.shorter])
        own = self.mine[order + 1] & (self.c[order + 1] >= least)
        facts = [np.zeros(len(self.c[order]), np.int64) for _ in range(3)]
        for f, x in zip(facts, (own.astype(np.int64), self.c[order + 1], lower), strict=True):
            np.add.at(f, history[own], x[own])
        return facts


class Automaton:
    """States are histories of one or two frequent words that have arcs; state 0 is the empty history.

    words: counts of the frequent words by number (1 ..); pairs, triples: counts by code.
    """

    def __init__(self, words: np.ndarray, pairs: dict[int, int], triples: dict[int, int], total: int, discount: float, cuts: tuple[float, float], base: int, end: int):
        self.base = base
        self.unigram = np.concatenate([[0.0], (words[1:] - discount) / max(total, 1)])
        cut, cut3 = cuts
        self.state = {0: 0}
        for code in pairs:
            self.state.setdefault(code // base, len(self.state))
        #: Histories of two words are numbered after those of one; their code is shifted so that both fit one table.
        for code in triples:
            self.state.setdefault(base * base + code // base, len(self.state))
        n = len(self.state)
        self.fail, self.weight = [0] * n, [0.0] * n
        self.arcs: dict[int, tuple[float, int]] = {}
        for w in range(1, len(words)):
            self.arcs[w] = (math.log10(self.unigram[w]), self.state.get(w, 0))
        low: dict[int, tuple[float, float]] = {}
        pair_p: dict[int, float] = {}
        for code, c in pairs.items():
            h, w = divmod(code, base)
            p = (c - cut) / words[h]
            pair_p[code] = p
            a, b = low.get(h, (0.0, 0.0))
            low[h] = (a + p, b + self.unigram[w])
        for h, (a, b) in low.items():
            s = self.state[h]
            self.weight[s] = math.log10(max(1 - a, 1e-12) / max(1 - b, 1e-12))
        for code, p in pair_p.items():
            h, w = divmod(code, base)
            self.arcs[self.state[h] * base + w] = (math.log10(p), self.state.get(base * base + code, self.state.get(w, 0)))
        low = {}
        for code, c in triples.items():
            h, w = divmod(code, base)
            shorter = (h % base) * base + w
            p = (c - cut3) / pairs[h]
            q = pair_p.get(shorter)
            if q is None:
                q = 10 ** self.weight[self.state[h % base]] * self.unigram[w] if h % base in self.state else self.unigram[w]
            a, b = low.get(h, (0.0, 0.0))
            low[h] = (a + p, b + q)
            self.arcs[self.state[base * base + h] * base + w] = (math.log10(p), self.state.get(base * base + shorter, self.state.get(w, 0)))
        for h, (a, b) in low.items():
            s = self.state[base * base + h]
            self.fail[s] = self.state.get(h % base, 0)
            self.weight[s] = math.log10(max(1 - a, 1e-12) / max(1 - b, 1e-12))
        self.start = self.state.get(end, 0)
        #: What a word without arcs costs in each state, on the way to the empty history.
        self.fall = [0.0] * n
        for s in range(1, n):
            self.fall[s] = self.weight[s] + (self.weight[self.fail[s]] if self.fail[s] else 0.0)

        keys = np.array(sorted(k for k in self.arcs if k >= base), np.int64)
        self.keys = keys
        self.arc_score = np.array([self.arcs[k][0] for k in keys.tolist()], float)
        self.arc_next = np.array([self.arcs[k][1] for k in keys.tolist()], np.int64)
        self.root_score = np.array([0.0, *(self.arcs[w][0] for w in range(1, base))])
        self.root_next = np.array([0, *(self.arcs[w][1] for w in range(1, base))], np.int64)
        self.fail, self.weight, self.fall = np.array(self.fail), np.array(self.weight), np.array(self.fall)

    def find(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of the arc of each word (0: not frequent) out of each state, -1 where there is none or the state is the empty history."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state * self.base + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((state > 0) & (word > 0) & (self.keys[at] == key), at, -1)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and next state of reading a frequent word in each state: down failure arcs until one has an arc for it."""
        score, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        now = state
        while len(left):
            w, at = word[left], self.find(now, word[left])
            at_root, hit = now == 0, at >= 0
            score[left[at_root]] += self.root_score[w[at_root]]
            after[left[at_root]] = self.root_next[w[at_root]]
            score[left[hit]] += self.arc_score[at[hit]]
            after[left[hit]] = self.arc_next[at[hit]]
            miss = ~at_root & ~hit
            score[left[miss]] += self.weight[now[miss]]
            left, now = left[miss], self.fail[now[miss]]
        return score, after

    def read(self, words: np.ndarray, first: np.ndarray, rare: np.ndarray, arcs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The score of each token. words: numbers, 0 where not frequent; first: where texts begin; rare: scores of the others.

        arcs: numbers of the arcs of each token's pair and triple, -1 where there is none; they are looked up if not given. The state after a
        token is where its pair's arc leads, or else the root's, whatever was read before: arcs of longer histories lead to the same
        state. So the states of all tokens are known at once, and each goes down its failure arcs by itself.
        """
        one = np.concatenate([[0], self.root_next[words[:-1]]])
        one[first] = self.start
        pair = self.find(one, words) if arcs is None else arcs[0]
        after, hit = self.root_next[words], np.flatnonzero(pair >= 0)
        after[hit] = self.arc_next[pair[hit]]
        state = np.concatenate([[0], after[:-1]])
        state[first] = self.start
        long = state != one
        triple = self.find(state, words) if arcs is None else arcs[1]
        out = np.where(words > 0, self.root_score[words], rare) + np.where(long, self.weight[state] + self.weight[one], self.weight[one])
        out[hit] = np.where(long[hit], self.weight[state[hit]], 0.0) + self.arc_score[pair[hit]]
        hit = np.flatnonzero(long & (triple >= 0))
        out[hit] = self.arc_score[triple[hit]]
        return out


def automaton_of(block: Block, facts: list[np.ndarray], least: int, total: int, discount: float, cuts: tuple[float, float]) -> tuple[Automaton, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The part of the automaton that a block's texts can reach, the numbers of the block's words, and the arcs of its tokens' pairs and triples.

    facts: of the block's words and pairs as histories, rows of number, counts and shorter counts of all their arcs.
    """
    (words, pairs, triples), self = block.c, Automaton.__new__(Automaton)
    frequent, kept, kept3 = (np.flatnonzero(c >= least) for c in block.c)
    number = np.zeros(len(words), np.int64)
    number[frequent] = np.arange(1, len(frequent) + 1)
    self.base = len(frequent) + 1
    one, two = (np.where(f[0] > 0, np.cumsum(f[0] > 0), 0) for f in facts)
    ones = int((one > 0).sum())
    two[two > 0] += ones
    n = 1 + ones + int((two > 0).sum())
    self.fail, self.weight = np.zeros(n, np.int64), np.zeros(n)
    for state, f, of, cut, taken, lower in ((one, facts[0], words, cuts[0], discount, total), (two, facts[1], pairs, cuts[1], cuts[0], words[block.b])):
        at = np.flatnonzero(state)
        high = (f[1, at] - cut * f[0, at]) / of[at]
        low = (f[2, at] - taken * f[0, at]) / (lower if np.isscalar(lower) else lower[at])
        self.weight[state[at]] = np.log10(np.maximum(1 - high, 1e-12) / np.maximum(1 - low, 1e-12))
    self.fail[two[two > 0]] = one[block.b[two > 0]]
    after = np.where(two > 0, two, one[block.b])
    # Arcs of kept pairs, then of kept triples. A block knows them by its pairs and triples, so nothing is looked up by key.
    self.keys = np.array([], np.int64)
    self.arc_score = np.concatenate([np.log10((pairs[kept] - cuts[0]) / words[block.a[kept]]), np.log10((triples[kept3] - cuts[1]) / pairs[block.history[kept3]])])
    self.arc_next = np.concatenate([after[kept], after[block.shorter[kept3]]])
    pair, triple = np.full(len(pairs), -1), np.full(len(triples) + 1, -1)
    pair[kept], triple[kept3] = np.arange(len(kept)), len(kept) + np.arange(len(kept3))
    self.root_score = np.concatenate([[0.0], np.log10((words[frequent] - discount) / max(total, 1))])
    self.root_next = np.concatenate([[0], one[frequent]])
    self.start = int(one[block.end])
    return self, number, (pair[block.pair], triple[block.triple])


def score_texts(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rest = F.coalesce(remainder("doc_id"), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = bytes_of(own, "text")
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    blocked = own.withColumn("block", block_of("doc_id", "text", blocks)).repartition("block")

    rounds: list[DataFrame] = []

    def settled(asked: DataFrame) -> DataFrame:
        """Write the sums of what blocks ask."""
        out = written(asked.groupBy("part").applyInArrow(add_up, ANSWERED), "grams")
        released()
        rounds.append(out.select("block", "part", "found"))
        return out

    def told(function, schema: str) -> DataFrame:
        """Apply the function to each block with all answers so far."""
        answers = functools.reduce(DataFrame.unionAll, rounds)
        return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)

    def ask_grams(group: pa.Table) -> pa.Table:
        block, key = Block(group, buckets), group["block"][0].as_py()
        return asked_table([row for i, (d, c) in enumerate(zip(block.dealt, block.counts(), strict=True)) for row in d.asked(key, i, c)])

    def summed(answers: DataFrame, round_: int) -> list[int]:
        """All occurrences, different keys, and keys seen once and twice of one round."""
        of = answers.filter((F.col("part") >= round_ * buckets) & (F.col("part") < (round_ + 1) * buckets))
        return [int(x) for x in of.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "kinds", "ones", "twos"))).first()]

    grams = settled(blocked.groupBy("block").applyInArrow(ask_grams, ASKED))
    total, kinds, ones, twos = summed(grams, WORDS)
    discount, cut = discount_of(ones, twos, 0.5), discount_of(*summed(grams, PAIRS)[2:])
    unseen = max(1.0, ones * ones / (2 * max(twos, 1)))
    new = math.log10(discount * kinds / total / unseen) if total else 0.0
    least = LEAST

    def read(group: pa.Table, answers: pa.Table) -> tuple[Block, dict[int, bytes], np.ndarray]:
        found = dict(zip(answers["part"].to_pylist(), answers["found"].to_pylist(), strict=True))
        block = Block(group, buckets)
        block.take(found, WORDS)
        block.take(found, PAIRS)
        return block, found, block.triples(least)

    def histories(block: Block, key: int, order: int) -> list[tuple[int, int, bytes, bytes]]:
        at, dealt = block.histories(order, least)
        return dealt.asked(key, HISTORIES + order, *(x[at] for x in block.arcs(order, least)))

    def ask_triples(group: pa.Table, answers: pa.Table) -> pa.Table:
        block, _, counts = read(group, answers)
        key = group["block"][0].as_py()
        return asked_table(block.dealt[TRIPLES].asked(key, TRIPLES, counts) + histories(block, key, WORDS))

    def ask_histories(group: pa.Table, answers: pa.Table) -> pa.Table:
        block, found, _ = read(group, answers)
        block.take(found, TRIPLES)
        return asked_table(histories(block, group["block"][0].as_py(), PAIRS))

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        block, found, _ = read(group, answers)
        block.take(found, TRIPLES)
        facts = [np.zeros((3, len(c)), np.int64) for c in block.c[:TRIPLES]]
        for order in (WORDS, PAIRS):
            at, dealt = block.histories(order, least)
            facts[order][:, at] = dealt.answered(found, HISTORIES + order, 3)
        automaton, number, arcs = automaton_of(block, facts, least, total, discount, cuts)
        count = block.c[WORDS][block.token]
        rare = np.where(count > 0, np.log10(np.maximum(count - discount, 1e-300) / max(total, 1)), new)
        plain = np.log10((count + 0.5) / (total + 0.5 * (kinds + 1)))
        at = np.flatnonzero(block.first)
        model = automaton.read(number[block.token], block.first, rare, arcs)
        return pa.table({"doc_id": group["doc_id"], "held_out": group["held_out"], "n_tokens": pa.array(np.diff(np.append(at, len(count)))), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(at), total, np.int64)), "base_score": pa.array(np.add.reduceat(plain, at)), "score": pa.array(np.add.reduceat(model, at))})

    cuts = cut, discount_of(*summed(settled(told(ask_triples, ASKED)), TRIPLES)[2:])
    settled(told(ask_histories, ASKED))
    return told(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_backoff_automaton(spark, sf_dir):
    from terrella.llm.common import table

    return score_texts(table(spark, sf_dir, "documents"))
