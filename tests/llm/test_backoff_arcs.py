"""A block's automaton, whose arcs go by the block's own pairs and triples, held against one that looks them up."""

import numpy as np
import pyarrow as pa

from terrella.llm import ngrams


def test_block_is_read_without_looking_arcs_up(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(z)}" for z in rng.zipf(1.4, n)) for n in (0, 1, 2, 700, 3000, 40)] + ["same words again"] * 3 + ["", "w1 " * 500]
    block = ngrams.Block(pa.table({"text": texts, "held_out": [i == 3 for i in range(len(texts))]}), 3)
    block.c = block.counts()
    block.mine = [c > 0 for c in block.c]
    block.c.append(block.triples(2))
    block.mine.append(block.c[2] > 0)
    facts = [np.stack(block.arcs(order, 2)) for order in (0, 1)]
    total, cuts = int(block.c[0].sum()), (0.7, 0.8)
    automaton, number, arcs = ngrams.automaton_of(block, facts, 2, total, 0.5, cuts)
    words, rare = number[block.token], np.full(len(block.token), -4.0)

    base = int(number.max()) + 1
    counts = np.zeros(base, np.int64)
    counts[number] = np.where(number > 0, block.c[0], 0)
    code = number[block.a] * base + number[block.b]
    pairs = {int(code[i]): int(c) for i, c in enumerate(block.c[1]) if c >= 2}
    triples = {int(code[block.history[i]] * base + number[block.w[i]]): int(c) for i, c in enumerate(block.c[2]) if c >= 2}
    assert len(pairs) > 50 and len(triples) > 50
    plain = ngrams.Automaton(counts, pairs, triples, total, 0.5, cuts, base, int(number[block.end]))
    state, want = 0, []
    for w, f in zip(words.tolist(), block.first.tolist(), strict=True):
        state = plain.start if f else state
        if w:
            x, y = plain.step(np.array([state]), np.array([w]))
            want.append(float(x[0]))
            state = int(y[0])
        else:
            want.append(float(plain.fall[state]) - 4.0)
            state = 0
    np.testing.assert_allclose(plain.read(words, block.first, rare), want, rtol=1e-9)

    def forbidden(*_):
        raise AssertionError("looked up")

    monkeypatch.setattr(ngrams.Automaton, "find", forbidden)
    monkeypatch.setattr(ngrams.Automaton, "step", forbidden)
    np.testing.assert_allclose(automaton.read(words, block.first, rare, arcs), want, rtol=1e-9)
