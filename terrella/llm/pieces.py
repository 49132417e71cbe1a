"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies, without training.

A model file is read directly (its protobuf holds pieces, scores and kinds). A text becomes a run of symbols, one per
character; an agenda holds each adjacent pair whose join is a piece, ordered by score and then by place; the best
pair merges and its new neighbours enter the agenda until none is left. Characters outside the vocabulary fall back
to byte pieces.

Merges cannot cross a place where no piece spans it: before a run of the space mark (no piece holds the mark after
another character) and around a line feed (no piece holds it). Both facts are checked against the vocabulary when it
is loaded. So texts are cut there, each distinct chunk is merged once per worker and kept in a table of bounded size,
and every newly merged chunk of an Arrow batch is compared with the sentencepiece library in one call, the decoded whole
texts of the batch in another; a difference raises.

Cases: null and empty texts give just the begin and end ids and decode to the empty text; texts of any length are
encoded whole (long chunks use a heap); repeated rows each give a row; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from terrella.llm.common import batches, text_of

MARK = "▁"
#: Kinds of piece in the model file. Fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks kept per worker; the table is emptied when full, which costs time and no result.
CHUNKS_KEPT = 1_200_000
#: Symbols up to which the agenda is a plain list scanned for its best entry; longer chunks use a heap.
SHORT = 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces of a merge-type model file, with encoding of chunks and decoding of ids."""

    def __init__(self, path: str):
        self.path = path
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1):
            raise ValueError("only the identity normaliser that adds a space in front and keeps the others is supported")
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the merge type")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(pieces)
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.rank = {p: -score for p, score, kind in pieces if kind == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        names = {p: i for i, (p, _, _) in enumerate(pieces)}
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.begin, self.end = names["<s>"], names["</s>"]
        self.cut_at_mark = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.cut_at_line = self.cut_at_mark and not any("\n" in p for p in self.id_of)
        pairs = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        #: Marks that no piece holds right after a letter: nothing merges across such a place.
        self.tails = "".join(q for q in ".,;:!?" if not any(x[1] == q and x[0].isalpha() for x in pairs))
        self.out = [p.replace(MARK, " ").encode() if kind == NORMAL else bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() for p, _, kind in pieces]

    # Encoding

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge until no adjacent pair is a piece: the best score first, the leftmost of equals."""
        return self._by_scan(symbols) if len(symbols) <= SHORT else self._by_heap(symbols)

    def _by_scan(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank.get, float("inf")
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)
        return symbols

    def _by_heap(self, symbols: list[str]) -> list[str]:
        n, rank = len(symbols), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (joined := symbols[i] + symbols[j]) in rank:
                agenda.append((rank[joined], i, j, joined)) if not started else heapq.heappush(agenda, (rank[joined], i, j, joined))

        started = False
        for i in range(n - 1):
            enter(i, i + 1)
        heapq.heapify(agenda)
        started = True
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if right[i] != j or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            enter(left[i], i)
            enter(i, right[i])
        return [s for s in symbols if s]

    def ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.id_of.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one key of `chunks`: a leading line feed stands for itself, anything else follows a space."""
        body = chunk.replace(" ", MARK)
        return self.ids(self.merged(list(body if chunk[:1] == "\n" and self.cut_at_line else MARK + body)))

    def chunks(self, text: str) -> list[str]:
        """Keys of the parts of a text between which nothing merges."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.cut_at_mark:
            return [text]
        if text[:1] == " " or "  " in text:
            return [c if c[0] == "\n" else c[1:] for c in (_PARTS if self.cut_at_line else _WORDS).findall(" " + text)]
        return (text.replace("\n", " \n") if self.cut_at_line else text).split(" ")

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, the space before the first piece goes, ill-formed bytes become U+FFFD each."""
        data = b"".join(map(self.out.__getitem__, ids))
        first = next((i for i in ids if self.out[i]), None)
        if first is not None and data[:1] == b" " and first not in self.byte_id.values():
            data = data[1:]
        return data.decode("utf-8", "terrella-each")


_PARTS = re.compile(r"\n[^ \n]*| +[^ \n]*")
_WORDS = re.compile(r" +[^ ]*")


def _each(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("terrella-each", _each)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class ChunkTable(dict):
    """Packed ids by chunk, of bounded size."""

    def __init__(self, vocabulary: Vocabulary, library=None, kept: int = CHUNKS_KEPT):
        super().__init__()
        self.vocabulary, self.library, self.kept = vocabulary, library, kept
        self.line = vocabulary.encode_chunk("")
        self.tail: dict[str, list[int]] = {}

    def _encoded(self, chunk: str) -> list[int]:
        """Ids of a chunk; of one that is a known word and a few marks, without merging the word again."""
        v = self.vocabulary
        word = chunk.rstrip(v.tails)
        if word is chunk or len(word) == len(chunk) or not word[-1:].isalpha() or word not in self:
            return v.encode_chunk(chunk)
        marks = chunk[len(word) :]
        if marks not in self.tail:
            if len(self.tail) > self.kept:
                self.tail.clear()
            self.tail[marks] = v.ids(v.merged(list(marks)))
        return [*struct.unpack(f"<{len(self[word]) // 4}I", self[word]), *self.tail[marks]]

    def learn(self, chunks: set[str]) -> None:
        """Merge the chunks that are not known yet and hold them against the library."""
        v = self.vocabulary
        if len(self) > self.kept:
            self.clear()
        new = [c for c in chunks if c not in self]
        found = [self._encoded(c) for c in new]
        if self.library is not None and new:
            for c, mine, theirs in zip(new, found, self.library.encode(new, num_threads=1), strict=True):
                if theirs != (self.line + mine if c[:1] == "\n" and v.cut_at_line else mine) and c:
                    raise AssertionError(f"the library encodes {c[:80]!r} otherwise")
        for c, ids in zip(new, found, strict=True):
            self[c] = struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def chunk_table(model: str, check: bool) -> ChunkTable:
    """The worker's table, kept between tasks. (A global used inside a task's own function would be copied anew for each.)"""
    library = None
    if check:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
    return ChunkTable(vocabulary(model), library)


def encode(docs: DataFrame, model: str, *, check: bool = True, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian 32-bit) and decoded text."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, kept = vocabulary(model), chunk_table(model, check)
        begin, end = struct.pack("<I", v.begin), struct.pack("<I", v.end)
        for batch in batches(rows, 4_000_000, "text"):
            texts = text_of(batch.column(1))
            parts = [v.chunks(t) for t in texts]
            kept.learn(set().union(*parts))
            n, hashes, ids_out, texts_out, whole = [], [], [], [], []
            for chunks in parts:
                packed = begin + b"".join(map(kept.__getitem__, chunks)) + end
                ids = memoryview(packed).cast("I").tolist()
                n.append(len(ids))
                hashes.append(sha256(packed).hexdigest())
                texts_out.append(v.decode(ids))
                if check:
                    whole.append(ids)
                if with_ids:
                    ids_out.append(packed)
            if check and whole and kept.library.decode(whole, num_threads=1) != texts_out:
                raise AssertionError("the library decodes a text otherwise")
            decoded = [sha256(text.encode()).hexdigest() for text in texts_out]
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.binary()))
                names.append("ids")
            if with_text:
                columns.append(pa.array(texts_out, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from terrella.llm.common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, with_text=False)
