"""Best-two-fit packing of token pieces into sequences of one length.

Only lengths matter to packing, so the packer works on the histogram of piece lengths: at most `length` numbers,
however many pieces there are. It fills a bin greedily with the longest pieces that fit, then takes its smallest
piece out and looks for two unpacked pieces that fill the widened gap more tightly. The pattern found is used as
often as the counts allow, so a run over the histogram takes a number of steps that follows the number of
different lengths, not the number of pieces. Pieces are then dealt to pattern places by their rank among pieces of
the same length. Ranks come from counts by (length, salt), so a length that a third of all pieces have is never
sorted in one task. Token ids never move between tasks.

The plan goes to all tasks. It has one row for each length of a pattern: of a length n at most 2 * length / n patterns are
made beyond those that use it up, and a pattern has at most sqrt(2 * length) different lengths, so that 2.3 million rows of 32 bytes bound it at
2,048 tokens whatever the input; on the test tables it has some thousands.

Cases: a null text counts as empty, so it is its end id alone; longer documents than a sequence are cut from the end
into whole sequences, the first piece takes the rest; repeated rows are packed independently; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrella.llm.common import batches, bits_for, text_of, written

#: Pieces that are ranked in one sort on average.
PIECES_PER_SORT = 16_384


@functools.cache
def byte_level_encoder(path: str):
    """An encoder of whole texts with the vocabulary and merges of a byte-level BPE file of the tokenizers library.

    The file's merges are in the order of their ids, which is checked, so ids serve as ranks for the faster library. Added tokens stand for themselves
    wherever a text spells them, as in that library.
    """
    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
    if any(x[flag] for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("only added tokens that match wherever they stand are supported")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the merges are not in the order of their ids")
    encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if any(x in text for x in special) else encoding.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit) of each document's pieces."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer)
        for batch in batches(rows, 4_000_000, "text"):
            out, ids_out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                n = len(ids)
                first = n if n <= length else n % length or length
                for i, stop in enumerate(range(first, n + 1, length)):
                    start = 0 if i == 0 else stop - length
                    part = ids[start:stop].tobytes()
                    out.append((doc, i, start, stop - start, zlib.crc32(part)))
                    if with_ids:
                        ids_out.append(part)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)] + [pa.array(ids_out, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def best_two_fit(counts: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths of a bin, how often) that use up `counts` (pieces by length)."""
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    largest = np.zeros(length + 1, np.int64)

    def index() -> None:
        np.maximum.accumulate(np.where(left > 0, np.arange(length + 1), 0), out=largest)

    index()
    patterns = []
    while largest[length]:
        taken, gap = [], length
        while n := int(largest[gap]):
            fit = min(int(left[n]), gap // n)
            taken += [n] * fit
            left[n] -= fit
            gap -= n * fit
            if not left[n]:
                index()
        smallest = taken[-1]
        room = gap + smallest
        if gap and len(taken) > 1 and (pair := _best_pair(left, largest, room)) and sum(pair) > smallest:
            taken[-1:] = pair
            left[smallest] += 1
            for n in pair:
                left[n] -= 1
        kinds, uses = np.unique(taken, return_counts=True)
        again = int((left[kinds] // uses).min())
        left[kinds] -= again * uses
        index()
        patterns.append((taken, 1 + again))
    return patterns


def _best_pair(left: np.ndarray, largest: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum of at most `room`."""
    a = np.flatnonzero(left[: room + 1])
    a = a[a > 0]
    if not len(a):
        return None
    b = largest[np.maximum(np.minimum(room - a, a), 0)]
    same = (b == a) & (left[a] < 2)
    b = np.where(same, largest[np.maximum(a - 1, 0)], b)
    total = np.where((b > 0) & (a + b <= room), a + b, 0)
    i = int(total.argmax())
    return [int(a[i]), int(b[i])] if total[i] else None


class Plan:
    """Sequence and offset of the pieces of each length by their rank."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        rows, used, sequence = [], {}, 0
        for lengths, copies in patterns:
            offset = 0
            for n, uses in sorted(Counter(lengths).items(), reverse=True):
                rows.append((n, used.get(n, 0), copies, sequence, offset))
                used[n] = used.get(n, 0) + uses * copies
                offset += n * uses
            sequence += copies
        self.length, self.first, self.copies, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.keys = (self.length << 44) + self.first

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1
        use, copy = np.divmod(rank - self.first[at], self.copies[at])
        return self.sequence[at] + copy, self.offset[at] + use * length


def pack(pieces: DataFrame, *, length: int = 2048, pieces_per_sort: int = PIECES_PER_SORT) -> DataFrame:
    """`pieces` (at least doc_id, piece, length, ids_crc32) with sequence_id and offset."""
    rows = pieces.count()
    salts = 1 << bits_for(rows, pieces_per_sort)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = written(counts, "pack-counts")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row per length

    plan = Plan(best_two_fit(histogram, length))
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(inner) - 1)
    names = pieces.columns

    def place(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            sequence, offset = plan.places(*(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer, length=length, end_id=end_id, with_ids=with_ids), "pack-pieces"), length=length)


def op6_best_two_fit(spark, sf_dir):
    import public_tokenizers

    from terrella.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
