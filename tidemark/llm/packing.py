"""Sum-of-squares packing of tokenised documents into sequences of one length.

A document becomes pieces of at most ``limit`` tokens. Pieces are dealt at
random into groups of bounded size; inside a group each piece, longest first,
goes where the sum over all gap sizes of (open sequences with that gap) squared
grows least. Sequences that stay less full than asked are dissolved and their
pieces meet those of other groups in the next round, so the loss of cutting
the work into groups shrinks from round to round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm.words import encoder, plain_array, text_slices
from tidemark.session import stage

LIMIT = 4096
GROUP_ROWS = 16_384
#: A sequence with a gap of more than this share of its length is packed again with other groups' leftovers.
LOOSE = 1 / 256
#: Rounds over leftovers; a last group keeps what it has.
ROUNDS = 6

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill per sequence) of items of 1..limit tokens, placed in the order given.

    Ties go to the sequence with the smallest gap, a new one last; equal gaps to the one opened or
    filled last. Closed sequences (gap 0) do not count in the sum.
    """
    open_ = np.zeros(limit + 1, np.int64)
    with_gap: dict[int, list[int]] = {}
    fill: list[int] = []
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    unusable = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        now = open_[size:]
        change = np.where(now > 0, 2 * (open_[: limit - size + 1] - now) + 2, unusable)
        if now[0]:
            change[0] = 1 - 2 * now[0]
        best = int(change.argmin())
        fresh = 1 + 2 * int(open_[limit - size]) if size < limit else 0
        if change[best] <= fresh:
            gap = best + size
            seq = with_gap[gap].pop()
            open_[gap] -= 1
        else:
            gap, seq = limit, len(fill)
            fill.append(0)
        where[i], offset[i] = seq, fill[seq]
        fill[seq] += size
        if gap > size:
            open_[gap - size] += 1
            with_gap.setdefault(gap - size, []).append(seq)
    return where, offset, np.array(fill, np.int64)


def pieces_of(docs: DataFrame, vocabulary: str, *, limit: int = LIMIT, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids, then ``end_id``, cut every ``limit`` tokens.

    Reads ``doc_id`` and ``text`` alone, so further columns cannot clash. A null text is an empty
    one and gives one piece with the end id; a null doc_id stays null; repeated rows give pieces of
    their own. ``uid`` names a row of the input and its piece; ``with_ids`` adds the ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, serial = encoder(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                keys, texts = batch.column("doc_id").slice(a, b - a), plain_array(batch.column("text").slice(a, b - a))
                starts, ids = enc.encode(texts)
                owner, piece, begin, size, crc, parts = [], [], [], [], [], []
                for i in range(b - a):
                    whole = np.append(ids[starts[i] : starts[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), limit)):
                        part = whole[at : at + limit]
                        owner.append(i)
                        piece.append(k)
                        begin.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                n = len(owner)
                columns = [pa.array(range(serial, serial + n), pa.int64()), keys.take(pa.array(owner, pa.int32())),
                           pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                serial += n
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, *, limit: int = LIMIT, group_rows: int = GROUP_ROWS, loose: float = LOOSE, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``uid`` (unique) and ``length`` (1..limit).

    ``pieces`` is read more than once: hand in a stored table. No piece is split, dropped or moved to
    the driver. An empty table gives an empty one. Other columns named sequence_id, offset or
    beginning with ``_pack`` are replaced.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("_pack")]
    left, done = pieces.select(columns), []
    schema = left.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "_pack_loose": F.lit(True)}).schema
    before = None
    for turn in range(rounds):
        n = left.count()
        groups = max(1, math.ceil(n / group_rows))
        last = groups == 1 or turn == rounds - 1 or (before is not None and n > 0.8 * before)

        dealt = left.withColumn("_pack_group", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).cast("long"))
        packed = dealt.groupBy("_pack_group").applyInArrow(_placing(turn, last, limit, loose), schema)
        if last:
            done.append(packed.drop("_pack_loose"))
            break
        packed = stage(packed, "packed")
        done.append(packed.where(~F.col("_pack_loose")).drop("_pack_loose"))
        left, before = packed.where("_pack_loose").select(columns), n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _placing(turn: int, last: bool, limit: int, loose: float):
    def place(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "descending"), ("uid", "ascending")]))
        key = group.column("_pack_group")[0].as_py()
        where, offset, fill = sum_of_squares(group.column("length").to_numpy(), limit)
        open_ = (fill < limit * (1 - loose))[where] & (not last)
        kept = group.drop_columns(["_pack_group"])
        for name, values in (("sequence_id", (turn << 58) + (key << 24) + where), ("offset", offset), ("_pack_loose", open_)):
            kept = kept.append_column(name, pa.array(values))
        return kept

    return place


def pack_documents(docs: DataFrame, vocabulary: str, *, limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(pieces_of(docs, vocabulary, limit=limit, end_id=end_id), "pieces")
    return pack(pieces, limit=limit).drop("uid")
