"""Vector bin packing of examples into sequences, by the dot-product heuristic.

Each example takes tokens, one segment and some loss-bearing tokens; a sequence has a limit on each.
Items are placed one at a time where the dot product of what they need and what the open sequence has
left (both as shares of the limits) is largest; when none fits, the largest is cut to fill the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import text_slices

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 128
#: Remainders that are packed together; a task carries what is left over to its next batch.
BATCH_ITEMS = 1024


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], last: bool, cut: bool = True, least_piece: int = 1):
    """Place items (tokens, loss-bearing tokens; every item within the limits) into sequences.

    Returns a list of sequences, each a list of (item, start, length), and the items left as
    {item: start}: those of the last sequence, if it is not full and last is false. An item that is
    cut keeps its loss-bearing tokens evenly spread, rounded up. Ties go to the item given first.
    """
    cap = np.array(limits, dtype=float)
    need = np.stack([tokens, np.ones(len(tokens)), loss], axis=1).astype(float)
    start = np.zeros(len(tokens), dtype=np.int64)
    waiting = need[:, 0] > 0
    share = need / cap
    out = []
    while waiting.any():
        left, seq = cap.copy(), []
        while True:
            fits = waiting & (need <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, share @ (left / cap), -1.0)))
                seq.append((i, int(start[i]), int(need[i, 0])))
                left -= need[i]
                waiting[i] = False
                continue
            if not cut or left[0] < least_piece or left[1] < 1 or left[2] < 1 or not waiting.any():
                break
            i = int(np.argmax(np.where(waiting, need[:, 0], -1.0)))
            size = int(min(left[0], need[i, 0]))
            if need[i, 2]:
                size = min(size, int(need[i, 0] * left[2] // need[i, 2]))
            if size < least_piece:
                break
            used = min(np.ceil(need[i, 2] * size / need[i, 0]), left[2])
            seq.append((i, int(start[i]), size))
            left -= [size, 1, used]
            start[i] += size
            need[i, 0] -= size
            need[i, 2] = max(0.0, need[i, 2] - used)
            share[i] = need[i] / cap
            waiting[i] = need[i, 0] > 0
        out.append(seq)
        if not last and not waiting.any() and left[0] > 0:
            out.pop()
            keep: dict[int, int] = {}
            for i, s, _ in seq:
                keep[i] = min(s, keep.get(i, s))
            return out, keep
    return out, {}


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise every text (tokenizer: a byte-level BPE file of under 2 MB, broadcast), append end_id, pack.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids
    ids array<int>. Whole runs of limit tokens are sequences of their own; what remains of every
    document is packed under the limits on tokens, segments and loss-bearing tokens (all but end_id).
    Each task packs its own rows: no shuffle, no key can be hot, and sequences carry the task's number.
    Null and empty texts are one piece of end_id; repeated rows are packed each; an empty table gives
    no rows; other columns are ignored.
    """
    with open(tokenizer, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = ("json" if tokenizer.endswith(".json") else "tiktoken") + "-library"
    limits = (limit, max_segments, max_loss or limit)
    whole = limit if limits[2] >= limit else limits[2]

    def run(batches):
        enc = encoder(kind, data.value)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        left: list[tuple] = []  # (id, start, ids, tokens of the document)

        def sequence(pieces):
            nonlocal number
            at = 0
            for i, start, ids, total in pieces:
                row = (i, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                at += len(ids)
            number += 1

        def pack(last):
            nonlocal left
            if not left:
                return
            tokens = np.array([len(x[2]) for x in left])
            ends = np.array([x[1] + len(x[2]) == x[3] for x in left])
            done, keep = place(tokens, tokens - ends, limits, last)
            cut = lambda k, s, n: (left[k][0], left[k][1] + s, left[k][2][s : s + n], left[k][3])
            for seq in done:
                sequence([cut(*x) for x in seq])
            left = [cut(k, s, len(left[k][2]) - s) for k, s in keep.items()]

        def frame():
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            out["_id"] = out["_id"].astype("Int64")
            rows.clear()
            return out

        for pdf in batches:
            for at, texts in text_slices(pdf["_id"], pdf["_text"]):
                for i, ids in zip(at, enc.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    full = len(ids) // whole * whole
                    for s in range(0, full, whole):
                        sequence([(i, s, ids[s : s + whole], len(ids))])
                    if full < len(ids):
                        left.append((i, full, ids[full:], len(ids)))
                    if len(left) >= BATCH_ITEMS:
                        pack(False)
                yield frame()
        pack(True)
        yield frame()

    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows_in.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
