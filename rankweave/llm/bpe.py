"""Byte-level BPE: pre-tokenisation by a transition-function scan, cached pair merging, exact decoding.

Every character gets a symbol from its class and its nearest neighbours; a symbol is a function from the
state that the automaton of the splitting pattern is in to the next one. An associative scan composes
the functions, so that every state is known without walking the text, and a table of (state before,
symbol) says where pieces start. Most symbols lead to one state whatever was before; only the others,
around apostrophes, need composing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slice_hashes, text_slices

LETTER, NUMBER, SPACE, OTHER, STOP = 1, 2, 3, 4, 5
#: The code points with the property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: No code point; stands between texts.
GAP = 0x110000
#: Pieces kept in a worker's cache before it is emptied.
CACHE_PIECES = 400_000

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, made once a process from the Unicode categories."""
    if not _CLASSES:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.full(GAP + 1, OTHER, dtype=np.uint8)
        for c in range(GAP):
            k = unicodedata.category(chr(c))[0]
            if k in kind:
                out[c] = kind[k]
        out[WHITE], out[GAP] = SPACE, STOP
        _CLASSES.append(out)
    return _CLASSES[0]


#: Symbols: what a character is to the pattern, seen with its neighbours.
(GAPS, PLAIN, WORD, NUMERAL, SIGN, QUOTE1, QUOTE2, BLANKS, JOINED, ALONE) = range(10)
#: States: none yet; in a run of letters, numbers, signs or white space; a blank that the next word takes; a white-space character by
#: itself; an apostrophe that starts a piece before one or two letters of a contraction; its first of two letters; a whole contraction.
(NONE, IN_WORD, IN_NUMBER, IN_SIGNS, IN_BLANKS, TAKEN, SINGLE, BEFORE1, BEFORE2, HALF, WHOLE) = range(11)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) of every symbol and state before."""
    states = range(WHOLE + 1)
    runs = {PLAIN: IN_WORD, WORD: IN_WORD, NUMERAL: IN_NUMBER, SIGN: IN_SIGNS, QUOTE1: IN_SIGNS, QUOTE2: IN_SIGNS, BLANKS: IN_BLANKS}
    step, starts = np.zeros((ALONE + 1, len(states)), dtype=np.uint8), np.ones((ALONE + 1, len(states)), dtype=bool)
    for symbol, run in runs.items():
        # a run goes on; a blank before a word or signs is their first character
        goes_on = [run] if symbol == BLANKS else [run, TAKEN]
        step[symbol], starts[symbol, goes_on] = run, False
    for quote, state in ((QUOTE1, BEFORE1), (QUOTE2, BEFORE2)):
        step[quote, starts[quote]] = state
    for before, after in ((BEFORE1, WHOLE), (BEFORE2, HALF), (HALF, WHOLE)):
        step[WORD, before], starts[WORD, before] = after, False
    step[JOINED], step[ALONE] = TAKEN, SINGLE
    return step, starts


STEP, STARTS = _automaton()
#: Symbols whose function is constant.
_FIXED = (STEP == STEP[:, :1]).all(axis=1)


def symbols(cp: np.ndarray) -> np.ndarray:
    """The symbol of every code point of an array whose texts are parted by GAP."""
    cls = classes()[cp]
    out = np.array([0, PLAIN, NUMERAL, BLANKS, SIGN, GAPS], dtype=np.uint8)[cls]
    after = np.append(cls[1:], STOP)
    # the last white space of a run, before anything but a gap
    last = (cls == SPACE) & (after != SPACE) & (after != STOP)
    out[last] = np.where(cp[last] == 32, JOINED, ALONE)
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        ext = np.concatenate([cp, np.full(2, GAP, dtype=cp.dtype)])
        x, y = ext[quote + 1], ext[quote + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        out[quote[one]], out[quote[two]] = QUOTE1, QUOTE2
        # letters that an apostrophe may bind
        for at in (quote[one] + 1, quote[two] + 1, quote[two] + 2):
            out[at] = WORD
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of functions (one row of next states each) under composition, by doubling, until all are constant."""
    f, reach = functions, 1
    while reach < len(f) and (f != f[:, :1]).any():
        f = np.concatenate([f[:reach], np.take_along_axis(f[reach:], f[:-reach], axis=1)])
        reach *= 2
    return f


def states(symbol: np.ndarray) -> np.ndarray:
    """The state after every symbol, from NONE at the start."""
    out = STEP[symbol, 0]
    loose = np.flatnonzero(~_FIXED[symbol])
    if len(loose):
        # with the constant function before each run of them, their composed functions are constant too
        heads = loose[(loose > 0) & ~np.isin(loose - 1, loose)] - 1
        at = np.union1d(loose, heads)
        f = STEP[symbol[at]]
        if at[0] == loose[0]:
            f = np.concatenate([np.full((1, f.shape[1]), NONE, dtype=np.uint8), f])
        out[at] = scan(f)[len(f) - len(at) :, 0]
    return out


def piece_starts(cp: np.ndarray) -> np.ndarray:
    """Where pieces start in a code-point array whose texts are parted by GAP (which is a piece of its own)."""
    symbol = symbols(cp)
    before = np.concatenate([np.array([NONE], dtype=np.uint8), states(symbol)[:-1]])
    return np.flatnonzero(STARTS[symbol, before])


class Encoder:
    """Ids and bytes by a table of merge ranks {bytes: id}; one_piece may replace the merging of a single piece."""

    def __init__(self, ranks: dict[bytes, int], one_piece=None):
        self.ranks, self.cache, self.one_piece = ranks, {}, one_piece or self.merge
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: repeatedly join the adjacent pair of lowest rank, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(piece[i : i + 2], sys.maxsize) for i in range(len(piece) - 1)]
        while pair:
            best = min(pair)
            if best == sys.maxsize:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], sys.maxsize)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], sys.maxsize)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for pieces of any length."""
        n, ranks = len(piece), self.ranks
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                k = end[nxt[j]]
                if (r := ranks.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : stop])) is not None:
                heapq.heappush(heap, (r, prv[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text. Equal pieces of the texts are merged once, and kept for later calls."""
        joined = b"\n".join(texts)
        text = "\0".join(t.decode() for t in texts)
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if len(texts) > 1:
            cp = cp.copy()
            chars = np.cumsum([len(t) if t.isascii() else len(t.decode()) for t in texts[:-1]]) + np.arange(len(texts) - 1)
            cp[chars] = GAP
        if not len(cp):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        first = piece_starts(cp)
        width = np.where(cp == GAP, 1, 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))
        place = np.concatenate([[0], np.cumsum(width)])
        start, size = place[first], np.diff(np.append(place[first], place[-1]))
        gap = cp[first] == GAP
        doc = np.cumsum(gap)[~gap]
        start, size = start[~gap], size[~gap]
        padded = np.zeros(len(joined) + 8, dtype=np.uint8)
        padded[: len(joined)] = np.frombuffer(joined, dtype=np.uint8)
        _, sample, which = np.unique(slice_hashes(padded, start, size), return_index=True, return_inverse=True)
        cache, found = self.cache, []
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for s, m in zip(start[sample].tolist(), size[sample].tolist()):
            piece = joined[s : s + m]
            ids = cache.get(piece)
            if ids is None:
                ids = array("I", self.one_piece(piece)).tobytes()
                if m <= 64:
                    cache[piece] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        at = np.cumsum(sizes) - sizes
        ids = flat[ragged(at[which], sizes[which])]
        per_doc = np.bincount(doc, weights=sizes[which], minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_doc)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.blob[ragged(self.at[ids], self.size[ids])].tobytes()


def tiktoken_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def json_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tokenizer JSON with a byte-level vocabulary, whose ids follow the merge order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    spec = json.loads(data)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


_ENCODERS: dict[str, Encoder] = {}


def encoder(kind: str, data: bytes) -> Encoder:
    """One encoder a worker process and vocabulary, so that its cache lives on between tasks."""
    key = kind + hashlib.md5(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = (json_ranks if kind.startswith("json") else tiktoken_ranks)(data)
        _ENCODERS[key] = Encoder(ranks, library_merge(ranks) if kind.endswith("library") else None)
    return _ENCODERS[key]


def library_merge(ranks: dict[bytes, int]):
    """Merging of one piece by tiktoken's compiled code, for callers whose method is not BPE itself."""
    import tiktoken

    code = tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})
    return lambda piece: code.encode_ordinary(piece.decode())


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text by the ranks in the file vocabulary (read on the driver, under 2 MB, broadcast).

    Per row: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256,
    and with with_ids also ids array<int> and ends array<long>, the byte offset after every id. Null and
    empty texts give no ids; repeated rows and ids stay; other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = "json" if vocabulary.endswith(".json") else "tiktoken"

    def run(batches):
        enc = encoder(kind, data.value)
        for pdf in batches:
            for at, texts in text_slices(pdf["_id"], pdf["_text"]):
                out = []
                for i, ids in zip(at, enc.encode(texts)):
                    row = [i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()]
                    out.append([*row, ids.astype(np.int32), np.cumsum(enc.size[ids])] if with_ids else row)
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "ends"] if with_ids else [])]
                frame = pd.DataFrame(out, columns=names)
                frame["_id"] = frame["_id"].astype("Int64")
                yield frame

    schema = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, ends array<long>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
