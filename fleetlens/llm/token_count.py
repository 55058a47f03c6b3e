"""Token counts by byte-pair merging with a heap and a linked list.

A text becomes symbols, one per character (spaces as U+2581, one more in front). The adjacent pair
whose join has the lowest rank in the vocabulary (the leftmost of several) is popped from a heap and
merged in a linked list (a symbol's size leads to the next, a back link to the one before) until no
pair joins. The count is initial symbols minus merges; a
character that is no piece of the vocabulary counts as its UTF-8 bytes, and no ids are made.

No piece has a space after another character, so no merge crosses a place where a space follows one:
the text is cut there and the counts of short cuts are remembered (twice ``MEMO`` cuts at most per
worker). A run without spaces is one cut, merged whole in n log n.

The vocabulary comes from ``model_path`` on the driver (some 32,000 ranks, sent with the task). Rows
are judged one by one in Arrow batches: no shuffle, no state, a lost task is just run again.

Defined results: a null or empty text has no bytes and no tokens; special strings in a text are
plain text; rows with null or repeated ids are counted like all others; an empty table stays empty;
further columns pass through unless their names equal a result column, which replaces them.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
SPACE = "▁"

# Cuts remembered by a worker, and the longest one remembered.
MEMO = 1 << 18
MEMO_CHARS = 48

_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

RESULT = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
]


def merge_ranks(model_path: str) -> dict[str, int]:
    """Rank of every piece that text can become (0 is merged first; equal scores share a rank)."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    place = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in ids}, reverse=True))}
    ranks = {model.id_to_piece(i): place[model.get_score(i)] for i in ids}
    inside = {c for piece in ranks if len(piece) > 1 for c in piece}
    if any(SPACE in piece.lstrip(SPACE) for piece in ranks) or any(c not in ranks and len(c.encode()) > 1 for c in inside):
        raise ValueError(f"{model_path}: pieces with inner spaces, or with characters that are no pieces, are not supported")
    return ranks


def count_merges(symbols: str, ranks: dict[str, int], longest: int) -> int:
    """Merges that byte-pair encoding makes in one cut, with pieces of up to ``longest`` characters.

    A heap entry is one integer, (rank, left symbol, characters of the join), so entries pop by rank
    and from left to right. Symbols are known by their first character; ``size`` 0 marks those that
    a merge has swallowed.
    """
    n, width, rank_of = len(symbols), longest + 1, ranks.get
    heap = [(rank * n + i) * width + 2 for i in range(n - 1) if (rank := rank_of(symbols[i : i + 2])) is not None]
    if not heap:
        return 0
    heapify(heap)
    size, before = [1] * n, list(range(-1, n - 1))
    merges = 0
    while heap:
        place, joined = divmod(heappop(heap), width)
        left = place % n
        a = size[left]
        right = left + a
        # an entry is stale when either side has been merged since it was pushed
        if not a or right >= n or a + size[right] != joined:
            continue
        merges += 1
        size[left], size[right] = joined, 0
        end = left + joined
        if end < n:
            before[end] = left
            rank = rank_of(symbols[left : end + size[end]])
            if rank is not None:
                heappush(heap, (rank * n + left) * width + joined + size[end])
        previous = before[left]
        if previous >= 0:
            rank = rank_of(symbols[previous:end])
            if rank is not None:
                heappush(heap, (rank * n + previous) * width + end - previous)
    return merges


class CutCounts(dict):
    """cut -> its tokens. Short cuts are remembered in two generations: when the young one is full
    it becomes the old one, from which cuts that are met again come back."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks, self.old = ranks, {}
        self.longest = max(map(len, ranks))

    def __missing__(self, cut: str) -> int:
        n = self.old.get(cut)
        if n is None:
            ranks = self.ranks
            n = len(cut) - count_merges(cut, ranks, self.longest)
            if not cut.lstrip(SPACE).isascii():
                n += sum(len(c.encode()) - 1 for c in cut if c not in ranks)
        if len(cut) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[cut] = n
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, _CUT.findall(SPACE + text.replace(" ", SPACE))))


# Counts by vocabulary; they outlive a task because Python workers are reused.
_remembered: dict[str, CutCounts] = {}


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    K.ship(docs.sparkSession)
    ranks = merge_ranks(model_path)
    name = hashlib.sha256(repr(ranks).encode()).hexdigest()
    added = {f.name for f in RESULT}
    passing = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in passing]

    def task(batches):
        counts = _remembered.setdefault(name, CutCounts(ranks))
        for batch in batches:
            texts = batch.column(text_col)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            n_tokens = pa.array([counts.tokens(t.as_py()) for t in texts], pa.int64())
            cols = [batch.column(c) for c in names] + [n_bytes, n_tokens, pc.greater(n_tokens, limit)]
            yield pa.RecordBatch.from_arrays(cols, names=names + [f.name for f in RESULT])

    return docs.mapInArrow(task, T.StructType(passing + RESULT))


def digest(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
