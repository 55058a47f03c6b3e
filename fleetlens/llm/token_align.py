"""Alignment of two tokenizers: byte-level BPE (A) and SentencePiece (B), over Arrow tables.

A document's A and B tokens are flattened with their parent indices, and their byte ends are
segmented cumulative sums. Ends that both sides have, found by Acero hash joins on (document, end),
cut the tokens into groups; joined on the group, A and B ids give links, and ``Table.group_by`` adds
equal ones up, so that only distinct id pairs with their number of occurrences leave a shard.

A shard is a run of rows of an Arrow batch with at most ``SHARD_BYTES`` of text (or one longer
text). The first pass writes one table: a row per document, whose links are places in its shard's
list of distinct id pairs, and a row per shard with that list and in how many of its documents each
pair is linked. Spark merges these partial counts to corpus-wide ones, takes each A id's highest,
joins both to the shards' lists, and a cogroup by shard brings them to the documents. What is
shuffled are a shard's distinct pairs, not the pairs of all its documents; a frequent pair has one
row per shard, on plain exchanges that AQE can split. Nothing comes to the driver.

Tokenizer files come from path parameters on the driver (2 MB, sent with the tasks) and are loaded
once per worker.

Defined results: a null or empty text, or one whose joined A or B bytes differ from space + text
(U+2581 in a text becomes a space in B), has no tokens: zeros and an empty hash; special strings are
plain text; every row is a document of its own, with null and repeated ids; an empty table stays
empty; further columns pass through ``align`` unless their names equal a result column.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

MODEL_A = public_tokenizers.path("byte_bpe_50k.json")
MODEL_B = public_tokenizers.path("piece_bpe_32k.model")

# Bytes of text of a shard, and of one step of the Arrow work within it.
SHARD_BYTES = 4 << 20
STEP_BYTES = 1 << 19

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = [*FIGURES, "n_best", "count_sum", "groups_sha256"]


def byte_letters() -> dict[str, int]:
    """The byte of every letter of byte-level vocabularies: printable bytes stand for themselves,
    the rest for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of every id. A's vocabulary is that of its ``tokenizers`` file;
    ``tiktoken`` applies it (tests hold the ids against the former, which is four times slower)."""

    def __init__(self, a_json: bytes, b_model: bytes):
        spec = json.loads(a_json)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("A is not a plain byte-level BPE file")
        letters, added = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            a_bytes[i] = piece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_of = (pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()))
        self.sizes = tuple(pc.binary_length(x) for x in self.bytes_of)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        flat = (np.concatenate([*a, np.zeros(0, np.uint32)]), np.fromiter(chain.from_iterable(b), np.int32, sum(map(len, b))))
        return tuple(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(f.astype(np.int32)))
                     for x, f in zip((a, b), flat))


_loaded: dict[str, Tokenizers] = {}


def loaded(a_json: bytes, b_model: bytes) -> Tokenizers:
    name = hashlib.sha256(a_json + b_model).hexdigest()
    if name not in _loaded:
        _loaded[name] = Tokenizers(a_json, b_model)
    return _loaded[name]


def same_bytes(ids: pa.ListArray, bytes_of: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which lists of ids spell exactly their text."""
    joined = pc.binary_join(_as_lists(ids, pc.take(bytes_of, ids.values)), b"")
    return pc.equal(joined, pa.array(texts, pa.binary())).to_numpy(zero_copy_only=False)


def _as_lists(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(like.offsets, values)


def token_table(ids: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """One row per token: its document, id, place, and byte end within the document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.cast(pc.take(sizes, flat), pa.int64())).to_numpy()
    before = np.concatenate([[0], total])[ids.offsets.to_numpy()[:-1]]
    end = total - before[doc.to_numpy()]
    return pa.table({"doc": doc, "id": flat, "place": np.arange(len(flat)), "end": end})


def groups_of(ta: pa.Table, tb: pa.Table) -> list[np.ndarray]:
    """Group of every A and every B token, counted through the step; a token whose end the other
    side also has is the last of its group."""
    shared = ta.select(["doc", "end", "place"]).join(tb.select(["doc", "end", "place"]), ["doc", "end"], join_type="inner",
                                                      right_suffix="_b", use_threads=False)
    found = []
    for table, place in ((ta, "place"), (tb, "place_b")):
        last = np.zeros(table.num_rows, np.int64)
        last[shared[place].to_numpy()] = 1
        found.append(np.cumsum(last) - last)
    return found


def group_texts(table: pa.Table, group: np.ndarray, n_groups: int) -> pa.Array:
    """The ids of every group, comma-joined."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.cast(table["id"].combine_chunks(), pa.string())), ",")


def align_step(tok: Tokenizers, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Figures and group hashes of some non-empty texts, and their links: doc, a, b, times."""
    a, b = tok.encode(texts)
    raw = [b" " + t.encode() for t in texts]
    good = np.logical_and(*(same_bytes(ids, by, raw) for ids, by in zip((a, b), tok.bytes_of)))
    if not good.all():
        keep = pa.array(good)
        a, b = (pc.if_else(keep, ids, pa.scalar([], ids.type)) for ids in (a, b))
    ta, tb = (token_table(ids, sizes) for ids, sizes in zip((a, b), tok.sizes))
    ga, gb = groups_of(ta, tb)
    doc_of = ta["doc"].to_numpy()[np.searchsorted(ga, np.arange(ga[-1] + 1 if len(ga) else 0))]
    n, n_groups = len(texts), len(doc_of)
    n_links = np.bincount(ga, minlength=n_groups) * np.bincount(gb, minlength=n_groups)
    figures = {"n_a": np.diff(a.offsets.to_numpy()), "n_b": np.diff(b.offsets.to_numpy()),
               "n_groups": np.bincount(doc_of, minlength=n),
               "n_links": np.array([x.sum() for x in np.split(n_links, np.searchsorted(doc_of, np.arange(1, n)))])}
    written = pc.binary_join_element_wise(group_texts(ta, ga, n_groups), group_texts(tb, gb, n_groups), "|")
    bounds = np.searchsorted(doc_of, np.arange(n + 1))
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), written), ";")
    hashes = [hashlib.sha256(w.as_py().encode()).hexdigest() if c else "" for w, c in zip(whole, figures["n_groups"].tolist())]

    def ids_of(table, group, side):
        t = pa.table({"group": group, side: table["id"]})
        return t.group_by(["group", side], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", side, f"n_{side}"])

    links = ids_of(ta, ga, "a").join(ids_of(tb, gb, "b"), "group", join_type="inner", use_threads=False)
    links = pa.table({"doc": doc_of[links["group"].to_numpy()], "a": links["a"], "b": links["b"],
                      "times": pc.multiply(links["n_a"], links["n_b"])})
    links = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "a", "b", "times"])
    return figures, hashes, links


def steps(sizes: np.ndarray, limit: int):
    """(begin, end) runs of rows of at most ``limit`` bytes, or of one longer row."""
    total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


def align_shard(tok: Tokenizers, texts: list[str], sizes: np.ndarray) -> tuple[list, pa.Array, pa.Array, pa.Table]:
    """Figures per row, links per row (places in the shard's pairs, times), and the shard's pairs
    with their documents counted: a, b, docs."""
    figures, hashes, links = {c: np.zeros(len(texts), np.int64) for c in FIGURES}, [""] * len(texts), []
    rows = np.flatnonzero(sizes)
    for begin, end in steps(sizes[rows], STEP_BYTES):
        at = rows[begin:end]
        figs, hs, found = align_step(tok, [texts[i] for i in at])
        for c in FIGURES:
            figures[c][at] = figs[c]
        for i, h in zip(at.tolist(), hs):
            hashes[i] = h
        links.append(found.set_column(0, "doc", pa.array(at[found["doc"].to_numpy()])))
    empty = pa.table({"doc": pa.array([], pa.int64()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "times": pa.array([], pa.int64())})
    links = pa.concat_tables([empty, *links])
    pairs = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "docs"])
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")]).append_column("pair", pa.array(np.arange(pairs.num_rows), pa.int32()))
    links = links.join(pairs.select(["a", "b", "pair"]), ["a", "b"], join_type="inner", use_threads=False)
    doc, pair = links["doc"].to_numpy(), links["pair"].to_numpy()
    order = np.lexsort((pair, doc))
    ends = pa.array(np.searchsorted(doc[order], np.arange(len(texts) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in ((pair, pa.int32()), (links["times"].to_numpy(), pa.int64()))]
    cols = [pa.array(figures[c], pa.int64()) for c in FIGURES] + [pa.array(hashes, pa.string()), *lists]
    return cols, pairs


def align(docs: DataFrame, text_col: str = "text", a_path: str = MODEL_A, b_path: str = MODEL_B,
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (without the text) with the figures of RESULT."""
    K.ship(docs.sparkSession)
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        a_json, b_model = fa.read(), fb.read()
    passing = [f for f in docs.schema.fields if f.name not in {*RESULT, text_col}]
    keep = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(passing)])
    row = T.StructType([T.StructField("shard", T.LongType()), *keep.fields]
                       + [T.StructField(c, T.LongType()) for c in FIGURES] + [T.StructField("groups_sha256", T.StringType())]
                       + [T.StructField("pair", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))]
                       + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a", "b")]
                       + [T.StructField("docs", T.ArrayType(T.LongType()))])
    n_keep = len(passing)

    def first(batches):
        tok = loaded(a_json, b_model)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(n_keep), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, end in steps(sizes, shard_bytes):
                part = texts.slice(begin, end - begin).to_pylist()
                cols, pairs = align_shard(tok, part, sizes[begin:end])
                n = end - begin
                mine = [batch.column(i).slice(begin, n) for i in range(n_keep)]
                none = [pa.nulls(n, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), *mine, *cols, *none], names=row.names)
                one = [pa.ListArray.from_arrays([0, pairs.num_rows], pairs[c].combine_chunks().cast(t))
                       for c, t in (("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()))]
                blank = [pa.nulls(1, f.type) for f in (*(x for x in mine), *cols)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *blank, *one], names=row.names)
                number += 1

    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(K.named([f.name for f in passing]))], F.col(text_col).alias("text"))
    table = K.written(source.mapInArrow(first, row))
    asked = table.where("a IS NOT NULL").select(F.col("shard").alias("of"), F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pair", "p"))
    asked = asked.select("of", "pair", "p.a", "p.b", "p.docs")
    count = asked.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = count.groupBy("a").agg(F.max("count").alias("highest"))
    count = K.written(count.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")))
    answers = asked.drop("docs").join(count, ["a", "b"]).select("of", "pair", "count", "best")
    mine = table.where("a IS NULL").drop("a", "b", "docs")
    out = T.StructType([*keep.fields, *(T.StructField(c, T.LongType()) for c in RESULT[:-1]), T.StructField("groups_sha256", T.StringType())])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        place = right["pair"].to_numpy()
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[place] = right["count"].to_numpy()
        best[place] = right["best"].to_numpy(zero_copy_only=False)
        pair, times = (left[c].combine_chunks() for c in ("pair", "times"))
        doc = pc.list_parent_indices(pair)
        flat, times = pc.list_flatten(pair).to_numpy(), pc.list_flatten(times).to_numpy()
        sums = pa.table({"doc": doc, "n_best": times * best[flat], "count_sum": times * count[flat]})
        sums = sums.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
        at = sums["doc"].to_numpy()
        more = {c: np.zeros(left.num_rows, np.int64) for c in ("n_best", "count_sum")}
        for c, v in more.items():
            v[at] = sums[f"{c}_sum"].to_numpy()
        cols = [left[c] if c in left.column_names else pa.array(more[c]) for c in out.names]
        return pa.Table.from_arrays(cols, names=out.names)

    found = mine.groupBy("shard").cogroup(answers.groupBy("of")).applyInArrow(second, out)
    return found.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(passing)], *RESULT)


def digest(aligned: DataFrame) -> DataFrame:
    return aligned.select("doc_id", *RESULT)
