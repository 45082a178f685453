"""Best-fit packing by minimum bin slack.

Only a piece's length decides where it fits, so bins are planned on the histogram of lengths: seq_len counters, whatever
the size of the corpus. For each bin, the longest piece that is left is taken and a subset-sum over the other available
lengths, kept as the bits of one integer, finds the fullest combination that still fits; that combination is removed. It
is removed as often as its counts allow, since the next bins would choose it again. The plan is a list of
combinations with the number of bins of each.

Pieces are numbered within their length without moving them: each task counts its own as it makes them, and a sum over
(task, length) counts says at what number a task begins. The number gives the bin and the place in it.

Documents longer than a sequence are cut into whole sequences behind a first piece that holds the rest. Edge cases: null
text is empty and still has its end token; equal rows and repeated doc_ids are packed each; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, SLICE_BYTES, stored, table
from .numbering import following

SEQ_LEN, END_ID = 1024, 2
#: Words that one of a worker's two generations of remembered ids holds, at most; characters of the longest one.
MAX_CACHE, LONG_WORD = 300_000, 48

_tokenizers: dict = {}


class _Ids(dict):
    """Packed ids by word (with the space in front of it); what isn't known is taken from the old generation or made."""

    def __init__(self, make, old):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word if word[0] == "\n" else " " + word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class ByteTokenizer:
    """Token ids of a byte-level BPE without normaliser, as packed bytes.

    Such a model never joins a character with white space behind it, so a text of single spaces and newlines falls into
    words whose ids are remembered; other texts go through the model whole. Where the same vocabulary lies beside the
    file as ranks, they make the ids, since that is faster; tests hold both against each other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.model = model
        special = [t.content for t in model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.code = "H" if max(model.get_vocab(True).values()) < 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encode_plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        else:
            self.encode_plain = lambda text: model.encode(text, add_special_tokens=False).ids
        self.known = _Ids(self._make, {})

    def _make(self, text: str) -> bytes:
        return array(self.code, self.encode_plain(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.known) > MAX_CACHE:
            self.known.old = {}
            self.known = _Ids(self._make, dict(self.known))
        if self.special and self.special.search(text):
            return array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.replace("\n", " \n").split(" ")
        # other white space, or runs of it, may be joined
        if not first or "" in words or "\n\n" in text or not text.replace("\n", " ").isprintable():
            return self._make(text)
        return self._make(first) + b"".join(map(self.known.__getitem__, words))


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fullest(counts: np.ndarray, room: int) -> Counter:
    """Lengths, with how often each, whose sum is the largest that fits into room; longer ones are tried first."""
    reached, steps, mask = 1, [], (2 << room) - 1
    for length in (np.flatnonzero(counts[: room + 1])[::-1]).tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left and not reached >> room:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= reached << length * take & mask
            left, take = left - take, 2 * take
        if reached >> room:
            break
    at, found = reached.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] += take
            at -= length * take
    return found


def plan(counts: np.ndarray, seq_len: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: pieces in each bin}) for all pieces; counts: of each length from 0 to seq_len."""
    counts, out = counts.astype(np.int64).copy(), []
    counts[0] = 0
    longest = seq_len
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        bin_ = fullest(counts, seq_len - longest)
        counts[longest] += 1
        bin_[longest] += 1
        bins = min(int(counts[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            counts[length] -= bins * n
        out.append((bins, dict(sorted(bin_.items(), reverse=True))))


class Places:
    """Sequence and offset of the nth piece of a length, by a plan."""

    #: Above any number of pieces of one length.
    SPAN = 1 << 50

    def __init__(self, bins_of: list[tuple[int, dict[int, int]]]):
        used: Counter = Counter()
        rows, sequence = [], 0
        for bins, lengths in bins_of:
            offset = 0
            for length, n in lengths.items():
                rows.append((length * self.SPAN + used[length], sequence, n, offset, length))
                used[length] += bins * n
                offset += length * n
            sequence += bins
        self.key, self.sequence, self.each, self.offset, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.sequences = sequence

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) * self.SPAN + nth
        row = np.searchsorted(self.key, key, "right") - 1
        bin_, slot = np.divmod(key - self.key[row], self.each[row])
        return self.sequence[row] + bin_, self.offset[row] + slot * self.length[row]


_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, nth_here bigint"


def cut(docs: DataFrame, vocabulary: str, seq_len: int, end_id: int) -> DataFrame:
    """The pieces of the documents; part is the task that made one, nth_here its number among those of its length there."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth_here", pa.int64())]

    def pieces(batch: pa.RecordBatch, part: int, seen: list[int]) -> pa.RecordBatch:
        tok, rows = tokenizer(vocabulary), []
        end, width = np.array([end_id], tok.dtype).tobytes(), tok.dtype.itemsize
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = (tok.encode(text) if text else b"") + end
            n = len(ids) // width
            start, length, piece = 0, n % seq_len or seq_len, 0
            while start < n:
                own = ids[start * width : (start + length) * width]
                crc = zlib.crc32(np.frombuffer(own, tok.dtype).astype("<u4").tobytes())
                rows.append((doc_id, piece, start, length, crc, own, part, seen[length]))
                seen[length] += 1
                start, length, piece = start + length, seq_len, piece + 1
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (seq_len + 1)
        for batch in batches:
            step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield pieces(batch.slice(at, step), part, seen)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def pack(docs: DataFrame, vocabulary: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its ids (packed), sequence_id and offset."""
    made = stored(cut(docs, vocabulary or default_vocabulary(), seq_len, end_id), "pieces")
    counts = stored(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # seq_len rows at most
        histogram[length] = n
    places = Places(plan(histogram, seq_len))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(), nth.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    begun = following(counts, ["length"], "part", "n").select("part", "length", "before")
    placed = made.join(begun, ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("nth_here")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, length, its ids (packed), and doc_id, piece, start and length of its pieces in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))  # a sequence's pieces: seq_len at most
    found = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return found.select("sequence_id", "length", joined.alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"], p["piece"], p["start"], p["length"], p["offset"])).alias("pieces"))


def op12_slack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
