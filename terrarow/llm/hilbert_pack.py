"""Packing along a space-filling curve.

A text's tokens are hashed with signs into DIMS slots; that vector is projected to three dimensions, each mapped to
a uniform scale, and the point's Hilbert index orders the corpus. Documents are range-partitioned and sorted by
(index, hash of id), so even a large group of equal texts spreads over partitions, and each partition packs its
stretch of the curve without gaps: documents are concatenated and cut every seq_len tokens. What is left at a
partition's end is cut at powers of two, so it needs no padding either.

Edge cases: null text is empty and still has its end token; equal rows are packed each; an empty table gives no
sequence; rows that share a doc_id are packed each, so their pieces share it too; rows without a doc_id are packed with
a null one; extra columns are ignored. A document of any length spans as many sequences as it needs.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stored, table
from .textual import mix

DIMS, ORDER = 64, 16
SEQ_LEN, END_ID = 2048, 1
#: Chunks that one of a worker's two generations of remembered ids holds, at most; bytes that they take, about; and
#: characters of a chunk beyond which it isn't remembered (unspaced scripts, encoded data).
MAX_CACHE, CACHE_BYTES, LONG_CHUNK = 450_000, 96 << 20, 64
#: Bytes of one remembered chunk beside its characters and ids, about.
_ENTRY_BYTES = 160
#: Token bytes that one packing task takes, about.
TASK_BYTES = 48 << 20

_tokenizers: dict = {}
_hashes: dict = {}


#: Letters below this are lower-cased one by one and composed already.
_LATIN_END = "\u0250"


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level merges: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_CHARS = _byte_chars()
_TAIL = ".,;:!?*$&%#|"


class _Ids(dict):
    """Packed ids by chunk; what isn't known is taken from the old generation or made."""

    def __init__(self, make, old):
        super().__init__({"": b""})
        self.make, self.old, self.size = make, old, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk.rstrip(_TAIL)
            # a plain ending is looked up apart from its word
            if word != chunk and word and _ends_in_letter(word) and "'" not in word and "<" not in word:
                ids = self[word] + self[chunk[len(word) :]]
            else:
                ids = self.make(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
            self.size += _ENTRY_BYTES + len(chunk.encode("utf-8", "surrogatepass")) + len(ids)
        return ids

    def full(self) -> bool:
        return len(self) > MAX_CACHE or self.size > CACHE_BYTES


def _ends_in_letter(word: str) -> bool:
    """Whether a word ends in a letter or digit also after composition and lower case; marks join what follows them."""
    last = word[-1]
    if last.isascii():
        return last.isalnum()
    return unicodedata.category(unicodedata.normalize("NFC", word).lower()[-1])[0] in "LN"


class ChunkTokenizer:
    """Token ids of a text as packed bytes, from remembered ids of its chunks between ASCII white space.

    Right for tokenizers that drop white space, never join across it, and part letters and digits from other
    characters. Ids are two bytes where they fit, else four. A full generation becomes the old one; chunks met again
    move to the new one, so frequent ones stay. Both are bounded in entries and bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.n_ids = max(self.model.get_vocab(True).values()) + 1
        self.code = "H" if self.n_ids <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        pipeline = json.loads(self.model.to_str())
        kinds = lambda part, key: [x["type"] for x in (pipeline[part] or {}).get(key, ())]
        self.lowers = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and pipeline["model"]["type"] == "BPE"
        self.merge = self.model.model.tokenize
        self.known = _Ids(self._make, {})

    def _make(self, chunk: str) -> bytes:
        if self.lowers and chunk.isalpha() and max(chunk) < _LATIN_END and "\u0130" not in chunk:  # needs only lower case and the merges
            word = chunk.lower()
            return array(self.code, [t.id for t in self.merge(word if word.isascii() else word.encode().decode("latin1").translate(_BYTE_CHARS))]).tobytes()
        return array(self.code, self.model.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.known.full():
                self.known.old = {}
                self.known = _Ids(self._make, dict(self.known))
            ids = self.known.__getitem__
            for c in "\n\t\r\x0b\x0c":
                if c in t:
                    t = t.replace(c, " ")
            out.append(b"".join(map(ids, t.split(" "))))
        return out


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hilbert_index(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert indices of integer points (n, dims), each coordinate of order bits.

    Gray-code form: undo the excess rotations from the top bit down, then encode and interleave.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(order - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _slots(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each token id below n."""
    if n not in _hashes:
        h = mix(np.arange(1, n + 1, dtype=np.uint64))
        _hashes[n] = (h & np.uint64(DIMS - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    return _hashes[n]


def hashed_vector(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """Signed square roots of hashed token counts, of length one (zero for no tokens)."""
    slot, sign = _slots(n_ids)
    v = np.bincount(slot[ids], sign[ids], DIMS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    size = np.sqrt(v @ v)
    return v / size if size else v


def curve_keys(documents: list[np.ndarray], n_ids: int, order: int = ORDER) -> np.ndarray:
    """Hilbert index of each document's token ids."""
    if not documents:
        return np.zeros(0, np.int64)
    project = np.random.default_rng(20240229).standard_normal((DIMS, 3))
    at = np.stack([hashed_vector(d, n_ids) for d in documents]) @ project
    uniform = 1 / (1 + np.exp(-1.702 * at))  # the logistic curve stands for the normal distribution's
    return hilbert_index(np.minimum((uniform * (1 << order)).astype(np.int64), (1 << order) - 1), order)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, curve, tie, n_tokens, ids: ids packed as in ChunkTokenizer, the end token last."""

    def run(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tok = tokenizer(vocabulary)
        end = np.array([end_id], tok.dtype).tobytes()
        ids = tok.encode(texts)
        curve = curve_keys([np.frombuffer(x, tok.dtype) for x in ids], tok.n_ids)
        yield {"doc_id": batch.column(0), "tie": batch.column(2), "curve": curve, "n_tokens": [len(x) // tok.dtype.itemsize + 1 for x in ids], "ids": [x + end for x in ids]}

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.length("text")).alias("tie"))
    return map_rows(rows, run, "doc_id bigint, curve bigint, tie bigint, n_tokens bigint, ids binary")


_PIECE = "array<struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>>"
_SEQUENCE = f"sequence_id bigint, length int, padded int, ids binary, pieces {_PIECE}"


def pack(docs: DataFrame, vocabulary: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per sequence: sequence_id, length, padded length, its ids (unpadded, packed), and its pieces in order."""
    vocabulary = vocabulary or default_vocabulary()
    rows = stored(tokenized(docs, vocabulary, end_id), "tokens")
    width = 2
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * width // TASK_BYTES))
    dealt = rows.repartitionByRange(n, "curve", "tie", "doc_id").sortWithinPartitions("curve", "tie", "doc_id")
    schema = pa.schema([("sequence_id", pa.int64()), ("length", pa.int32()), ("padded", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")])))])

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0
        dtype = tokenizer(vocabulary).dtype
        open_pieces: list = []  # (doc_id, start, ids, doc_tokens) of the sequence that isn't full yet
        filled, out = 0, []

        def emit(pieces):
            nonlocal made
            at, found = 0, []
            for doc_id, start, ids, doc_tokens in pieces:
                found.append({"doc_id": doc_id, "start": start, "length": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "doc_tokens": doc_tokens, "offset": at})
                at += len(ids)
            padded = at if at & (at - 1) == 0 else seq_len
            out.append({"sequence_id": base + made, "length": at, "padded": padded, "ids": b"".join(p[2].tobytes() for p in pieces), "pieces": found})
            made += 1

        for batch in batches:
            for doc_id, n_tokens, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                at = 0
                while at < n_tokens:
                    take = min(seq_len - filled, n_tokens - at)
                    open_pieces.append((doc_id, at, ids[at : at + take], n_tokens))
                    at += take
                    filled += take
                    if filled == seq_len:
                        emit(open_pieces)
                        open_pieces, filled = [], 0
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        # the rest of the partition: sequences of powers of two
        while filled:
            size = 1 << (filled.bit_length() - 1)
            own, left = [], size
            while left:
                doc_id, start, ids, doc_tokens = open_pieces.pop(0)
                own.append((doc_id, start, ids[:left], doc_tokens))
                if len(ids) > left:
                    open_pieces.insert(0, (doc_id, start + left, ids[left:], doc_tokens))
                left -= len(own[-1][2])
            emit(own)
            filled -= size
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.select("doc_id", "n_tokens", "ids").mapInArrow(run, _SEQUENCE)


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece of the packed sequences."""
    return packed.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op1_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(table(spark, sf_dir, "documents")))
