"""Near-duplicate groups by consistent weighted sampling of TF-IDF shingles.

A text is a weighted set of its five-word shingles: count in the text times idf = ln((1 + N) / (1 + df)) + 1. Equal
texts are collapsed before they are compared, and df counts copies once: with copies counted each, the shingles of a large group would be
frequent for that very reason, and the few edits of a copy, being rare, would outweigh what it shares with its group.
So texts that agree in one of SKETCHES keys, of two plain minhashes each, and in ALIKE of all these minhashes with one
document that stands for the key (a passage alone doesn't make a copy), count as copies: a document that shares its
most frequent such key with n - 1 others adds 1 / n to the df of its shingles and to N, in a corpus of any size. df is
counted over all documents in SLOTS hashed slots, a table of fixed size: a frequent shingle stands out of its
slot, rare ones share the
slots' mean. Improved consistent weighted sampling draws SAMPLES samples (their gamma and uniform variates come from
hashed tables), BANDS bands of ROWS samples each.

Members of a band's bucket are linked to one representative, the member that meets the most others in its buckets
(of edited copies usually their source), so no bucket emits its pairs. Where a bucket then has several components,
blocks of the members outside its largest one meet blocks of all its members, in numpy, by their samples and
FURTHER * SAMPLES further ones of a byte each; the
texts of members that agree with a member of another component follow, in parts of _PART. Pairs of different components
go by falling agreement of their samples, and a link found joins components, so pairs within one are never tried.
Every link is verified by the exact weighted Jaccard similarity of the texts; pairs that agree in fewer than LEAST of
SAMPLES samples (odds of 3e-5 at the similarity wanted), or LEAST_FURTHER of the further ones (1e-5), are dropped (the bands themselves miss a pair with odds of 6e-4). The classes are
the components of the verified links.

Words are runs of characters other than ASCII white space. Edge cases: a null text and a text without words are
classes of their own; a text of one to four words is one shingle; texts of any length are read whole; equal texts, also
repeated rows, are one class;
rows with a null doc_id have the null class; unlike texts of one doc_id are told apart by their digests, each in the
class of its own text; an empty table gives no rows; extra columns are ignored. Python tasks
hold one batch and the tables of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from terrarow.operators.graph import components

from . import url_filter
from .common import map_rows, stored, table
from .textual import as_bytes, mix, shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
SLOTS = 1 << 18
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
_POOL = 1 << 14
#: Pairs with fewer equal samples are too unlike.
LEAST = 32
#: Further rounds of SAMPLES samples, a byte each, of members of buckets with several components; equal ones that a pair needs.
FURTHER, LEAST_FURTHER = 7, 280
#: Members of a bucket whose samples one block holds, and whose texts one part of a block holds.
_BLOCK, _PART = 2048, 128
#: Bits of a Bloom filter in front of a join, at most; bits a key, at most and at least (with fewer the join goes without).
FILTER_BITS, MOST_BITS, LEAST_BITS = 10 * (8 << 20), 10.0, 2.0
#: Keys of two plain minhashes each, by which copies count once in document frequencies; minhashes in which copies agree, at least; a document's share is in units of 1 / _UNIT.
SKETCHES, ALIKE, _UNIT = 8, 9, 1 << 24
_ODD = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)

_variates: list = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SAMPLES variates: r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    if not _variates:
        g = np.random.default_rng(20100813)
        size = (_POOL, SAMPLES)
        _variates.extend((g.gamma(2.0, 1.0, size).astype(np.float32), np.log(g.gamma(2.0, 1.0, size)).astype(np.float32), g.random(size, np.float32)))
    return tuple(_variates)


def shingle_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their counts."""
    s = np.sort(shingle_hashes(word_hashes(as_bytes(text))[0], SHINGLE))
    if not len(s):
        return s, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[first], np.diff(np.r_[first, len(s)])


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def idf_of(df: np.ndarray, n_docs: float) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1."""
    return (np.log((1.0 + n_docs) / (1.0 + np.minimum(df, n_docs))) + 1.0).astype(np.float32)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SKETCHES keys, each of two minhashes of the set of shingles, and a byte of each minhash."""
    least = np.array([(shingles * c).min() for c in _ODD], np.uint64).reshape(SKETCHES, 2)
    out = np.arange(SKETCHES, dtype=np.uint64)
    for j in range(2):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + least[:, j])
    return out.view(np.int64), mix(least.ravel()).astype(np.uint8)


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES hashed (shingle, level) samples of one weighted set."""
    r_of, c_of, b_of = _tables()
    best = np.full(SAMPLES, np.inf, np.float32)
    who, level = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.float32)
    logs = np.log(weights).astype(np.float32)
    low = (shingles & np.uint64(_POOL - 1)).astype(np.int64)
    mid = ((shingles >> np.uint64(14)) & np.uint64(_POOL - 1)).astype(np.int64)
    high = ((shingles >> np.uint64(28)) & np.uint64(_POOL - 1)).astype(np.int64)
    columns = np.arange(SAMPLES)
    for at in range(0, len(shingles), 512):
        part = slice(at, at + 512)
        r, b = r_of[low[part]], b_of[high[part]]
        t = np.floor(logs[part, None] / r + b)
        a = c_of[mid[part]] - r * (t - b + 1)
        k = a.argmin(0)
        least = a[k, columns]
        new = least < best
        best[new], who[new], level[new] = least[new], at + k[new], t[k, columns][new]
    return mix(shingles[who] + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + columns.astype(np.uint64))


def further_samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FURTHER * SAMPLES more samples, cut to bytes."""
    again = [samples(mix(shingles + np.uint64(r)), weights) for r in range(1, FURTHER + 1)]
    return np.concatenate(again).astype(np.uint8)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two results of shingle_counts."""
    (sa, na), (sb, nb) = a, b
    if not len(sa) or not len(sb):
        return 0.0
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    same = sb[at] == sa
    both = float(np.minimum(na[same], nb[at[same]]) @ idf[slot_of(sa[same])].astype(float))
    total = float(na @ idf[slot_of(sa)].astype(float) + nb @ idf[slot_of(sb)].astype(float)) - both
    return both / total if total else 0.0


def _copies(docs: DataFrame) -> DataFrame:
    """text_key, n: texts that count as copies, and of how many documents; text_key: 128 bits of the text's digest.

    Equal texts are collapsed first, with their number; keys and marks, no texts, are shuffled.
    """

    def run(batch):
        found = [sketch(shingle_hashes(w, SHINGLE)) if len(w) else (np.zeros(0, np.int64), np.zeros(0, np.uint8)) for w in (word_hashes(as_bytes(t.as_py()))[0] for t in batch.column(0))]
        # four mixed bytes in front, so that the smallest of a key is any of its documents
        marks = [mix(np.frombuffer(b.tobytes(), np.uint64)).sum().tobytes()[:4] + b.tobytes() if len(b) else b"" for _, b in found]
        yield {"text_key": batch.column(1), "v": [k for k, _ in found], "mark": marks}

    sketched = map_rows(docs.select("text", _text_key()), run, "text_key binary, v array<bigint>, mark binary")
    texts = stored(sketched.groupBy("text_key").agg(F.count("*").alias("c"), F.min("v").alias("v"), F.min("mark").alias("mark")), "sketches")
    keys = texts.select("text_key", "c", "mark", F.explode("v").alias("v"))
    met = stored(keys.groupBy("v").agg(F.sum("c").alias("n"), F.min("mark").alias("of")).where("n > 1"), "sketch-groups")
    same = lambda i: (F.substring("mark", i, 1) == F.substring("of", i, 1)).cast("int")
    alike = sum((same(i) for i in range(6, 5 + 2 * SKETCHES)), same(5))
    return stored(keys.join(met, "v").where(alike >= ALIKE).groupBy("text_key").agg(F.max("n").alias("n")), "copies")


def _text_key() -> Column:
    return F.substring(_key(F.col("text")), 1, 16).alias("text_key")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Documents per hashed shingle slot (fixed size), and their number, copies counted once."""
    copies = _copies(docs)
    # only texts that may be copies are shuffled to learn of how many
    level = _level(copies, "text_key", 5)
    every = docs.select("text", _text_key())
    maybe = _passing(every, "text_key", level, costly=True).join(copies, "text_key", "left").select("text", F.coalesce("n", F.lit(1)).alias("n"))
    single = _passing(every, "text_key", level, costly=True, others=True).select("text", F.lit(1).cast("bigint").alias("n"))

    def count(batches):
        df = np.zeros(SLOTS, np.int64)
        total = 0
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist()):
                shingles = shingle_hashes(word_hashes(as_bytes(t.as_py()))[0], SHINGLE)
                if len(shingles):
                    slots = np.unique(slot_of(shingles))
                    part = max(1, _UNIT // n)
                    df[slots] += part
                    total += part
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[total, df[at]])], ["slot", "n"])

    rows = maybe.union(single).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy() / _UNIT
    df = np.zeros(SLOTS)
    df[slots[slots >= 0]] = n[slots >= 0]
    return df, float(n[slots < 0].sum())


def _key(text: Column) -> Column:
    """Digest of a text; one byte for null."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("00")))


def _id(doc_id: Column, key: Column) -> Column:
    """doc_id and 128 bits of the text's digest, in the order of doc_id."""
    return F.concat(F.unhex(F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.substring(key, 1, 16))


def _doc_id(id_: Column) -> Column:
    return F.conv(F.hex(F.substring(id_, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, key (digest of the text), samples (int per sample), bands (long per band); the last two null without words."""

    def run(batch):
        sig, bands = [], []
        for t in batch.column(1):
            s, n = shingle_counts(t.as_py())
            if not len(s):
                sig.append(None), bands.append(None)
                continue
            got = samples(s, n * idf.value[slot_of(s)])
            sig.append((got & np.uint64(0x7FFFFFFF)).astype(np.int32))
            rows = got.reshape(BANDS, ROWS)
            b = np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                b = mix(b * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
            bands.append(b.view(np.int64))
        yield {"doc_id": batch.column(0), "key": batch.column(2), "samples": sig, "bands": bands}

    rows = docs.select("doc_id", "text", _key(F.col("text")).alias("key"))
    return map_rows(rows, run, "doc_id bigint, key binary, samples array<int>, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of least or more."""

    def verify(batches):
        last, held = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if b != last:
                    last, held = b, shingle_counts(tb)
                if similarity(shingle_counts(ta), held, idf.value) >= least:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    of = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary"), "verified")


def _alike(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in LEAST samples or more."""
    of = lambda x: prints.select(F.col("id").alias(x), F.col("samples").alias(f"samples_{x}"))
    agree = F.aggregate(F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return stored(pairs.join(of("a"), "a").join(of("b"), "b").where(agree >= LEAST).select("a", "b"), "alike")


def _agreeing(group: list[tuple]) -> list[tuple[int, int, int]]:
    """(-equal samples, k, m) of the pairs of an outside member and one of another component that agree in enough samples; group: id, component, out, band, samples, bands, further."""
    band = group[0][3]
    sig, bands = np.array([g[4] for g in group], np.int32), np.array([g[5] for g in group], np.int64)
    far = np.frombuffer(b"".join(g[6] for g in group), np.uint8).reshape(len(group), -1)
    is_out, kinds = np.array([g[2] for g in group]), np.unique([g[1] for g in group], return_inverse=True)[1]
    inside = np.flatnonzero(~is_out)
    pairs = []
    for k in np.flatnonzero(is_out).tolist():
        other = inside[kinds[inside] != kinds[k]]
        other = other[(bands[other, :band] != bands[k, :band]).all(1)]  # pairs that met in an earlier band were tried there
        same = (sig[other] == sig[k]).sum(1)
        other, same = other[same >= LEAST], same[same >= LEAST]
        more = (far[other] == far[k]).sum(1)
        pairs += [(-n, min(k, m), max(k, m)) for n, m in zip((same + more)[more >= LEAST_FURTHER].tolist(), other[more >= LEAST_FURTHER].tolist())]
    return pairs


def _linked(group: list[tuple], idf: np.ndarray, least: float):
    """Verified links between members of different components; group as for _agreeing, and the text."""
    ids, comps = ([g[k] for g in group] for k in range(2))
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    counts: dict[int, tuple] = {}

    def of(k):
        if k not in counts:
            counts[k] = shingle_counts(group[k][7].as_py())
        return counts[k]

    for _, k, m in sorted(_agreeing(group)):
        a, b = root(comps[k]), root(comps[m])
        if a != b and similarity(of(k), of(m), idf) >= least:
            up[a] = b
            yield ids[k], ids[m]


_DEALT = ("bucket", "i", "o")
_MEMBER = ("id", "c", "out", "band", "samples", "bands", "further")


def _by_group(rows: DataFrame, columns: tuple[str, ...], fn, schema: str) -> DataFrame:
    """fn on the rows (tuples of columns) of each (bucket, i, o); fn(key, group) gives lists of the schema's columns."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types

    def run(batches):
        group: list = []
        key = None

        def done():
            found = list(fn(key, group)) if group else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in _DEALT))
            values = [batch.column(c) if c == "text" else batch.column(c).to_pylist() for c in columns]
            for now, *row in zip(keys, *values):
                if group and key != now:
                    yield done()
                    group = []
                key = now
                group.append(tuple(row))
        yield done()

    return rows.select(*_DEALT, *columns).repartition(n, *_DEALT).sortWithinPartitions(*_DEALT).mapInArrow(run, schema)


def _across(rows: DataFrame, prints: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Verified links between components that share a bucket. rows: bucket, band, id, c (component).

    Members outside the bucket's largest component, in blocks, meet all members, in blocks: a task holds two blocks
    at a time, however large the bucket. Samples are compared first; texts go only where pairs agree.
    """
    sizes = rows.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("m.c").alias("main"), "n", (F.col("n") - F.col("m.k")).alias("n_out"))
    mixed = stored(mixed, "mixed-buckets")
    left = stored(rows.join(mixed, "bucket"), "mixed")
    n_in, n_out = F.ceil(F.col("n") / _BLOCK).cast("int"), F.ceil(F.col("n_out") / _BLOCK).cast("int")
    own = lambda k: F.pmod(F.xxhash64("id", "bucket"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    members = left.withColumn("i", own(n_in)).withColumn("o", every(n_out)).select(*_DEALT, "id", "c", F.lit(False).alias("out"), "band")
    outside = left.where("c != main").withColumn("o", own(n_out)).withColumn("i", every(n_in)).select(*_DEALT, "id", "c", F.lit(True).alias("out"), "band")
    def more(batch):
        counts = [shingle_counts(t.as_py()) for t in batch.column(3)]
        yield {c: batch.column(i) for i, c in enumerate(("id", "samples", "bands"))} | {"further": [further_samples(h, n * idf.value[slot_of(h)]).tobytes() for h, n in counts]}

    mixed_texts = prints.select("id", "samples", "bands").join(left.select("id").distinct(), "id", "left_semi").join(texts, "id")
    known = stored(map_rows(mixed_texts, more, "id binary, samples array<int>, bands array<bigint>, further binary"), "mixed-prints")

    def agreeing(key, group):
        pairs = np.array([pair for _, *pair in _agreeing(group)], np.int64).reshape(-1, 2)
        place = np.unique(pairs, return_inverse=True)[1].reshape(-1, 2) // _PART
        for part in np.unique(place, axis=0).tolist():
            for k in np.unique(pairs[(place == part).all(1)]).tolist():
                yield (key[0], *(int(key[j]) << 32 | part[j - 1] for j in (1, 2)), *group[k])

    near = stored(_by_group(members.union(outside).join(known, "id"), _MEMBER, agreeing, "bucket bigint, i bigint, o bigint, id binary, c binary, out boolean, band int, samples array<int>, bands array<bigint>, further binary"), "agreeing")
    links = _by_group(near.join(texts, "id"), (*_MEMBER, "text"), lambda _, group: _linked(group, idf.value, least), "a binary, b binary")
    return stored(links.distinct(), "across")


def _level(keys: DataFrame, column: str, seed: int) -> url_filter.Level | None:
    """A Bloom filter of a column of distinct keys, of FILTER_BITS bits at most; None where that is under LEAST_BITS a key."""
    n = keys.count()
    each = min(MOST_BITS, FILTER_BITS / max(n, 1))
    return url_filter.bloom_level(keys.select(F.col(column).alias("key")), n, seed, each) if each >= LEAST_BITS else None


def _has(level: url_filter.Level, key: Column) -> Column:
    """Whether the filter may hold a key; its bits stand in the plan once, as each copy also goes into the plan's descriptions."""
    bit = lambda p: F.getbit(F.conv(F.hex(F.substring(F.lit(level.bits), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), (p % 8).cast("int")) == 1
    return F.forall(F.array(*level.positions(key)), bit)


def _passing(rows: DataFrame, column: str, level: url_filter.Level | None, costly: bool = False, others: bool = False) -> DataFrame:
    """The rows whose column passes the filter, or the others. costly: exists() makes the column once; a filter that is pushed below it would make it for each bit that is looked up."""
    if not level:
        return rows.limit(0) if others else rows
    found = F.exists(F.array(column), lambda k: _has(level, k)) if costly else _has(level, F.col(column))
    return rows.where(~found if others else found)


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, key, label: the smallest _id of the class of each row; null without words or doc_id."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_of(*document_frequencies(docs)))
    signed = stored(_signatures(docs, idf), "signed")
    worded = signed.where("samples IS NOT NULL AND doc_id IS NOT NULL")
    prints = stored(worded.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("samples").alias("samples"), F.min("bands").alias("bands")).select("key", _id(F.col("doc_id"), F.col("key")).alias("id"), "samples", "bands"), "prints")
    bands = prints.select("id", F.posexplode("bands").alias("band", "bucket"))
    # aggregates are stored before they are joined, so both sides of a join are plain exchanges that can be split
    shared = stored(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # filters of the wanted keys keep most other rows out of the shuffles; without them the joins alone give the same rows
    rows = stored(_passing(bands, "bucket", _level(shared, "bucket", 2)).join(shared, "bucket"), "bucket-rows")  # bucket, id, band, n
    met = stored(rows.groupBy("id").agg(F.sum("n").alias("met")), "met")
    reps = stored(rows.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", F.xxhash64("id").alias("p"), "id")).alias("m")).select("bucket", F.col("m.id").alias("b")), "reps")
    level = _level(met, "id", 1)
    ids = met.select("id")
    prints_met = stored(_passing(prints, "id", level).join(ids, "id", "left_semi"), "met-prints")
    own = docs.where("doc_id IS NOT NULL").select(_id(F.col("doc_id"), _key(F.col("text"))).alias("id"), "text")
    texts = stored(_passing(own, "id", level, costly=True).join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    star = stored(rows.select("bucket", F.col("id").alias("a")).join(reps, "bucket").where("a != b").select("a", "b").distinct(), "star")
    labels = components(_verified(_alike(star, prints_met), texts, idf, least))
    now = rows.where("n > 2").join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("c"))
    links = _across(now, prints_met, texts, idf, least)
    if links.limit(1).count():  # components of components
        of = lambda x, c: labels.select(F.col("id").alias(x), F.col("label").alias(c))
        joined = links.join(of("a", "la"), "a", "left").join(of("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
        further = components(joined).select(F.col("id").alias("label"), F.col("label").alias("further"))
        every = labels.unionByName(further.select(F.col("label").alias("id"), "label").join(labels, "id", "left_anti"))
        labels = stored(every.join(further, "label", "left").select("id", F.coalesce("further", "label").alias("label")), "labels")

    classes = stored(prints.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("label")), "classes")
    known = worded.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "label")
    return known.union(signed.where("samples IS NULL OR doc_id IS NULL").select("doc_id", "key", F.lit(None).cast("binary")))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the class of each document; classes are components of verified pairs."""
    return _classes(docs, least).select("doc_id", F.coalesce(_doc_id(F.col("label")), "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The document of the smallest doc_id of each class, with its own columns; rows without an id all stay.

    Of unlike texts of one doc_id each stays that stands for its class, of rows equal in doc_id and text one.
    """
    kept = _classes(docs, least).where(F.col("doc_id").isNotNull() & (F.col("label").isNull() | (F.col("label") == _id(F.col("doc_id"), F.col("key")))))
    own = docs.where("doc_id IS NOT NULL").withColumn("_text_key", _key(F.col("text")))
    named = own.join(kept.select("doc_id", F.col("key").alias("_text_key")).distinct(), ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return named.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
