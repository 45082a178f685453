"""Removal of long repeats by enhanced suffix arrays over anchors.

The bytes to remove are those of every LENGTH-byte string that starts at two places or more, counted over all texts.
A string's anchor is its smallest hashed GRAM-byte substring, so equal strings have their anchors at equal offsets;
a document's anchors, each with the run of starts that it serves and the bytes they reach (its context), stand for
all its strings. Anchors whose gram occurs once can't repeat. Equal contexts are counted by hash (128 bits with the
gram's) with partial aggregation, so a passage that a third of all documents share costs one row per task. For the
other contexts of a shared gram, a sparse enhanced suffix array is built: the suffixes from the anchors on are
sorted, a stack scan of their common prefixes gives the tree of common-prefix intervals, and for each interval a
second stack scan over the reversed bytes before the anchors tests the diversity of left extensions. The nodes whose
members differ on both sides are the maximal repeats, each with all its occurrences.

A gram with more than GROUP different contexts isn't gathered in one task. Its contexts are halved by start instead:
where all bytes that a range of starts reaches occur twice, all its strings repeat; where the bytes that all of them
share occur once, none does; other ranges are split. Each round counts hashes with partial aggregation, and about
log2(LENGTH) rounds end it: exact, and linear in the contexts.

Edge cases: null text is empty; texts below LENGTH bytes keep all; repeated rows and ids are told apart by row, so
copies count as repeats of each other; matches never cross texts; an empty table gives no rows; extra columns are
ignored. Texts of any length are worked through in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stored, table
from .textual import as_bytes, mix, prefix_sums, window_hash

LENGTH, GRAM, GROUP = 200, 64, 250
#: A context of more than MIN_HOT rows and more than a HOT_PER_TASK-th of a task's share is joined by broadcast.
MIN_HOT, HOT_PER_TASK = 500, 8
_BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def _window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for every i, by running minima forwards and backwards within rows of w."""
    n = len(v)
    rows = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = v
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """By block: gram hashes, anchor positions, and first and last starts that each anchor serves."""
    for base in range(0, max(0, len(data) - length + 1), _BLOCK):
        part = data[base : base + _BLOCK + length - 1]
        if len(part) < length:
            return
        sums = prefix_sums(part)
        n = len(part) - gram + 1
        h = mix(window_hash(sums, np.arange(n), np.arange(gram, gram + n)))
        least = _window_minima((h & ~_LOW) | np.arange(n, dtype=np.uint64), length - gram + 1) & _LOW
        lo = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = least[lo].astype(np.int64)
        hi = np.r_[lo[1:], len(least)] - 1
        yield h[at].view(np.int64), base + at, base + lo, base + hi


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch):
        out: dict[str, list] = {c: [] for c in ("key", "ctx", "rid", "at", "before", "span")}
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = as_bytes(text.as_py())
            if len(data) < length:
                continue
            view = memoryview(data)
            for key, at, lo, hi in anchors(data, length, gram):
                before = at - lo
                out["key"].append(key)
                out["ctx"].append(np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], s) for a, b, s in zip(lo.tolist(), (hi + length).tolist(), before.tolist())), np.uint64, len(lo)).view(np.int64))
                out["rid"].append(np.full(len(at), rid))
                out["at"].append(at)
                out["before"].append(before)
                out["span"].append(hi - lo)
        yield {c: np.concatenate(v) if v else [] for c, v in out.items()}

    return map_rows(docs, run, "key bigint, ctx bigint, rid bigint, at bigint, before int, span int")


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals of two members or more, by one scan with a stack.

    lcp[i] is the common prefix of sorted members i - 1 and i; lcp[0] is unused.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _common(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(contexts: list[tuple[bytes, int]], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of the maximal repeats of least bytes or more about an anchor.

    contexts: (bytes, offset of the anchor). Intervals come from the sorted suffixes behind the anchors; within each,
    intervals of the reversed bytes before them. A node is maximal if its members differ on both sides.
    """
    rights = [c[o:] for c, o in contexts]
    lefts = [c[:o][::-1] for c, o in contexts]
    order = sorted(range(len(contexts)), key=rights.__getitem__)
    lcp = [0] + [_common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    place = sorted(range(len(contexts)), key=lefts.__getitem__)
    rank = {m: i for i, m in enumerate(place)}
    near = [0] + [_common(lefts[a], lefts[b]) for a, b in zip(place, place[1:])]
    most = max(map(len, lefts))
    for right, first, last in lcp_intervals(lcp):
        if right + most < least:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        ranks = [rank[m] for m in members]
        own = [0] + [min(near[a + 1 : b + 1]) for a, b in zip(ranks, ranks[1:])]
        for left, a, b in lcp_intervals(own):
            if left + right >= least and _right_diverse(members[a : b + 1], rights, right):
                yield left, right, members[a : b + 1]


def _right_diverse(members: list[int], rights: list[bytes], right: int) -> bool:
    """Whether the members' next bytes differ, or one of them has none."""
    return len({rights[m][right : right + 1] for m in members}) > 1 or any(len(rights[m]) == right for m in members)


def _intervals(contexts: list[tuple[bytes, int]], least: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of s, bytes between start and anchor, whose strings repeat."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for left, right, members in maximal_repeats(contexts, least):
        for m in members:
            out[m].append((least - right, left))
    return out


def _repeats_in_groups(rows: DataFrame, length: int) -> DataFrame:
    """rid, start, end of what repeats of contexts that occur once; rows: key, cnt, rid, at, before, bytes, by key."""

    def run(batches):
        def spans(group):
            found = _intervals([(g[5], g[4]) for g in group], length)
            return [(g[2], g[3] - hi, g[3] - lo + length) for g, ranges in zip(group, found) if g[1] == 1 for lo, hi in ranges]

        group: list = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cnt", "rid", "at", "before", "bytes"))):
                if group and group[0][0] != row[0]:
                    out += spans(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["rid", "start", "end"])
        if group:
            out = spans(group)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["rid", "start", "end"])

    return rows.select("key", "cnt", "rid", "at", "before", "bytes").mapInArrow(run, "rid bigint, start bigint, end bigint")


def _repeats_by_halving(rows: DataFrame, length: int) -> DataFrame:
    """As _repeats_in_groups, for grams of any number of contexts; rows also has span.

    Ranges of s, the bytes between start and anchor, are halves of [0, length), the same for all contexts, so equal
    ranges of different contexts can be compared; a context takes part in those that hold one of its own starts.
    """
    top = 1
    while top < length:
        top *= 2

    def run(batch):
        """Hashes of all bytes that a range reaches (null unless all its starts are the context's own) and of those that all its strings share."""
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(f.name for f in batch.schema)}
        wide, core = [], []
        for key, before, span, lo, hi, data in zip(c["key"], c["before"], c["span"], c["lo"], c["hi"], c["bytes"]):
            seed = (key + (lo << 32) + hi) & 0xFFFFFFFFFFFFFFFF
            own = before - span <= lo and hi <= before
            wide.append(xxhash.xxh3_128_digest(data[before - hi : before - lo + length], seed) if own else None)
            core.append(xxhash.xxh3_128_digest(data[max(0, before - lo) : before - hi + length], seed) if hi - lo < length else b"")
        yield c | {"wide": wide, "core": core}

    columns = ("key", "cnt", "rid", "at", "before", "span", "bytes")
    schema = "key bigint, cnt bigint, rid bigint, at bigint, before int, span int, bytes binary, lo int, hi int"
    found = rows.sparkSession.createDataFrame([], "rid bigint, start bigint, end bigint")
    todo = rows.select(*columns, F.explode(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(a + top // 2 - 1).alias("hi")) for a in (0, top // 2)))).alias("x"))
    while True:
        meets = (F.col("x.lo") <= F.col("before")) & (F.col("x.hi") >= F.col("before") - F.col("span"))
        hashed = stored(map_rows(todo.where(meets).select(*columns, "x.lo", "x.hi"), run, schema + ", wide binary, core binary"), "halves")
        if not hashed.limit(1).count():
            return found
        twice = lambda c: stored(hashed.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"), F.max("cnt").alias("m")).where("n > 1 OR m > 1").select(c), f"{c}-twice").withColumn(f"{c}_twice", F.lit(True))  # noqa: B023, E731
        known = stored(hashed.join(twice("wide"), "wide", "left").join(twice("core"), "core", "left").where("core_twice"), "halved")
        own = known.where("wide_twice AND cnt = 1").select("rid", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"))
        found = stored(found.union(own), "found")
        # of contexts that agree on a whole range, one stays as what the undecided can repeat
        undecided = known.where("wide_twice IS NULL AND lo < hi")
        agreed = known.where("wide_twice").groupBy("core", "wide").agg(F.min(F.struct("key", "rid", "at", "before", "span", "bytes", "lo", "hi")).alias("s")).select("core", "s.*").withColumn("cnt", F.lit(2).cast("bigint"))
        agreed = agreed.join(undecided.select("core").distinct(), "core", "left_semi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi")))
        todo = undecided.select(*columns, "lo", "hi").union(agreed.select(*columns, "lo", "hi")).select(*columns, F.explode(parts).alias("x"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, start, end: byte spans whose strings of length bytes all repeat; they may overlap. docs: rid, text."""
    rows = stored(_anchor_rows(docs, length, gram), "anchors")
    # aggregates are stored before they are joined, so both sides of a join are plain exchanges that can be split
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    # by document, else one file would hold all rows of a frequent context, and no later exchange could split them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.join(shared, "key").repartition(n, "rid"), "shared-anchors")
    contexts = stored(rows.groupBy("key", "ctx").agg(F.count("*").alias("cnt"), F.min(F.struct("rid", "at", "before", "span")).alias("r")), "contexts")
    open_keys = contexts.groupBy("key").agg(F.count("*").alias("n_ctx"), F.min("cnt").alias("least")).where("n_ctx > 1 AND least = 1").select("key", "n_ctx")
    open_keys = stored(open_keys, "open-keys")
    wanted = contexts.join(open_keys, "key").groupBy(F.col("r.rid").alias("rid")).agg(F.collect_list(F.struct("key", "cnt", "n_ctx", "r.at", "r.before", "r.span")).alias("a"))

    def cut(batch):
        out: dict[str, list] = {c: [] for c in ("key", "cnt", "n_ctx", "rid", "at", "before", "span", "bytes")}
        for rid, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = as_bytes(text.as_py())
            for x in found:
                lo = x["at"] - x["before"]
                for c, v in zip(out, (x["key"], x["cnt"], x["n_ctx"], rid, x["at"], x["before"], x["span"], data[lo : lo + x["span"] + length].tobytes())):
                    out[c].append(v)
        yield out

    known = stored(map_rows(docs.join(wanted, "rid").select("rid", "text", "a"), cut, "key bigint, cnt bigint, n_ctx bigint, rid bigint, at bigint, before int, span int, bytes binary"), "context-bytes")
    small = known.where(F.col("n_ctx") <= GROUP).repartition(n, "key").sortWithinPartitions("key")
    once = _repeats_in_groups(small, length).union(_repeats_by_halving(known.where(F.col("n_ctx") > GROUP), length))
    # a context that would fill a task goes to all of them instead; at most HOT_PER_TASK * n contexts can be that frequent
    hot = max(MIN_HOT, -(-(contexts.agg(F.sum("cnt")).first()[0] or 0) // (HOT_PER_TASK * n)))
    of = lambda where: contexts.where(where).select("key", "ctx")
    heavy = F.broadcast(of(F.col("cnt") > hot))
    copies = rows.join(heavy, ["key", "ctx"]).union(rows.join(heavy, ["key", "ctx"], "left_anti").join(of((F.col("cnt") > 1) & (F.col("cnt") <= hot)), ["key", "ctx"]))
    lo = F.col("at") - F.col("before")
    return once.union(copies.select("rid", lo.alias("start"), (lo + F.col("span") + length).alias("end")))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte spans), kept (remaining bytes) of each document.

    Strings of length bytes that start anywhere else are removed; gram must be below length.
    """
    own = docs.select("doc_id", "text")
    ids = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if ids.limit(1).count():  # rows can't be told apart by their ids: number them
        own = stored(own.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    else:
        own = own.withColumn("rid", F.col("doc_id"))
    spans = repeated_spans(own.select("rid", "text"), length, gram).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batch):
        out: dict[str, list] = {"n_bytes": [], "removed": [], "kept": []}
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs, parts, at = _merged(found), [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            out["n_bytes"].append(len(data))
            out["removed"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(b"".join(parts) + data[at:])
        yield {"doc_id": batch.column(0)} | out

    return map_rows(own.join(spans, "rid", "left").select("doc_id", "text", "spans"), cut, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

