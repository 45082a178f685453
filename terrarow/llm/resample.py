"""Importance resampling of a corpus towards a target's distribution of n-grams.

A text's features are its runs of 1 to n words, each hashed into one of BUCKETS. A bucket's gain is the logarithm of its
share in the target over that in the corpus, a document's weight the mean gain of its features, its score the weight
plus Gumbel noise drawn from its id, so that the highest scores are a sample without replacement.

Features of a slice of texts are found by a suffix array over word ids, sorted to n words: neighbours with a common
prefix of m words or more form the runs of one n-gram of m words, which is hashed once and whose bucket is scattered
back to all its occurrences. Runs stay within a task's slice. Counts by bucket are added up in each task before they
are shuffled; counts, gains and scores cover every row. Drawn rows are found by their number in a range-sorted order.

Edge cases: null and empty texts have no features and weight 0, and are never drawn, like all texts of fewer than
LEAST_WORDS words; rows without a doc_id draw their noise from an empty id; rows that share a doc_id share their noise,
and of equal scores the smaller doc_id (none last), then the one of fewer features goes first; an empty corpus gives no
rows, an empty target counts of 0; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, SLICE_BYTES, map_rows, stored, table
from .merkle import CRC, CRC_TABLE
from .numbering import numbered

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10


def _word_bytes() -> bytes:
    """For each byte: itself in words (digits, letters in lower case, all bytes beyond ASCII), else a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


_WORD_BYTES = _word_bytes()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of all texts in a row, the number of words before each text and in all, and the words by id."""
    known = _Vocabulary()
    of_text = [np.fromiter(map(known.__getitem__, (t or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()), np.int32) for t in texts]
    return np.concatenate([np.zeros(0, np.int32), *of_text]), np.cumsum([0, *map(len, of_text)]), list(known)


def suffix_array(ids: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the words from there on, depth at most and within the text; common prefix with the one before."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(ids))
    keys = [np.where(place + j < ends, ids[np.minimum(place + j, len(ids) - 1)], -1) for j in range(depth)]
    order = np.argsort(keys[0], kind="stable") if depth == 1 else np.lexsort(keys[::-1])
    prefix = np.zeros(len(ids), np.int64)
    equal = np.ones(max(len(ids) - 1, 0), bool)
    for k in keys:
        k = k[order]
        equal &= (k[1:] == k[:-1]) & (k[1:] >= 0)
        prefix[1:] += equal
    return order, prefix


def features(texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, and the number of words of each text."""
    ids, bounds, words = word_ids(texts)
    n_words = np.diff(bounds)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    order, prefix = suffix_array(ids, bounds, longest)
    left = np.repeat(bounds[1:], n_words) - np.arange(len(ids))  # words from a place to its text's end
    text = np.repeat(np.arange(len(texts)), n_words)
    found_text, found = [], []
    for m in range(1, longest + 1):
        run = np.cumsum(prefix < m) - 1
        whole = left[order] >= m
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        hashed = np.array([zlib.crc32(b" ".join([words[i] for i in ids[p : p + m].tolist()])) % buckets if full else -1 for p, full in zip(order[heads].tolist(), whole[heads].tolist())], np.int64)
        bucket = np.empty(len(ids), np.int64)
        bucket[order] = hashed[run]
        there = left >= m
        found_text.append(text[there])
        found.append(bucket[there])
    return np.concatenate(found_text), np.concatenate(found), n_words


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (column text) in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                total += np.bincount(features(batch.column(0).slice(at, step).to_pylist(), longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the corpus, both smoothed; floored."""
    t, s, buckets = target.astype(float), corpus.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        text, bucket, n_words = features(batch.column(1).to_pylist(), longest, len(shared.value))
        n = np.bincount(text, minlength=batch.num_rows)
        total = np.zeros(batch.num_rows, np.int64)
        np.add.at(total, text, shared.value[bucket])
        yield {"doc_id": batch.column(0), "n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(target, longest, buckets), bucket_counts(docs, longest, buckets))
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((uniform + 0.5) / 4294967296))).cast("bigint")
    scored = stored(weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise).withColumn("long_enough", F.col("n_words") >= least_words), "scored")
    ranked = numbered(scored, ["long_enough"], [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"], "ranked")
    drawn = F.col("long_enough") & (F.col("nth") < F.floor(F.col("of") * percent / 100))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("nth") + 1).alias("rank"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH crc AS {CRC_TABLE},
words AS (SELECT rowid AS place, doc_id, coalesce({_WORDS}, []) AS words FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
each_word AS (SELECT place, unnest(words) AS word FROM words),
aim AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
bucket AS (SELECT word, {CRC.format(b="list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || hex(word)[i : i + 1])::BIGINT)")} % 10000 AS b
    FROM (SELECT word FROM each_word UNION SELECT word FROM aim), crc),
have AS (SELECT b, count(*) AS s FROM each_word JOIN bucket USING (word) GROUP BY b),
want AS (SELECT b, count(*) AS t FROM aim JOIN bucket USING (word) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM have) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM want), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM have LEFT JOIN want USING (b)),
weighed AS (SELECT place, count(*) AS n, sum(g)::BIGINT AS g FROM each_word JOIN bucket USING (word) JOIN gain USING (b) GROUP BY place),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
    coalesce(floor(g / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weighed USING (place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS nth,
    count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= total * 10 // 100 THEN nth END AS rank FROM ranked
"""
