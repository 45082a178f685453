"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over their roots, proofs of every row.

A row's leaf is the digest of its columns. Leaves are numbered within their group without gathering it (numbering.py).
Each partition folds the leaves it holds into a sparse forest: unresolved nodes keyed by tree, level and index. Forests
form a monoid: a merge joins two forests' nodes, and whenever the siblings of a run, whose number follows from the
tree's size, are all there, they give way to their parent. treeReduce merges the partitions' forests on the executors.
The nodes of level chunk_level and above stay beside it as the spine; that level grows with the table, so that they are
CHUNKS and one for each seven of them at most (each tree's rounded-up ends apart, of trees that have more than a chunk).
Trees of a chunk or less never reach the forest. Proofs are then made chunk by chunk: a chunk's own nodes and the spine
give each leaf the siblings on its way to the root.

Edge cases: null columns are leaves' `-`; a null group is a group, and the first; rows without a key come first in their
group, then equal keys in the order of their leaves; equal rows are a leaf each; an empty table has no rows and no
root; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .numbering import numbered

ARITY = 8
#: Chunks of a table, at most about (its spine is in the driver's memory), and the least level at which chunks are rooted.
CHUNKS, LEAST_LEVEL = 1 << 17, 3
#: Columns of a document's leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a batch that a proof task gives out: each holds some kilobytes of siblings.
_GIVEN = 1024
PROOF = "array<struct<left:string,right:string>>"


def _h(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes on a level of a tree of so many leaves."""
    return -(-leaves // ARITY**level)


class Forest:
    """Sparse forest: open runs of unresolved nodes, and kept nodes from level keep on; roots are always kept."""

    def __init__(self, keep: int):
        self.keep = keep
        self.open: dict[tuple[str, int, int, int], dict[int, str]] = {}
        self.kept: dict[tuple[str, int, int], str] = {}

    def add(self, tree: str, leaves: int, level: int, index: int, node: str) -> None:
        """Take a node in, and the parents that it completes."""
        while True:
            across = width(leaves, level)
            if level >= self.keep or across == 1:
                self.kept[tree, level, index] = node
            if across == 1:
                return
            parent = index // ARITY
            key = tree, leaves, level, parent
            run = self.open.setdefault(key, {})
            run[index] = node
            if len(run) < min(ARITY, across - ARITY * parent):
                return
            del self.open[key]
            node = _h("".join(run[i] for i in sorted(run)))
            level, index = level + 1, parent

    def merge(self, other: Forest) -> Forest:
        """Both forests' nodes in one; associative and commutative."""
        if len(self.open) + len(self.kept) < len(other.open) + len(other.kept):
            return other.merge(self)
        self.kept.update(other.kept)
        for (tree, leaves, level, _), run in other.open.items():
            for index, node in run.items():
                self.add(tree, leaves, level, index, node)
        return self


def leaf(columns: dict[str, Column]) -> Column:
    """Hex digest of the columns' values: `-` for null, else byte count, `:` and value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns.values()]), 256)


def chunk_level(leaves: int) -> int:
    """The least level with at most CHUNKS nodes."""
    level = LEAST_LEVEL
    while leaves > CHUNKS * ARITY**level:
        level += 1
    return level


def spine(ranked: DataFrame, level: int) -> dict[tuple[str, int, int], str]:
    """Digests by (tree, level, index) of all nodes from the given level on, of trees of more than a chunk."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(level)
        for b in batches:
            for tree, of, nth, node in zip(*(b.column(i).to_pylist() for i in range(4))):
                forest.add(tree, of, 0, nth, node.hex())
        yield pa.RecordBatch.from_pydict({"forest": pa.array([pickle.dumps(forest)], pa.binary())})

    forests = ranked.filter(F.col("of") > ARITY**level).select("tree", "of", "nth", "leaf").mapInArrow(fold, "forest binary").rdd
    if not forests.getNumPartitions():
        return {}
    return forests.map(lambda r: pickle.loads(r.forest)).treeReduce(Forest.merge).kept


def subroots(ranked: DataFrame, nodes: dict, level: int) -> DataFrame:
    """tree, root: of every tree, from the spine or, for those of a chunk or less, from their leaves."""

    def small(group: pa.Table) -> pa.Table:
        forest, (tree, of) = Forest(1 << 30), (group["tree"][0].as_py(), group["of"][0].as_py())
        for nth, node in zip(group["nth"].to_pylist(), group["leaf"].to_pylist()):
            forest.add(tree, of, 0, nth, node.hex())
        ((_, root),) = forest.kept.items()
        return pa.table({"tree": [tree], "root": [root]})

    of_small = ranked.filter(F.col("of") <= ARITY**level).select("tree", "of", "nth", "leaf").groupBy("tree").applyInArrow(small, "tree string, root string")
    tops: dict[str, tuple[int, str]] = {}
    for (tree, at, _), node in nodes.items():
        tops[tree] = max(tops.get(tree, (-1, "")), (at, node))
    return of_small.unionByName(ranked.sparkSession.createDataFrame([(t, r) for t, (_, r) in tops.items()], "tree string, root string"))


def _proofs(ranked: DataFrame, nodes: dict, level: int, above: DataFrame | None) -> DataFrame:
    """ranked with subroot, root and proof; above: tree, root, proof of the trees' roots in the tree over them."""
    size = ARITY**level
    chunked = ranked.withColumn("chunk", F.floor(F.col("nth") / size).cast("bigint"))
    # what stands above a tree goes with the first leaf of each chunk only
    first = F.col("nth") % size == 0
    bare = chunked.filter(~first).withColumn("above", F.lit(None).cast(PROOF)).withColumn("root", F.lit(None).cast("string"))
    if above is None:
        heads = chunked.filter(first).withColumn("above", F.array().cast(PROOF)).withColumn("root", F.lit(None).cast("string"))
    else:
        heads = chunked.filter(first).join(above.select("tree", F.col("proof").alias("above"), "root"), "tree")
    dealt = heads.unionByName(bare).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "nth")
    payload = [c for c in ranked.columns if c not in ("tree", "of", "nth", "leaf")]
    shared = ranked.sparkSession.sparkContext.broadcast(nodes)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in payload] + ["tree string", "of bigint", "nth bigint", "leaf string", "subroot string", "root string", f"proof {PROOF}"])

    def proven(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, of, nth0 = (chunk[c][0].as_py() for c in ("tree", "of", "nth"))
        top, root = chunk["above"][0].as_py(), chunk["root"][0].as_py()
        nodes, at, start = shared.value, 0, nth0
        levels = [[x.hex() for x in chunk["leaf"].to_pylist()]]
        runs: list[list[str]] = []  # of each level: its runs of siblings, joined
        while at < level and width(of, at) > 1:
            row = levels[-1]
            runs.append(["".join(row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
            levels.append([_h(r) for r in runs[-1]])
            at, start = at + 1, start // ARITY
        upper, node = [], levels[-1][0]
        while (across := width(of, at)) > 1:
            own = start // ARITY * ARITY
            run = [nodes[tree, at, i] for i in range(own, min(own + ARITY, across))]
            upper.append({"left": "".join(run[: start - own]), "right": "".join(run[start - own + 1 :])})
            node, at, start = nodes.get((tree, at + 1, start // ARITY)), at + 1, start // ARITY
        upper += top
        for a in range(0, chunk.num_rows, _GIVEN):
            part, proofs = chunk.slice(a, _GIVEN), []
            for i in range(a, a + part.num_rows):
                proof = []
                for of_level in runs:
                    run, cut = of_level[i // ARITY], 64 * (i % ARITY)
                    proof.append({"left": run[:cut], "right": run[cut + 64 :]})
                    i //= ARITY
                proofs.append(proof + upper)
            columns = [part[c].combine_chunks() for c in (*payload, "tree", "of", "nth")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            given = [*columns, pa.array(levels[0][a : a + part.num_rows]), *(pa.array([x] * part.num_rows, pa.string()) for x in (node, root or node)), pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]
            yield pa.RecordBatch.from_arrays(given, names=[*payload, "tree", "of", "nth", "leaf", "subroot", "root", "proof"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one chunk
        key = None
        for b in batches:
            trees, chunks = b.column("tree").to_pylist(), b.column("chunk").to_pylist()
            cuts = [i for i in range(1, b.num_rows) if chunks[i] != chunks[i - 1] or trees[i] != trees[i - 1]]
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if held and key != (trees[i], chunks[i]):
                    yield from proven(pa.Table.from_batches(held))
                    held = []
                key = trees[i], chunks[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from proven(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, run: F.sha2(F.concat(run["left"], h, run["right"]), 256))


def siblings(proof: Column) -> Column:
    """Hex digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def manifest(leaves: DataFrame, order: list[str], level: int | None = None) -> DataFrame:
    """leaves (tree, leaf as 32 bytes, further columns) with nth, of, subroot, root and proof.

    tree must not be null; trees stand in bytewise order of it, leaves in that of the order columns. level: that of the
    chunks, for tests.
    """
    ranked = numbered(stored(leaves, "leaves"), ["tree"], [*order, "leaf"], "numbered")
    level_of = lambda df: level or chunk_level(df.count())
    at = level_of(ranked)
    nodes = spine(ranked, at)
    roots = stored(subroots(ranked, nodes, at).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("leaf")), "subroots")
    ranked_roots = numbered(roots, ["tree"], ["name"], "numbered-roots")
    at_top = level_of(ranked_roots)
    above = _proofs(ranked_roots, spine(ranked_roots, at_top), at_top, None).select(F.col("name").alias("tree"), "root", "proof")
    return _proofs(ranked, nodes, at, stored(above, "roots"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, leaf, doc_id and, where 3 divides crc32(doc_id), the leaf of the text with A-Z lower-cased."""
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = columns | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    # null first, then by bytes
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.unhex(leaf(columns)).alias("leaf"), "doc_id", F.when(hit, leaf(tampered)).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id"])
    found = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of the bytes in the list b, by the byte table t.
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE crc AS {CRC_TABLE},
field AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, text, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    {CRC.format(b="list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)")} AS code FROM documents, crc),
hashed AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf, code FROM field),
ranked AS (SELECT *, CASE WHEN code % 3 = 0 THEN low_leaf ELSE leaf END AS given,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
tier AS (SELECT tree, 0 AS level, idx // 8 AS parent, list(leaf ORDER BY idx) AS run FROM ranked GROUP BY ALL
    UNION ALL SELECT tree, level + 1, parent // 8, list(sha256(array_to_string(run, '')) ORDER BY parent) FROM
        (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM tier) WHERE n > 1 GROUP BY tree, level, parent // 8),
one AS (SELECT tree FROM ranked GROUP BY tree HAVING count(*) = 1),
subs AS (SELECT tree, CASE WHEN tree IN (FROM one) THEN run[1] ELSE sha256(array_to_string(run, '')) END AS subroot,
    row_number() OVER (ORDER BY encode(tree)) - 1 AS idx FROM
    (SELECT tree, arg_max(run, level) AS run FROM tier GROUP BY tree)),
high AS (SELECT 0 AS level, idx // 8 AS parent, list(subroot ORDER BY idx) AS run FROM subs GROUP BY ALL
    UNION ALL SELECT level + 1, parent // 8, list(sha256(array_to_string(run, '')) ORDER BY parent) FROM
        (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, parent // 8),
top AS (SELECT CASE WHEN (SELECT count(*) FROM subs) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS root
    FROM high ORDER BY level DESC LIMIT 1),
fold AS (SELECT doc_id, tree, leaf, given AS h, idx, 0 AS level, '' AS proof FROM ranked
    UNION ALL SELECT f.doc_id, f.tree, f.leaf, CASE WHEN len(run) = 1 AND f.tree IN (FROM one) THEN f.h ELSE sha256(array_to_string(list_concat(run[:f.idx % 8], [f.h], run[f.idx % 8 + 2:]), '')) END,
        f.idx // 8, f.level + 1, f.proof || array_to_string(list_concat(run[:f.idx % 8], run[f.idx % 8 + 2:]), '')
        FROM fold f JOIN tier t ON t.tree = f.tree AND t.level = f.level AND t.parent = f.idx // 8),
lower_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY level DESC) AS k FROM fold),
mid AS (SELECT l.doc_id, l.tree, l.leaf, l.h, s.idx, 0 AS level, l.proof, s.subroot FROM lower_ l JOIN subs s USING (tree) WHERE k = 1),
up AS (SELECT * FROM mid
    UNION ALL SELECT u.doc_id, u.tree, u.leaf, CASE WHEN (SELECT count(*) FROM subs) = 1 THEN u.h ELSE sha256(array_to_string(list_concat(run[:u.idx % 8], [u.h], run[u.idx % 8 + 2:]), '')) END,
        u.idx // 8, u.level + 1, u.proof || array_to_string(list_concat(run[:u.idx % 8], run[u.idx % 8 + 2:]), ''), u.subroot
        FROM up u JOIN high t ON t.level = u.level AND t.parent = u.idx // 8)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM up, top QUALIFY row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY level DESC) = 1
"""
