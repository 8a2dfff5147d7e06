"""Merkle manifest of a dataset: a tree of threes per source and one over the sources, every row's proof found by traversal of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, written
from .sharding import crc_table

#: Nodes of a run, levels of a block, and rows of a record batch.
ARITY, LEVELS, BATCH = 3, 7, 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Between a level's left and right siblings, and between levels.
BESIDE, ABOVE = b"|", b";"


def h(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(nodes: int) -> int:
    """Levels until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


class TreeHash:
    """A treehash stack: takes leaves one by one, keeps fewer than ARITY nodes a level, and leaves the nodes of `level` in `top`."""

    def __init__(self, level: int):
        self.level, self.waiting = level, [[] for _ in range(level)]
        self.top: list[bytes] = []

    def push(self, node: bytes, at: int = 0) -> None:
        while at < self.level:
            run = self.waiting[at]
            run.append(node)
            if len(run) < ARITY:
                return
            node, self.waiting[at], at = h(b"".join(run)), [], at + 1
        self.top.append(node)

    def close(self) -> None:
        """No more leaves: runs that are not full become nodes too."""
        for at in range(self.level):
            if run := self.waiting[at]:
                self.waiting[at] = []
                self.push(h(b"".join(run)), at + 1)


def block_root(leaves: Sequence[bytes], levels: int) -> bytes:
    stack = TreeHash(levels)
    for leaf in leaves:
        stack.push(leaf)
    stack.close()
    return stack.top[0]


class _Ahead:
    """The next run of a level, made one leaf at a time."""

    def __init__(self, leaves: Sequence[bytes], level: int, start: int):
        self.leaves, self.at, self.stop = leaves, start, min(start + ARITY ** (level + 1), len(leaves))
        self.stack = TreeHash(level)

    def step(self) -> None:
        if self.at < self.stop:
            self.stack.push(self.leaves[self.at])
            self.at += 1
            if self.at == self.stop:
                self.stack.close()


def traverse(leaves: Sequence[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For leaf after leaf, its authentication path: on each level the siblings to the left and to the right in its run, joined.

    A level holds the nodes of the leaf's run and a stack that makes the next run's, one leaf a step. A level's run lasts as many steps
    as its next one has leaves, so that one is ready when it's needed. Besides the leaves, this holds a few nodes for each pair of levels.
    """
    runs, ahead = [], []
    for level in range(levels):
        first = _Ahead(leaves, level, 0)
        while first.at < first.stop:
            first.step()
        runs.append(first.stack.top)
        ahead.append(_Ahead(leaves, level, ARITY ** (level + 1)))
    for i in range(len(leaves)):
        path, unit = [], 1
        for run in runs:
            spot = i // unit % ARITY
            path.append((b"".join(run[:spot]), b"".join(run[spot + 1 :])))
            unit *= ARITY
        yield path
        unit = ARITY
        for level in range(levels):
            ahead[level].step()
            if (i + 1) % unit == 0:
                runs[level], ahead[level] = ahead[level].stack.top, _Ahead(leaves, level, i + 1 + unit)
            unit *= ARITY


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = h(left + leaf + right)
    return leaf


def _told(path: list[tuple[bytes, bytes]]) -> bytes:
    return ABOVE.join(left + BESIDE + right for left, right in path)


def _read(path: bytes) -> list[tuple[bytes, bytes]]:
    return [tuple(level.split(BESIDE)) for level in path.split(ABOVE)] if path else []


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another, of a partition sorted by tree and block."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batched(rows: Iterator[dict], **kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most BATCH."""
    schema = pa.schema(list(kinds.items()))
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


_TEXT, _NUMBER = pa.string(), pa.int64()


def _levels_of(total: int, levels: int) -> int:
    """What a block climbs: `levels`, or if it is the whole tree, until one node remains."""
    return levels if total > ARITY**levels else height(total)


def field(column: str) -> Column:
    """`-` for null, else the value's UTF-8 bytes, counted, and the value."""
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[str] = FIELDS) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def tampered_leaf(key: str = "doc_id", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf after tampering: where 2 divides the CRC-32 of the key, the text has lost its line breaks; else null."""
    parts = [field(f) if f != "text" else F.coalesce(F.concat(F.octet_length(F.translate(f, "\n", "")).cast("string"), F.lit(":"), F.translate(f, "\n", "")), F.lit("-")) for f in fields]
    hit = (F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return F.when(hit, F.sha2(F.concat(*parts), 256))


def numbered(tables: Tables, nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """nodes (of trees named by `tree`) with idx, their place in the tree by `order`, and total, the tree's nodes.

    The whole table is sorted in ranges, so a large tree lies in many; a range's rows are numbered from the sum of counts before it.
    """
    keys = ["tree", *order]
    placed = tables.write(nodes.repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys]).withColumn("run", F.spark_partition_id()), name)
    counts = placed.groupBy("tree", "run").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "run", before.alias("start"), F.sum("n").over(tree).alias("total"))
    local = F.row_number().over(Window.partitionBy("tree", "run").orderBy(*[F.asc_nulls_first(k) for k in order])) - 1
    return placed.withColumn("local", local).join(starts, ["tree", "run"]).withColumn("idx", F.col("start") + F.col("local")).drop("run", "local", "start")


def _block(levels: int) -> Column:
    return F.expr(f"idx div {ARITY**levels}").alias("block")


def climb(tables: Tables, nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The rounds of a forest: nodes (tree, idx, total, node), the roots of their blocks, the roots of those blocks, until no tree has two.
    Each round has a row for each block of 3**levels of the one before; a tree of one node is in the next round no more."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_blocks() -> Iterator[dict]:
            for rows in _grouped(batches):
                total = rows[0]["total"]
                root = block_root([r["node"].encode() for r in rows], _levels_of(total, levels)).decode()
                yield {"tree": rows[0]["tree"], "idx": rows[0]["block"], "total": -(-total // ARITY**levels), "node": root}

        return _batched(of_blocks(), tree=_TEXT, idx=_NUMBER, total=_NUMBER, node=_TEXT)

    rounds = [nodes]
    while True:
        below = rounds[-1].where("total > 1") if len(rounds) > 1 else rounds[-1]
        blocks = below.select("tree", "idx", "total", "node", _block(levels))
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        rounds.append(tables.write(blocks.mapInArrow(roots, "tree string, idx long, total long, node string"), name))
        if rounds[-1].where("total > 1").isEmpty():
            return rounds


def subroots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, node): each tree's root, from the round in which it is one block."""
    out = rounds[1].where("total = 1")
    for later in rounds[2:]:
        out = out.union(later.where("total = 1"))
    return out.select("tree", "node")


_UPPER = ("path", "subroot", "root")


def _blocks(nodes: DataFrame, above: DataFrame, levels: int, extra: Sequence[str] = ()) -> DataFrame:
    """The rows of blocks after the row that tells what is above each, sorted."""
    own = nodes.select("tree", _block(levels), "idx", "total", "node", *extra)
    upper = above.select("tree", "block", F.lit(-1).cast("long").alias("idx"), *_UPPER)
    return own.unionByName(upper, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, dict, str]]:
    """Each node's row, the row of what is above its block, and its path to the top."""
    for upper, *rows in _grouped(batches):
        tail = upper["path"].encode()
        found = traverse([r["node"].encode() for r in rows], _levels_of(rows[0]["total"], levels)) if rows else ()
        for row, own in zip(rows, found, strict=True):
            yield row, upper, ABOVE.join(p for p in (_told(own), tail) if p).decode()


def descend(tables: Tables, rounds: list[DataFrame], ends: DataFrame, name: str, levels: int) -> DataFrame:
    """(tree, block, path, subroot, root): what is above each block of the first round. ends: (tree, path, subroot, root) of each tree's root."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"tree": row["tree"], "block": row["idx"], "path": path, "subroot": upper["subroot"], "root": upper["root"]} for row, upper, path in _paths(batches, levels))
        return _batched(rows, tree=_TEXT, block=_NUMBER, path=_TEXT, subroot=_TEXT, root=_TEXT)

    first = F.lit(0).cast("long").alias("block")
    above = None
    for i in range(len(rounds) - 1, 0, -1):
        # trees that are one block at round i - 1 end there; the others' blocks are the nodes of round i
        ended = rounds[i].where("total = 1").select("tree").join(ends, "tree").select("tree", first, *_UPPER)
        if above is not None:
            more = _blocks(rounds[i].where("total > 1"), above, levels).mapInArrow(paths, "tree string, block long, path string, subroot string, root string")
            ended = ended.union(more)
        above = tables.write(ended, name)
    return above


def manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Leaves hash doc_id, source, lang, n_chars and text. A source's leaves stand by doc_id (null first; rows of one doc_id by leaf), sources by
    their bytes (null first). Blocks of 3**levels aligned leaves are hashed by treehash stacks to their roots, blocks of roots likewise, and last
    the sources' roots. Then, from the top down, every block is traversed leaf by leaf, and what is above a block, the same for all its leaves, is appended
    to each leaf's path. Tampering deletes a text's line breaks where 2 divides the CRC-32 of the doc_id; a row without one
    isn't tampered with. An empty table has an empty manifest. Texts are read once and never shuffled; other columns are left out.
    """
    with Tables(documents.sparkSession) as tables:
        tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
        leaves = tables.write(documents.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"), tampered_leaf().alias("bad")), "leaves")
        leaves = tables.write(numbered(tables, leaves, ["doc_id", "node"], "sorted"), "numbered")
        tables.drop("leaves", "sorted")
        rounds = climb(tables, leaves.select("tree", "idx", "total", "node"), "roots", levels)
        tops = subroots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node")
        tops = tables.write(numbered(tables, tops, ["key"], "tops"), "sources")
        top_rounds = climb(tables, tops.select("tree", "idx", "total", "node"), "top_roots", levels)
        root = subroots(top_rounds)
        ends = root.select("tree", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
        above = descend(tables, top_rounds, ends, "above_tops", levels)

        def to_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ({"tree": row["key"], "path": path, "subroot": row["node"], "root": upper["root"]} for row, upper, path in _paths(batches, levels))
            return _batched(rows, tree=_TEXT, path=_TEXT, subroot=_TEXT, root=_TEXT)

        ends = tables.write(_blocks(tops, above, levels, ["key"]).mapInArrow(to_sources, "tree string, path string, subroot string, root string"), "ends")
        above = descend(tables, rounds, ends, "above_leaves", levels)

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for upper, *rows in _grouped(batches):
                if not rows:
                    continue
                tail, root = _read(upper["path"].encode()), upper["root"].encode()
                proofs, folded = [], []
                for row, own in zip(rows, traverse([r["node"].encode() for r in rows], _levels_of(rows[0]["total"], levels)), strict=True):
                    path = own + tail
                    proofs.append(h(b"".join(x for level in path for x in level)).decode())
                    folded.append(fold((row["bad"] or row["node"]).encode(), path))
                source = rows[0]["tree"][1:] if rows[0]["tree"] else None
                columns = [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([source] * len(rows), pa.string()), pa.array([r["node"] for r in rows]), pa.array([upper["subroot"]] * len(rows)), pa.array([upper["root"]] * len(rows)), pa.array(proofs), pa.array([f.decode() for f in folded]), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        out = _blocks(leaves, above, levels, ["doc_id", "bad"]).mapInArrow(report, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return written(out, "manifest")


def oracle() -> str:
    """The same by levels: every node of every level, siblings joined level by level, and a recursive fold."""

    def counted(value: str) -> str:
        return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(counted(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, ({crc_table()})[xor(c & 255, b) + 1])), 4294967295)"""
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, source, {hashed("text")} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {hashed("replace(text, chr(10), '')")} END AS bad FROM documents),
placed AS (SELECT *, coalesce('+' || source, '') AS tree, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low AS (SELECT tree, 0 AS lvl, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS total FROM placed
  UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (total + 2) // 3 FROM low WHERE total > 1 GROUP BY tree, lvl, idx // 3, total),
tops AS (SELECT tree AS source_tree, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS total FROM low WHERE total = 1),
high AS (SELECT 0 AS lvl, idx, node, total FROM tops
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (total + 2) // 3 FROM high WHERE total > 1 GROUP BY lvl, idx // 3, total),
steps AS (
  SELECT p.rid, n.lvl AS step, string_agg(n.node, '' ORDER BY n.idx) FILTER (n.idx < p.idx // (3 ** n.lvl)::BIGINT) AS l, string_agg(n.node, '' ORDER BY n.idx) FILTER (n.idx > p.idx // (3 ** n.lvl)::BIGINT) AS r
  FROM placed p JOIN low n ON n.tree = p.tree AND n.total > 1 AND n.idx // 3 = p.idx // (3 ** (n.lvl + 1))::BIGINT GROUP BY p.rid, n.lvl
  UNION ALL
  SELECT p.rid, 1000 + n.lvl, string_agg(n.node, '' ORDER BY n.idx) FILTER (n.idx < t.idx // (3 ** n.lvl)::BIGINT), string_agg(n.node, '' ORDER BY n.idx) FILTER (n.idx > t.idx // (3 ** n.lvl)::BIGINT)
  FROM placed p JOIN tops t ON t.source_tree = p.tree JOIN high n ON n.total > 1 AND n.idx // 3 = t.idx // (3 ** (n.lvl + 1))::BIGINT GROUP BY p.rid, n.lvl),
ranked AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, coalesce(l, '') AS l, coalesce(r, '') AS r FROM steps),
proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS siblings, max(k) AS k FROM ranked GROUP BY rid),
folded AS (SELECT rid, 0::BIGINT AS k, coalesce(bad, leaf) AS node FROM placed
  UNION ALL SELECT f.rid, s.k, sha256(s.l || f.node || s.r) FROM folded f JOIN ranked s ON s.rid = f.rid AND s.k = f.k + 1)
SELECT p.doc_id, p.source, p.leaf, t.node AS subroot, (SELECT node FROM high WHERE total = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.node AS folded_root,
  f.node = (SELECT node FROM high WHERE total = 1) AS verified
FROM placed p JOIN tops t ON t.source_tree = p.tree LEFT JOIN proofs q ON q.rid = p.rid JOIN folded f ON f.rid = p.rid AND f.k = coalesce(q.k, 0)"""
