"""A Merkle manifest of a table: leaves, proofs and their verification.

A row's leaf is the digest of its fields. Per group (a language) the leaves, ordered by id, are
the lowest level of a tree whose nodes digest ``FAN`` consecutive nodes of the level below; the
groups' subroots, ordered by group, are the lowest level of the tree that gives the root.

The leaves' places come from one range exchange and the counts of its partitions. Blocks of
``BLOCK`` leaves are reduced in tasks, each to one node. When no more than ``TOP`` nodes are left
(else blocks of nodes are reduced in the same way), the driver builds the small top tree and
broadcasts for each of its lowest nodes the path to the root; tasks finish the proofs of a
block's leaves with it and fold every row up to a root of its own. Texts are read once and never
shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.joins import matched
from lodestone.llm.common import dropped, small_batches, written

FAN, DEPTH = 8, 4
#: Leaves of a block, and most nodes whose paths the driver broadcasts (a path is about 1.5 KB).
BLOCK, TOP = FAN**DEPTH, 4096
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(fields: list[Column]) -> Column:
    """Lower-case hex digest of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]), 256)


def digest(parts: list[bytes]) -> bytes:
    """Digest of hex digests, as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The nodes of each level, up to a single node or ``most`` levels above the first."""
    out = [nodes]
    while (len(out[-1]) > 1) if most is None else (len(out) <= most):
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def path(tree: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """Per level what stands left and right of a node's place in its run, from below up to the tree's last level."""
    out = []
    for level in tree[:-1]:
        run, k = level[at // FAN * FAN : at // FAN * FAN + FAN], at % FAN
        out.append((b"".join(run[:k]), b"".join(run[k + 1 :])))
        at //= FAN
    return out


def folded(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its proof lead to."""
    for left, right in steps:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _height(n: int) -> int:
    """Levels above ``n`` nodes up to a single one."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _reduced(blocks: DataFrame) -> DataFrame:
    """One node per block: ``grp, i, n, node``; ``n`` is the count of the group's nodes on that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            nodes = [levels([x.hex().encode() for x in own], min(DEPTH, _height(n)))[-1][0] for own, n in zip(d["nodes"], d["n"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-n // BLOCK) for n in d["n"]], pa.int64()), pa.array([bytes.fromhex(x.decode()) for x in nodes], pa.binary())], names=["grp", "i", "n", "node"])

    return blocks.select("grp", "block", "n", "nodes").mapInArrow(run, "grp string, i long, n long, node binary")


def _top(rows: list) -> tuple[list[tuple], bytes]:
    """(group, i, steps to the root as hex strings, subroot) of the top tree's lowest nodes, and the root."""
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r.grp is not None, (r.grp or "").encode("utf-8", "surrogatepass"), r.i)):
        groups.setdefault(r.grp, []).append(bytes(r.node).hex().encode())
    trees = {g: levels(nodes) for g, nodes in groups.items()}
    upper = levels([t[-1][0] for t in trees.values()]) if trees else [[b""]]
    out = []
    for place, (g, tree) in enumerate(trees.items()):
        last = path(upper, place)
        for i in range(len(tree[0])):
            out.append((g, i, [x.decode() for step in path(tree, i) + last for x in step], tree[-1][0].decode()))
    return out, upper[-1][0]


def _steps(flat: list[str]) -> list[tuple[bytes, bytes]]:
    return [(flat[k].encode(), flat[k + 1].encode()) for k in range(0, len(flat), 2)]


def _paths_below(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of the nodes in the blocks, from the paths of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tree = levels([x.hex().encode() for x in r["nodes"]], min(DEPTH, _height(r["n"])))
                made = [[x.decode() for step in path(tree, at) for x in step] + r["steps"] for at in range(len(tree[0]))]
                n, first = len(made), r["block"] * BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["grp"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(made, pa.list_(pa.string())), pa.array([r["subroot"]] * n, pa.string())],
                    names=["grp", "block", "steps", "subroot"],
                )

    return matched(blocks, paths, ["grp", "block"]).select("grp", "block", "n", "nodes", "steps", "subroot").mapInArrow(run, "grp string, block long, steps array<string>, subroot string")


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", candidate: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """Per row: its leaf, subroot, root and proof's digest, and the root that its present state folds to.

    ``candidate`` is the leaf of a row's present state (see :func:`leaf`), null where nothing has
    changed; it is folded with the siblings of the tree of the original leaves, and ``verified``
    says whether that gives the root. ``with_proofs`` adds ``proof``, per level the hex digests
    left and right of the node. Rows of one id come by leaf, repeated rows one after the other,
    null ids first; a null group is a group and comes first. Nulls in fields are ``-``, so null
    and empty texts differ. Texts may be of any length; further columns count only if they are
    among ``columns``; no rows give no rows. Distinct groups' subroots are held by the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = leaf([F.col(c) for c in columns])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp"), F.unhex(own).alias("leaf"), F.unhex(candidate if candidate is not None else F.lit(None).cast("string")).alias("now"))
    # the number keeps repeated rows apart, so that no range is one key
    rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "leaves")
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("no")]
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "doc_id", "leaf", "now", F.monotonically_increasing_id().alias("at")), "ordered-leaves")
    dropped(rows)
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k")).toPandas()  # a row per partition and group
    counts = counts.sort_values("first")
    key = counts["grp"].map(lambda g: (g is not None, g))
    counts["before"] = counts.groupby(key)["k"].cumsum() - counts["k"]
    counts["n"] = counts.groupby(key)["k"].transform("sum")
    offsets = spark.createDataFrame([(r.grp, int(r.part), int(r.before - r.first), int(r.n)) for r in counts.itertuples()], "grp string, part long, shift long, n long")
    placed = matched(ordered.withColumn("part", part), offsets, ["grp", "part"]).withColumn("i", F.col("at") + F.col("shift"))
    member = F.struct("i", "doc_id", "leaf", "now")
    blocks = placed.groupBy("grp", F.floor(F.col("i") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(member)).alias("m"))
    blocks = written(blocks.select("grp", "block", "n", F.col("m.doc_id").alias("ids"), F.col("m.leaf").alias("nodes"), F.col("m.now").alias("now")), "leaf-blocks")
    dropped(ordered)

    nodes, above = written(_reduced(blocks), "nodes"), []
    while nodes.count() > TOP and nodes.where("n > 1").limit(1).count():
        upper = nodes.groupBy("grp", F.floor(F.col("i") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("m"))
        above.append(written(upper.select("grp", "block", "n", F.col("m.node").alias("nodes")), "node-blocks"))
        nodes = written(_reduced(above[-1]), "nodes")
    made, root = _top(nodes.collect())
    paths = spark.createDataFrame(made, "grp string, block long, steps array<string>, subroot string")
    if len(made) <= TOP:
        paths = F.broadcast(paths)
    for upper in reversed(above):
        paths = _paths_below(upper, paths)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()] + [pa.list_(pa.string())] * with_proofs
        names = [x.split()[0] for x in OUT.split(", ")] + ["proof"] * with_proofs
        for b in batches:
            for r in b.to_pylist():
                leaves = [x.hex().encode() for x in r["nodes"]]
                tree, last, subroot = levels(leaves, min(DEPTH, _height(r["n"]))), _steps(r["steps"]), r["subroot"]
                out = []
                for at, (doc, own, now) in enumerate(zip(r["ids"], leaves, r["now"], strict=True)):
                    steps = path(tree, at) + last
                    flat = [x for step in steps for x in step]
                    end = folded(own if now is None else now.hex().encode(), steps)
                    out.append((doc, own.decode(), subroot, root.decode(), digest(flat).decode(), end.decode(), end == root, *([[x.decode() for x in flat]] if with_proofs else [])))
                for k in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1024], strict=True), types, strict=True)], names=names)

    schema = OUT + (", proof array<string>" if with_proofs else "")
    return matched(blocks, paths, ["grp", "block"]).select("ids", "nodes", "now", "n", "steps", "subroot").mapInArrow(finish, schema)
