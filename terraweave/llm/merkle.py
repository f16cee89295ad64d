"""Merkle manifest of a table, and proofs of all its rows by multiproofs.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else byte count,
``:`` and value. Leaves of a group ascend by key (null first, equal keys by leaf);
while several nodes remain, every two consecutive ones become the hash of their
hex digests, a last one alone the hash of its own. The roots of the groups,
ordered by name (null first, bytewise), give the root of the table in the same way.

1. Leaves are sorted by range and packed into runs of one group and at most
   ``RUN`` leaves (``pack``). Run sizes alone are summed to positions, so a group
   that holds most rows is spread over many tasks.
2. Trees grow in aligned blocks of 2^``FAN`` nodes, ``FAN`` levels a round
   (``build``). The node table keeps one packed row per tree, level and block.
3. A run computes which nodes its leaves' proofs need and which of those its own
   leaves do not give (``missing``): the least union over the run, as an octopus
   multiproof. These are fetched once per run by join, at most two a level for a
   run without gaps. The run derives the shared interior nodes from them and
   expands the proof of each leaf (``prove``).

Rows are never grouped by anything but run or block, both bounded. Repeated rows
have equal leaves at places of their own. An empty table has no manifest rows and
no proofs. Null keys and null group names are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from terraweave.llm.store import column_values
from terraweave.session import cut

RUN = 4096  # leaves of a run
FAN = 12  # levels of a block
WIDTH = 32  # bytes of a digest
GROUP, TOP = 0, 1  # kinds of trees


@dataclass(frozen=True)
class Manifest:
    """``nodes``: (kind, tree, level, block, digests); ``trees``: (tree, size, subroot, top_pos, top_size);
    ``runs``: packed leaves with their places."""

    nodes: DataFrame
    trees: DataFrame
    runs: DataFrame


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: Sequence[str], key: str, group: str, changed: Column | None = None,
           claims: Mapping[str, Column] | None = None) -> DataFrame:
    """(tree, key, leaf, claimed): ``claimed`` is the leaf with the columns of ``claims`` replaced where ``changed``."""
    digest = lambda cols: F.unhex(F.sha2(F.concat(*cols).cast("binary"), 256))
    leaf = digest([field(F.col(c)) for c in fields])
    claimed = F.lit(None).cast("binary")
    if changed is not None:
        claimed = F.when(changed, digest([field((claims or {}).get(c, F.col(c))) for c in fields]))
    return docs.select(F.col(group).cast("string").alias("tree"), F.col(key).cast("long").alias("key"),
                       leaf.alias("leaf"), claimed.alias("claimed"))


def pack(rows: DataFrame) -> DataFrame:
    """(run, tree, n, keys, nulls, leaves, claims) in order of tree and key; ``claims`` holds leaf bytes where none is."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            tree, key, leaf, claim = (column_values(batch, c) for c in ("tree", "key", "leaf", "claimed"))
            out, lo = [], 0
            while lo < len(tree):
                hi = lo + 1
                while hi < len(tree) and hi - lo < RUN and tree[hi] == tree[lo]:
                    hi += 1
                part = slice(lo, hi)
                out.append((number, tree[lo], hi - lo, np.array([k or 0 for k in key[part]], "<i8").tobytes(),
                            bytes(k is None for k in key[part]), b"".join(leaf[part]),
                            b"".join(c or x for c, x in zip(claim[part], leaf[part]))))
                number, lo = number + 1, hi
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 ["run", "tree", "n", "keys", "nulls", "leaves", "claims"])

    rows = cut(rows)  # the sample of the range sort reads no texts
    order = ["tree", "key", "leaf"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        runs, "run long, tree string, n long, keys binary, nulls binary, leaves binary, claims binary")


def placed(runs: DataFrame) -> DataFrame:
    """(run, tree, start, size): place of each run's first leaf, and the leaves of its tree."""
    slim = runs.select("run", "tree", "n")
    before = Window.partitionBy("tree").orderBy("run")  # one row per run
    whole = Window.partitionBy("tree")
    return slim.select("run", F.col("tree"), (F.sum("n").over(before) - F.col("n")).alias("start"),
                       F.sum("n").over(whole).alias("size"))


def ranked(roots: DataFrame) -> DataFrame:
    """``roots`` with ``pos``, the rank of ``tree``; counts of key ranges alone are summed in one place."""
    sorted_rows = cut(roots.repartitionByRange("tree").sortWithinPartitions("tree")
                      .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    starts = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return sorted_rows.withColumn("_part", part).join(starts, "_part").withColumn(
        "pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def parents(nodes: list[bytes]) -> list[bytes]:
    """The next level of hex digests."""
    pairs = [sha256(nodes[i] + nodes[i + 1]).hexdigest().encode() for i in range(0, len(nodes) - 1, 2)]
    return pairs + [sha256(nodes[-1]).hexdigest().encode()] if len(nodes) % 2 else pairs


def hexes(packed: bytes) -> list[bytes]:
    raw = packed.hex().encode()
    return [raw[i:i + 2 * WIDTH] for i in range(0, len(raw), 2 * WIDTH)]


def _packed(nodes: list[bytes]) -> bytes:
    return bytes.fromhex(b"".join(nodes).decode())


NODES = "kind int, tree string, level int, block long, size long, digests binary"


def build(pieces: DataFrame, kind: int) -> DataFrame:
    """Node table of the trees in ``pieces``: (tree, start, n, size, digests), any cut of each tree's leaves."""
    def grow(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        tree, block, base, count, size = (first[c] for c in ("tree", "block", "base", "count", "size"))
        rows = sorted(zip(table["at"].to_pylist(), table["piece"].to_pylist()))
        nodes = hexes(b"".join(piece for _, piece in rows))
        out = []
        for height in range(FAN):
            out.append((kind, tree, base + height, block, size, _packed(nodes)))
            if count == 1:
                break
            nodes, count = parents(nodes), -(-count // 2)
        else:
            out.append((kind, tree, base + FAN, block, size, _packed(nodes)))  # goes on as a leaf of the next round
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                    ["kind", "tree", "level", "block", "size", "digests"])

    most = pieces.agg(F.max("size")).first()[0] or 0
    found, base, rest = None, 0, pieces
    while found is None or most > 2 ** (base - 1):  # some tree has more than one node below the new base
        span = 1 << FAN
        end = F.col("start") + F.col("n")
        count = F.ceil(F.col("size") / F.lit(2 ** base)).cast("long")
        spread = rest.withColumn("block", F.explode(F.sequence(
            F.shiftright("start", FAN), F.shiftright(end - 1, FAN)))).withColumn(
            "at", F.greatest(F.col("start"), F.col("block") * span))
        stop = F.least(end, (F.col("block") + 1) * span)
        rows = spread.select(
            "tree", "block", "at", "size", F.lit(base).alias("base"), count.alias("count"),
            F.col("digests").substr(((F.col("at") - F.col("start")) * WIDTH + 1).cast("int"),
                                    ((stop - F.col("at")) * WIDTH).cast("int")).alias("piece"))
        level = cut(rows.groupBy("tree", "block").applyInArrow(grow, NODES))
        base += FAN
        kept = level.where(F.col("level") < base)
        rest = level.where(F.col("level") == base).select(
            "tree", F.col("block").alias("start"), F.lit(1).cast("long").alias("n"), "size", "digests")
        found = kept if found is None else found.unionByName(kept)
    return found


def levels(size: Column) -> Column:
    """Levels above the leaves of a tree."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def manifest(rows: DataFrame) -> Manifest:
    """Manifest of ``leaves``."""
    runs = cut(pack(rows))
    places = cut(placed(runs))
    pieces = runs.join(places.select("run", "start", "size"), "run").select("tree", "start", "n", "size", F.col("leaves").alias("digests"))
    low = build(pieces, GROUP)
    subroots = low.where(F.col("level") == levels(F.col("size"))).select("tree", "size", F.col("digests").alias("subroot"))
    trees = ranked(subroots)
    n_trees = cut(trees.agg(F.count(F.lit(1)).alias("top_size")))
    trees = cut(trees.select("tree", "size", "subroot", F.col("pos").alias("top_pos"),
                             n_trees.select("top_size").scalar().alias("top_size")))
    top = build(trees.select(F.lit(None).cast("string").alias("tree"), F.col("top_pos").alias("start"),
                             F.lit(1).cast("long").alias("n"), F.col("top_size").alias("size"),
                             F.col("subroot").alias("digests")), TOP)
    own = runs.join(places.drop("tree"), "run")
    full = own.join(trees.select(F.col("tree").alias("_tree"), "top_pos", "top_size"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    return Manifest(low.unionByName(top), trees, full)


def missing(known: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the least set of nodes that give, with the leaves at ``known``, all their proofs."""
    known, level = np.unique(known), 0
    while size > 1:
        beside = known ^ 1
        yield level, np.setdiff1d(beside[beside < size], known)
        known, size, level = np.unique(known >> 1), -(-size // 2), level + 1


def _requests(runs: DataFrame) -> DataFrame:
    """(run, kind, tree, level, place): what each run fetches, the roots of its tree and of the table included."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, tree, n, start, size, top_pos, top_size in zip(*(column_values(batch, c) for c in (
                    "run", "tree", "n", "start", "size", "top_pos", "top_size"))):
                for kind, name, known, count in ((GROUP, tree, np.arange(start, start + n), size),
                                                 (TOP, None, np.array([top_pos]), top_size)):
                    out += [(run, kind, name, level, int(i)) for level, need in missing(known, count) for i in need]
                    out.append((run, kind, name, (count - 1).bit_length(), 0))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [
                pa.nulls(0, t) for t in kinds], ["run", "kind", "tree", "level", "place"])

    return runs.select("run", "tree", "n", "start", "size", "top_pos", "top_size").mapInArrow(
        ask, "run long, kind int, tree string, level int, place long")


def fetch(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, fetched): the digests of each run's requests."""
    height = FAN - F.col("level") % FAN
    asked = requests.withColumn("block", F.expr(f"shiftright(place, {FAN} - level % {FAN})"))
    store = nodes.select(*[F.col(c).alias(f"_{c}") for c in ("kind", "tree", "level", "block")], "digests")
    same = F.col("tree").eqNullSafe(F.col("_tree"))
    for c in ("kind", "level", "block"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    inside = F.col("place") - F.col("block") * F.pow(F.lit(2.0), height).cast("long")
    digest = F.col("digests").substr((inside * WIDTH + 1).cast("int"), F.lit(WIDTH))
    return asked.join(store, same).groupBy("run").agg(
        F.collect_list(F.struct("kind", "level", "place", digest.alias("digest"))).alias("fetched"))


def climb(known: dict[int, bytes], fetched: dict[tuple[int, int], bytes], size: int) -> tuple[bytes, list[dict[int, bytes]]]:
    """Root and, per level, all nodes that the leaves ``known`` and ``fetched`` give."""
    every, level, here = [], 0, sorted(known)
    while size > 1:
        nodes = dict(known)
        for i in here:
            if i ^ 1 < size and i ^ 1 not in nodes:
                nodes[i ^ 1] = fetched[level, i ^ 1]
        every.append(nodes)
        above = {}
        for i in here:
            if i >> 1 not in above:
                left = i & ~1
                above[i >> 1] = sha256(nodes[left] + nodes.get(left + 1, b"")).hexdigest().encode()
        known, here, size, level = above, list(above), -(-size // 2), level + 1
    return known[0], every


def siblings(place: int, every: list[dict[int, bytes]]) -> list[tuple[bool, bytes]]:
    """(is it on the left, digest or empty) of the nodes beside the path of one leaf, level by level."""
    out = []
    for nodes in every:
        out.append((bool(place & 1), nodes.get(place ^ 1, b"")))
        place >>= 1
    return out


def fold(leaf: bytes, path: list[tuple[bool, bytes]]) -> bytes:
    """The root that a leaf and the nodes beside its path give."""
    for left, other in path:
        leaf = sha256(other + leaf if left else leaf + other).hexdigest().encode()
    return leaf


def prove(found: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, digests in hex.

    ``subroot`` and ``root`` are those of the manifest. ``folded_root`` is what the claimed leaf, or else the leaf, gives
    with the fetched and derived nodes beside its path; ``verified`` says whether that is the root.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("n", "start", "size", "top_pos", "top_size", "keys", "nulls", "leaves", "claims", "fetched")
            for row in zip(*(column_values(batch, c) for c in names)):
                n, start, size, top_pos, top_size, keys, nulls, own, claims, nodes = row
                got = {(x["kind"], x["level"], x["place"]): x["digest"].hex().encode() for x in nodes}
                tree, top = ({k[1:]: v for k, v in got.items() if k[0] == kind} for kind in (GROUP, TOP))
                subroot, root = tree[(size - 1).bit_length(), 0], top[(top_size - 1).bit_length(), 0]
                leaf, claim = hexes(own), hexes(claims)
                derived, every = climb(dict(enumerate(leaf, start)), tree, size)
                whole, above = climb({top_pos: derived}, top, top_size)
                end = siblings(top_pos, above)
                proofs, folded = [], []
                for i in range(n):
                    path = siblings(start + i, every) + end
                    proofs.append(sha256(b"".join([x for _, x in path])).hexdigest())
                    folded.append(whole if claim[i] == leaf[i] else fold(claim[i], path))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(nulls, bool)),
                    *(pa.array([x.decode() for x in c]) for c in (leaf, [subroot] * n, [root] * n)), pa.array(proofs),
                    pa.array([x.decode() for x in folded]), pa.array([x == root for x in folded])],
                    ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    answers = fetch(_requests(found.runs), found.nodes)
    return found.runs.join(answers, "run").mapInArrow(
        expand, "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
