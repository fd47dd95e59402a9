"""The trie of conversations' prefixes, as succinct level-order tries of shards.

A turn becomes a label: 16 bytes of the SHA-256 of its role and text, and the number of its
code points. A conversation's path is its labels in a row, so texts stay where they are read and
20 bytes a turn go on. Equal paths are one row with their count, combined on the way, before any
trie is built: a conversation that a third of all rows repeat is one path.

Distinct paths in the order of their bytes are cut into shards of some SHARD_BYTES, each a run
of that order, whatever prefix it lies under, so a first turn that all share is spread like any
other. numpy makes of a shard's sorted paths the level-order (LOUDS) bitvector and label arrays;
parents are ranks in the bitvector, and sums over subtrees are added from the last level up
(``add.at`` on the parents).

Only nodes above a border between two shards lie in both: the common prefix of the last path
before it and the first one after. These heavy upper levels are merged separately. A shard knows
how long its common prefixes with its neighbours are; a node counts as its own in the first shard
that has it, and so every figure of a shared node is a sum (or least) over shards. There are
at most two times a path's length of them a shard. Their merged ids go back to the shards, so
that the children of a node that all shards share find their parent among their shard's rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

#: Bytes of a label: a digest and a length.
DIGEST, LABEL = 16, 20
SHARD_BYTES = 2 << 20
#: Ids that are joined before the ends of a node meet.
BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- one shard ------------------------------------------------------------------


@dataclass
class Louds:
    """A level-order trie: bits are '10' and then, node by node, a one for each child and a zero; digests and lengths are the labels of all nodes but the root."""

    bits: np.ndarray
    digests: np.ndarray
    lengths: np.ndarray
    depth: np.ndarray
    path: np.ndarray  # the first sorted path that a node is a prefix of

    def parents(self) -> np.ndarray:
        """Each node's parent; -1 for the root. The k-th one is node k; the zeros before it but the first are the nodes before its parent."""
        return (np.cumsum(~self.bits)[self.bits] - 1).astype(np.int64)

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1


def common_prefixes(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each path the number of labels it shares with the one before (-1 for the first)."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    out = np.full(n, -1, np.int64)
    if n < 2:
        return out
    both = np.minimum(sizes[1:], sizes[:-1])
    row = np.repeat(np.arange(1, n), both)
    at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    differ = labels[starts[row] + at] != labels[starts[row - 1] + at]
    out[1:] = both
    np.minimum.at(out, row[differ], at[differ])
    return out


def build(paths: list[bytes]) -> tuple[Louds, np.ndarray]:
    """The trie of sorted distinct paths, and the node at which each path ends."""
    sizes = np.array([len(p) // LABEL for p in paths], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    labels = np.frombuffer(b"".join(paths), np.dtype((np.void, LABEL)))
    shared = common_prefixes(labels, starts)
    fresh = sizes - shared  # the nodes that a path adds; the first also adds the root
    path = np.repeat(np.arange(len(paths)), fresh)
    depth = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(shared + 1, fresh)
    order = np.lexsort((path, depth))
    path, depth = path[order], depth[order]
    wide = len(paths) + 1
    key = depth * wide + path  # level order
    end = np.append(np.where(depth[1:] == depth[:-1], path[1:], len(paths)), len(paths))
    # children of a node: the nodes of the next level from its first path to that of the next node of its level
    degree = np.searchsorted(key, (depth + 1) * wide + end) - np.searchsorted(key, (depth + 1) * wide + path)
    bits = np.ones(2 * len(key) + 1, bool)
    bits[1] = False
    bits[1 + np.cumsum(degree + 1)] = False
    own = labels[starts[path[1:]] + depth[1:] - 1]
    raw = np.frombuffer(own.tobytes(), np.uint8).reshape(-1, LABEL)
    digests = np.frombuffer(np.ascontiguousarray(raw[:, :DIGEST]).tobytes(), f"V{DIGEST}")
    lengths = np.frombuffer(np.ascontiguousarray(raw[:, DIGEST:]).tobytes(), ">u4").astype(np.int64)
    last = np.searchsorted(key, sizes * wide + np.arange(len(paths)), side="right") - 1
    return Louds(bits, digests, lengths, depth, path), last


def rolled_up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, ufunc=np.add) -> np.ndarray:
    """Each node's value with those of all nodes below, level by level from the last."""
    out = values.copy()
    levels = np.searchsorted(depth, np.arange(depth[-1] + 2))
    for d in range(int(depth[-1]), 0, -1):
        level = slice(levels[d], levels[d + 1])
        ufunc.at(out, parent[level], out[level])
    return out


def shard_nodes(paths: list[bytes], counts: np.ndarray, least: np.ndarray, before: int, after: int) -> tuple[dict, np.ndarray]:
    """Figures of all nodes of a shard, and which of them are shared.

    before and after: labels shared with the last path of the shard before and the first of
    the one after; -1 where there is none.
    """
    trie, last = build(paths)
    depth, parent, degree = trie.depth, trie.parents(), trie.degrees()
    n = len(depth)
    from_before = (trie.path == 0) & (depth <= before)
    own = ~from_before
    tail, node = np.zeros(n, bool), last[-1]
    while node >= 0:  # the nodes above the last path's end
        tail[node] = True
        node = parent[node]
    to_after = tail & (depth <= after)
    leaf = degree == 0
    if after == len(paths[-1]) // LABEL:
        leaf[last[-1]] = False  # it goes on in the next shard
    members, conv = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    members[last], conv[last] = counts, least
    members = rolled_up(members, parent, depth)
    length = np.append(0, trie.lengths)
    children = np.zeros(n, np.int64)
    np.add.at(children, parent[1:], own[1:].astype(np.int64))
    out = {
        "conv_id": rolled_up(conv, parent, depth, np.minimum),
        "depth": depth,
        "n_convs": members,
        "n_children": children,
        "n_leaves": rolled_up(leaf.astype(np.int64), parent, depth),
        "saved_tokens": rolled_up((members - own) * length, parent, depth),
    }
    shared = from_before | to_after | (depth == 0)
    out["parent"], out["path"], out["last"] = parent, trie.path, last
    return out, shared


# ---- Spark ----------------------------------------------------------------------


def label(role: Column, text: Column) -> Column:
    """40 hexadecimal digits: what tells a turn from others, and its code points."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, labels in order, of rows (conv_id, turn, role, text).

    Null turns come first; rows that repeat a turn stand in the order of their labels. Null role
    and text are empty. A row without a conv_id belongs to no conversation. Other columns are not read.
    """
    known = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), label(F.col("role"), F.col("text")).alias("label"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "label")
    return known.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(at)), lambda t: t["label"]).alias("labels"))


def with_shared_openings(own: DataFrame, size: int = 100, most: int = 6) -> DataFrame:
    """Conversations of which each begins like the first of its hundred: the first h labels of that one (fewer, if it has fewer; none, if it isn't there), then its own after its first h; h is the CRC-32 of the decimal id modulo ``most``."""
    own = own.withColumns({"_base": F.expr(f"conv_id - conv_id % {size}"), "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    heads = own.where("conv_id = _base").select("_base", F.slice("labels", 1, most - 1).alias("_head"))
    both = own.join(heads, "_base", "left")
    empty = F.array().cast("array<string>")
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", empty), F.lit(1), F.greatest("_h", F.lit(1)))).otherwise(empty)
    return both.select("conv_id", F.concat(head, F.slice("labels", F.col("_h") + 1, F.size("labels") + 1)).alias("labels"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path (binary), n, conv_id (the least), ends_sha256 of conversations (conv_id, labels), one row for each different sequence.

    Ids of a path are joined in blocks first; the digest over all of them is then taken block by
    block as sorted rows go by, so a path of very many conversations is never held as one list.
    """
    rows = convs.select("conv_id", F.unhex(F.array_join("labels", "")).alias("path"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda i: i.cast("string")), ",")
    blocks = rows.groupBy("path", "block").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        path, n, conv, digest = None, 0, 0, None
        for batch in batches:
            done = []
            for p, ids, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != path:
                    if path is not None:
                        done.append((path, n, conv, digest.hexdigest()))
                    path, n, conv, digest = p, k, c, hashlib.sha256(ids.encode())
                else:
                    n += k
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, n, conv, digest.hexdigest()), schema)], schema=schema)

    ordered = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "ids", "n", "conv_id")
    return ordered.mapInArrow(run, "path binary, n long, conv_id long, ends_sha256 string")


def sharded(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """paths with their shard, and for each shard how many labels it shares with its neighbours (before, after; -1 if none)."""
    paths = stored(paths, "paths")
    size = paths.agg(F.sum(F.length("path") + 16)).first()[0] or 0
    rows = stored(paths.repartitionByRange(max(1, -(-size // shard_bytes)), "path").withColumn("shard", F.spark_partition_id()), "shards")
    ends = rows.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    near = ends.selectExpr("shard", "first", "last", "lag(last) over (order by shard) as l", "lead(first) over (order by shard) as f")  # a row a shard
    record = lambda c: F.regexp_extract_all(F.hex(c), F.lit(f".{{{2 * LABEL}}}"), F.lit(0))
    pairs = lambda a, b: F.zip_with(record(a), record(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    same = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), -1).otherwise(F.coalesce(F.nullif(F.array_position(pairs(a, b), F.lit(False)), F.lit(0)) - 1, F.size(record(a))))
    return rows, near.select("shard", same("l", "first").cast("long").alias("before"), same("last", "f").cast("long").alias("after"))


NODES = "shard int, shared boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def nodes_of(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one shard in the columns of NODES: key is the prefix of a shared node, parent_key that of a shared parent."""
    rows = rows.sort_values("path")
    paths = [bytes(p) for p in rows["path"]]
    f, shared = shard_nodes(paths, rows["n"].to_numpy(np.int64), rows["conv_id"].to_numpy(np.int64), int(edges["before"].iloc[0]), int(edges["after"].iloc[0]))
    parent, depth = f["parent"], f["depth"]
    under = (depth > 0) & shared[np.maximum(parent, 0)]
    prefix = lambda test, less: [paths[p][: (d - less) * LABEL] if t else None for p, d, t in zip(f["path"], depth, test)]
    ends = np.full(len(depth), None, object)
    ends[f["last"]] = rows["ends_sha256"].to_numpy(object)
    out = {"shard": np.full(len(depth), rows["shard"].iloc[0]), "shared": shared, "key": prefix(shared, 0), "parent_key": prefix(under, 1)}
    out |= {c: f[c] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    out["parent_conv_id"] = pd.array(np.where((depth == 0) | under, 0, f["conv_id"][np.maximum(parent, 0)]), "Int64")
    out["parent_conv_id"][(depth == 0) | under] = pd.NA
    return pd.DataFrame(out | {"ends_sha256": ends})[[c.split()[0] for c in NODES.split(", ")]]


def trie_nodes(convs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each different prefix of conversations (conv_id, labels), the root's included.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (of the ids that end here, joined in order). An empty table has no node. Rows that
    repeat an id count as several members and as one end.
    """
    ship(convs.sparkSession)
    rows, edges = sharded(distinct_paths(convs), shard_bytes)

    def shard(one, two):
        return nodes_of(one, two)

    nodes = stored(rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(shard, NODES), "nodes")
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    upper = nodes.where("shared")
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stored(upper.groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *total, F.max("ends_sha256").alias("ends_sha256")), "upper")
    ids = merged.select("key", F.col("conv_id").alias("id"))
    top = merged.join(ids.select(F.col("key").alias("parent_key"), F.col("id").alias("parent_conv_id")), "parent_key", "left")
    back = upper.select("shard", "key").join(ids, "key").select("shard", F.col("key").alias("parent_key"), "id")
    below = nodes.where("not shared and parent_key is not null").drop("parent_conv_id").join(back.withColumnRenamed("id", "parent_conv_id"), ["shard", "parent_key"])
    inside = nodes.where("not shared and parent_key is null")
    return inside.select(*figures).union(below.select(*figures)).union(top.select(*figures))


def succinct(convs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The tries themselves, one row a shard: shard, n_nodes, bits (the LOUDS bitvector, first bit highest), digests and lengths (labels in level order, 16 and 4 bytes each)."""
    ship(convs.sparkSession)
    rows, _ = sharded(distinct_paths(convs), shard_bytes)

    def one(pdf):
        trie, _ = build(sorted(bytes(p) for p in pdf["path"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_nodes": [len(trie.depth)], "bits": [np.packbits(trie.bits).tobytes()], "digests": [trie.digests.tobytes()], "lengths": [trie.lengths.astype("<i4").tobytes()]})

    return rows.select("shard", "path").groupBy("shard").applyInPandas(one, "shard int, n_nodes long, bits binary, digests binary, lengths binary")
