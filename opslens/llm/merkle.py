"""A Merkle tree over a table: one root, and for every row a proof up to it.

Rows of a source, by doc_id, are the leaves of a tree whose nodes join ARITY
consecutive ones; the roots of the sources, by source, are the leaves of one
more such tree.

Nodes are appended one by one.  An append puts a node into the open run of its
level, with the witnesses of the leaves below it; when a run is full (or its
tree ends) it closes: each of its nodes gives the others to the witnesses below
it, and the joint node is appended one level up.  So a leaf's witness starts
empty and grows by the siblings of each subtree that completes above it.

On Spark, blocks of ARITY ** LEVELS aligned leaves are appended independently of
each other; their roots are the appends of the next round, until each tree has
one node.  On the way back down, the witness of a block root extends those of
all leaves of its block, so a task holds one block and no proof is stored
before it is whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

ARITY = 16
LEVELS = 2  # of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 64  # characters


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int, most: int) -> int:
    """Levels above n nodes until one is left, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Witness:
    """Siblings on the way up from a node, as they come; ``folded`` is what
    ``node`` and they make."""

    def __init__(self, node: str, keep: bool = True):
        self.folded, self.proof = node, sha256()
        self.levels: list[tuple[str, str]] | None = [] if keep else None

    def extend(self, left: str, right: str) -> None:
        self.folded = digest(left + self.folded + right)
        self.proof.update((left + right).encode())
        if self.levels is not None:
            self.levels.append((left, right))

    def packed(self) -> bytes:
        """For each level: siblings to the left and right (a byte each), digests."""
        return b"".join(
            bytes([len(left) // DIGEST, len(right) // DIGEST]) + bytes.fromhex(left + right) for left, right in self.levels
        )


def unpacked(data: bytes) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        at += 2
        middle, end = at + left * DIGEST // 2, at + (left + right) * DIGEST // 2
        yield data[at:middle].hex(), data[middle:end].hex()
        at = end


def verify(leaf: str, witness: bytes, root: str) -> bool:
    """Whether a leaf and its packed witness make the root."""
    for left, right in unpacked(witness):
        leaf = digest(left + leaf + right)
    return leaf == root


class Subtree:
    """A tree of a given height to which nodes are appended from left to right."""

    def __init__(self, levels: int):
        self.runs: list[list[tuple[str, list[Witness]]]] = [[] for _ in range(levels)]
        self.root: str | None = None
        self.witnesses: list[Witness] = []

    def append(self, node: str, witnesses: list[Witness], level: int = 0) -> None:
        if level == len(self.runs):
            self.root, self.witnesses = node, witnesses
            return
        self.runs[level].append((node, witnesses))
        if len(self.runs[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        nodes = [node for node, _ in run]
        for i, (_, witnesses) in enumerate(run):
            if witnesses:
                left, right = "".join(nodes[:i]), "".join(nodes[i + 1 :])
                for w in witnesses:
                    w.extend(left, right)
        self.append(digest("".join(nodes)), [w for _, below in run for w in below], level + 1)

    def finish(self) -> str:
        """Close what is open; the root."""
        for level in range(len(self.runs)):
            if self.runs[level]:
                self._close(level)
        return self.root


# --- on Spark -----------------------------------------------------------------

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


_BLOCK = itemgetter("source", "block")
_NODES = "source string, n long, pos long, digest string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _block_roots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for (source, block), nodes in groupby(_rows(batches), _BLOCK):
            tree = None
            for node in nodes:
                n = node["n"]
                tree = tree or Subtree(height(n, most))
                tree.append(node["digest"], [])
            yield source, -(-n // ARITY**most), block, tree.finish()

    kinds = [("source", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())]
    return _batches(rows(), pa.schema(kinds))


def _extended(batches: Iterator[pa.RecordBatch], most: int, leaves: bool, keep: bool) -> Iterator[pa.RecordBatch]:
    """Whole witnesses of the nodes of every block; the block root's comes first."""

    def rows():
        for (source, _), nodes in groupby(_rows(batches), _BLOCK):
            above, tree, held = next(nodes), None, []
            for node in nodes:
                tree = tree or Subtree(height(node["n"], most))
                w = Witness(node["tampered"] or node["digest"], keep or not leaves)
                held.append((node, w))
                tree.append(node["digest"], [w])
            tree.finish()
            for left, right in unpacked(above["witness"]):
                for w in tree.witnesses:
                    w.extend(left, right)
            for node, w in held:
                packed = w.packed() if w.levels is not None else None
                if leaves:
                    yield node["doc_id"], node["digest"], above["subroot"], w.proof.hexdigest(), w.folded, packed
                else:
                    yield source, node["pos"], packed, above["subroot"]

    if leaves:
        kinds = [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")],
                 ("witness", pa.binary())]
    else:
        kinds = [("source", pa.string()), ("pos", pa.int64()), ("witness", pa.binary()), ("subroot", pa.string())]
    return _batches(rows(), pa.schema(kinds))


def _numbered(rows: DataFrame, group: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos (from 0 within the group, by ``order``) and n (rows of the group)."""
    ordered = rows.withColumn("group", group).repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    placed = written(
        ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name
    )
    # a row for each group that a task has; a group has at most one for each task
    of = Window.partitionBy("whose")
    runs = written(
        placed.groupBy(F.col("group").alias("whose"), F.col("part").alias("task"))
        .agg(F.count("*").alias("m"), F.min("at").alias("first"))
        .select(
            "whose", "task", "first", F.sum("m").over(of).alias("n"),
            F.coalesce(F.sum("m").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        ),
        f"{name}-runs",
    )
    return placed.join(runs, (F.col("part") == F.col("task")) & F.col("group").eqNullSafe(F.col("whose"))).select(
        *rows.columns, "n", (F.col("before") + F.col("at") - F.col("first")).alias("pos")
    )


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}").alias("block")


def _climb(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Nodes of every round, the last with one node a source."""
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        blocks = nodes.select("source", _block(levels), "n", "pos", "digest")
        nodes = written(
            map_arrow(
                blocks.repartition("source", "block").sortWithinPartitions("source", "block", "pos"),
                lambda it: _block_roots(it, levels), _NODES,
            ),
            name,
        )
        rounds.append(nodes)
    return rounds


def _descend(rounds: list[DataFrame], witnesses: DataFrame, levels: int, name: str, leaves: bool = False, keep: bool = False) -> DataFrame:
    """Witnesses of the nodes of the first round, from those of the last:
    source, pos, witness, subroot."""
    none = {"witness": "binary", "subroot": "string", "doc_id": "long", "tampered": "string"}
    # where every source has one leaf, leaves are the block roots themselves
    for i in range(max(len(rounds) - 2, 0 if leaves else -1), -1, -1):
        last = leaves and not i
        own = ["doc_id", "tampered"] if last else []
        nodes = rounds[i].select(
            "source", _block(levels), "pos", "n", "digest",
            *[F.col(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in none.items()],
        )
        heads = witnesses.select(
            "source", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
            F.lit(None).cast("string").alias("digest"), "witness", "subroot", F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("tampered"),
        )
        dealt = nodes.unionByName(heads).repartition("source", "block").sortWithinPartitions("source", "block", "pos")
        if last:
            schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, witness binary"
            return map_arrow(dealt, lambda it: _extended(it, levels, True, keep), schema)
        schema = "source string, pos long, witness binary, subroot string"
        witnesses = written(map_arrow(dealt, lambda it: _extended(it, levels, False, True), schema), name)
    return witnesses


def _leaf(text: Column) -> Column:
    """Digest of a row; ``text`` stands for its text."""
    parts = []
    for c in FIELDS:
        value = text if c == "text" else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """Root, and a checked proof, of every row.

    ``docs`` needs doc_id and n_chars (integers), source, lang and text
    (strings); other columns are ignored.  A leaf is the digest of the five
    fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.
    ``tampered``, a text column, is what a check finds instead of a text; where
    it is null, and without it, nothing changed.

    Returns one row per input row: doc_id, leaf, subroot (of its source), root,
    proof_sha256 (of all siblings, level by level), folded_root (of the found
    row and those siblings) and verified (folded_root is the root); with
    ``proofs`` also witness, the siblings as ``Witness.packed`` has them.

    Sources are ordered bytewise, null first; leaves of a source by doc_id
    (null first) and, where that repeats, by digest.  An empty table gives an
    empty result.
    """
    text = F.col("text").cast("string")
    found = F.when(tampered.isNotNull(), _leaf(tampered)) if tampered is not None else F.lit(None).cast("string")
    leaves = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            _leaf(text).alias("digest"), found.alias("tampered"),
        ),
        "merkle-leaves",
    )
    leaves = _numbered(leaves, F.col("source"), ["doc_id", "digest"], "merkle-ordered")
    rounds = _climb(leaves, levels, "merkle-blocks")
    subroots = _numbered(rounds[-1].select(F.col("source").alias("name"), "digest"), F.lit(""), ["name"], "merkle-sources")
    tops = _climb(subroots.select(F.lit(None).cast("string").alias("source"), "n", "pos", "digest", "name"), levels, "merkle-top")
    top = tops[-1].select("digest").first()
    crown = tops[-1].select(
        "source", "pos", F.lit(b"").alias("witness"), F.lit(None).cast("string").alias("subroot")
    )
    above = _descend(tops, crown, levels, "merkle-top-witnesses").select(F.col("pos").alias("at"), "witness")
    named = subroots.join(above, F.col("pos") == F.col("at")).select(
        F.col("name").alias("source"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot")
    )
    named = written(named, "merkle-source-witnesses")
    out = _descend(rounds, named, levels, "merkle-witnesses", leaves=True, keep=proofs)
    root = F.lit(top["digest"] if top else None).cast("string")
    return out.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"), *(["witness"] if proofs else []),
    )


def lower_some(every: int = 5) -> Column:
    """The text with A-Z in lower case where ``every`` divides the CRC-32 of the
    decimal doc_id; null elsewhere, and for null texts and doc_ids."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(F.col("text").cast("string"), UPPER, LOWER))
