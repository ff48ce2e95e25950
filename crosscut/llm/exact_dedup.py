"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after each run of white space is replaced by one space; null counts as empty.
Batches first insert their texts into a small trie each, so that a text held by a third of all rows is shuffled
once per batch. Partitions by length and content hash then insert the full byte strings into one compressed radix
trie whose terminals own the smallest id. A trie over its memory bound spills whole subtrees (by the byte at which its
strings differ) to a task's own temporary files, which are read back one at a time and removed by the same task.

Defined results: a null id is larger than any other and keeps its row only where the group has no id; rows that
repeat an id and its text are one document and are all marked kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACE_RUN, cut, filled, lean, small_batches

#: Bytes of labels that one partition's trie holds before it spills.
SPILL_BYTES = 96 << 20
NODE_BYTES = 500  # of a node's Python objects, about
NO_ID = (1 << 63) - 1


class Trie:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, smallest id, copies]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0]
        self.bytes = 0

    def insert(self, key: bytes, owner: int, copies: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = owner if node[2] is None else min(node[2], owner)
                node[3] += copies
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner, copies]
                self.bytes += len(key) - at + NODE_BYTES
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            same = len(os.path.commonprefix((label, rest)))
            upper = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.bytes += NODE_BYTES
            node, at = upper, at + same

    def items(self, node: list | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """(string, smallest id, copies) of each terminal; a stack, for tries may be deep."""
        stack = [(node or self.root, before)]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node[2], node[3]
            stack.extend((c, key) for c in node[1].values())


class SpillingTrie:
    """A trie that moves its largest first-byte subtree to a local file when it grows beyond its bound."""

    def __init__(self, limit: int = SPILL_BYTES) -> None:
        self.trie, self.limit, self.files, self.held = Trie(), limit, {}, {}

    def insert(self, key: bytes, owner: int, copies: int) -> None:
        if key and key[0] in self.files:
            pickle.dump((key, owner, copies), self.files[key[0]])
            return
        before = self.trie.bytes
        self.trie.insert(key, owner, copies)
        if key:
            self.held[key[0]] = self.held.get(key[0], 0) + self.trie.bytes - before
        if self.trie.bytes > self.limit and self.held:
            first = max(self.held, key=self.held.get)
            out = self.files[first] = tempfile.TemporaryFile()
            self.trie.bytes -= self.held.pop(first)
            for item in self.trie.items(self.trie.root[1].pop(first)):
                pickle.dump(item, out)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        yield from self.trie.items()
        self.trie = None
        for first in sorted(self.files):
            with self.files.pop(first) as f:
                f.seek(0)
                yield from self._reload(f)

    def _reload(self, f) -> Iterator[tuple[bytes, int, int]]:
        """A spilled subtree has the memory of a trie again, and spills where its strings differ next in turn."""
        shared = None
        for key, _, _ in self._stored(f):
            shared = key if shared is None else os.path.commonprefix((shared, key))
        f.seek(0)
        sub = SpillingTrie(self.limit)
        for key, owner, copies in self._stored(f):
            sub.insert(key[len(shared) :], owner, copies)
        for key, owner, copies in sub.items():
            yield shared + key, owner, copies

    @staticmethod
    def _stored(f) -> Iterator[tuple[bytes, int, int]]:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _rows(items: Iterator[tuple[bytes, int, int]], with_text: bool) -> Iterator[pa.RecordBatch]:
    hold, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = {
            "n": pa.array([len(k) for k, _, _ in hold], pa.int64()),
            "sha": pa.array([hashlib.sha256(k).digest() for k, _, _ in hold], pa.binary()),
            "owner": pa.array([o for _, o, _ in hold], pa.int64()),
            "copies": pa.array([c for _, _, c in hold], pa.int64()),
        }
        if with_text:
            cols["body"] = pa.array([k for k, _, _ in hold], pa.binary())
        return pa.RecordBatch.from_pydict(cols)

    for item in items:
        hold.append(item)
        size += len(item[0])
        if size > 8 << 20 or len(hold) >= 10_000:
            yield batch()
            hold, size = [], 0
    if hold:
        yield batch()


def _per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        trie = Trie()
        for key, owner in zip(b.column("body").cast(pa.binary()).to_pylist(), b.column("id").to_pylist(), strict=True):
            trie.insert(key, NO_ID if owner is None else owner, 1)
        yield from _rows(trie.items(), True)


def _per_partition(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SpillingTrie(limit)
        for b in batches:
            for key, owner, copies in zip(*(b.column(c).to_pylist() for c in ("body", "owner", "copies")), strict=True):
                trie.insert(key, owner, copies)
        yield from _rows(trie.items(), False)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct text: n (bytes), sha (binary), owner (smallest id), copies."""
    norm = F.regexp_replace(filled(F.col(text_col)), SPACE_RUN, " ")
    small_batches(docs.sparkSession)
    local = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("body")).mapInArrow(
        lean(_per_batch), "n long, sha binary, owner long, copies long, body binary"
    )
    return local.repartition("n", "sha").mapInArrow(
        lean(_per_partition(spill_bytes)), "n long, sha binary, owner long, copies long"
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = SPILL_BYTES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    norm = F.regexp_replace(filled(F.col(text_col)), SPACE_RUN, " ")
    # the hash is taken twice rather than kept: it is cheap next to storing the texts
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("body")).select(
        "id", F.octet_length("body").cast("long").alias("n"), F.unhex(F.sha2("body", 256)).alias("sha")
    )
    own = owners(docs, id_col, text_col, spill_bytes).withColumn(
        "owner", F.when(F.col("owner") < F.lit(NO_ID), F.col("owner"))
    )
    return rows.join(own, ["n", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.col("owner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("owner")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: each row by its own decision, and one of those that repeat an id
    and its text."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of the table meets one of ours
    id_, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    own = exact_dedup(plain, id_, text).filter("group_size > 1")
    own = cut(own.select(F.col(id_).alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept"))
    twins = own.filter("kept").groupBy("_id", "_sha").count().filter("count > 1").select("_id", "_sha")
    marks = cut(own.filter("not kept").select("_id", "_sha").distinct().unionByName(twins))
    few = marks.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    sha = F.unhex(F.sha2(F.regexp_replace(filled(F.col(text)), SPACE_RUN, " "), 256))
    same = F.col(id_).eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    out = plain.join(F.broadcast(marks) if few else marks, same, "left_anti")
    if twins.take(1):
        one = plain.join(twins, same, "left_semi").withColumn("_sha", sha).dropDuplicates([id_, "_sha"])
        out = out.unionByName(one.drop("_sha"))
    return out.toDF(*names)
