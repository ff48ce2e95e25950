"""Merkle dataset manifest: a hash tree per group of rows and one above the groups, with a proof for every row.

Superblock reduction. Leaves are numbered within their group by a range sort, so that a group of any size is spread over
many tasks. A bucket is fanout**depth consecutive nodes; one call of applyInPandas collapses `depth` levels of a bucket to
its root, and the bucket roots, fanout**depth times fewer, are reduced the same way until a node is left. Going down again,
each bucket's lower proofs are followed by the upper proof of its root. No task holds more than a bucket and nothing but
counts of steps comes to the driver.

H is lowercase hex SHA-256; inputs are concatenated, digests as hex text. A field's part of a leaf is `-` if it is null,
else its UTF-8 byte count, `:` and its value as text. A run is up to `fanout` consecutive nodes; also a run of one is hashed.

Defined results: rows ascend by id within a group, null ids first; rows of one id by leaf, and rows that are equal
throughout in any order (their proofs are of neighbouring places). A null group is a group, and the first. A table without
rows has no result rows. Input columns beyond those named are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, saved

FANOUT, DEPTH = 8, 4

_NODES = "grp string, i long, n long, digest string"
_PROVED = "proof binary, shape binary, subroot string, root string"


def field(c: Column) -> Column:
    """A value's part of a leaf."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (grp, the columns of the order, more) with i, the place within grp from 0, and n, the rows of grp.

    The order must tell all rows apart. Ranges of (grp, order) are numbered apart from each other and shifted by what the
    ranges before hold of the group: a sum over ranges, not over rows.
    """
    at = cut(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_range", F.spark_partition_id()))
    held = at.groupBy("grp", "_range").agg(F.count("*").alias("_held"))
    over = Window.partitionBy("grp").orderBy("_range")
    before = F.sum("_held").over(over.rowsBetween(Window.unboundedPreceding, -1))
    shift = held.select("grp", "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_held").over(Window.partitionBy("grp")).alias("n"))
    place = F.row_number().over(Window.partitionBy("grp", "_range").orderBy(*order))
    return at.withColumn("_place", place).join(shift, ["grp", "_range"]).withColumn("i", F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")


def _levels(n: int, fanout: int, depth: int) -> int:
    """Levels that a bucket of a group of n nodes collapses: depth, or fewer where the group ends sooner."""
    k = 0
    while n > 1 and k < depth:
        n, k = -(-n // fanout), k + 1
    return k


def _collapse(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The digests of a bucket and of each level above."""
    out = [digests]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[j : j + fanout]).encode()).hexdigest() for j in range(0, len(low), fanout)])
    return out


def _roots(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The bucket roots of nodes: the nodes one step up."""
    size = fanout**depth

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        top = _collapse(pdf["digest"].tolist(), _levels(n, fanout, depth), fanout)[-1]
        return pd.DataFrame({"grp": [key[0]], "i": [key[1]], "n": [-(-n // size)], "digest": top})

    t = nodes.select("grp", "i", "n", "digest", F.floor(F.col("i") / size).alias("bucket"))
    return t.groupBy("grp", "bucket").applyInPandas(one, _NODES)


def _proved(nodes: DataFrame, parents: DataFrame, fanout: int, depth: int, extra: str = "") -> DataFrame:
    """nodes with their proofs: those inside the bucket, then that of the bucket's root.

    nodes: grp, i, n, digest and the columns of `extra`; parents: grp, i and the proof columns."""
    size = fanout**depth

    def one(nodes: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame(columns=names)
        nodes = nodes.sort_values("i")
        levels = _collapse(nodes["digest"].tolist(), _levels(int(nodes["n"].iloc[0]), fanout, depth), fanout)
        up = parent.iloc[0]
        proofs, shapes = [bytes(up["proof"])], [bytes(up["shape"])]
        for low in reversed(levels[:-1]):
            runs = [[bytes.fromhex(d) for d in low[j : j + fanout]] for j in range(0, len(low), fanout)]
            places = [(r, p) for r in range(len(runs)) for p in range(len(runs[r]))]
            proofs = [b"".join(runs[r][:p] + runs[r][p + 1 :]) + proofs[r] for r, p in places]
            shapes = [bytes((p, len(runs[r]))) + shapes[r] for r, p in places]
        return nodes.assign(proof=proofs, shape=shapes, subroot=up["subroot"], root=up["root"])[names]

    schema = f"{_NODES}, {extra + ', ' if extra else ''}{_PROVED}"
    names = [x.split()[0] for x in schema.split(", ")]
    left = nodes.withColumn("bucket", F.floor(F.col("i") / size)).groupBy("grp", "bucket")
    right = parents.select("grp", F.col("i").alias("bucket"), "proof", "shape", "subroot", "root").groupBy("grp", "bucket")
    return left.cogroup(right).applyInPandas(one, schema)


def _steps(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """nodes, and the nodes of each step up, until every group has one."""
    out = [nodes]
    while out[-1].filter("n > 1").limit(1).count():
        out.append(cut(_roots(out[-1], fanout, depth)))
    return out


def _descend(steps: list[DataFrame], parents: DataFrame, fanout: int, depth: int, extra: str = "") -> DataFrame:
    """Proofs for the nodes of steps[0], from the proofs of the groups' roots (grp, i = 0 and the proof columns).

    A group that ends early passes through the steps above: a bucket of one node collapses no level."""
    for step in reversed(steps[1:]):
        parents = _proved(step, parents, fanout, depth)
    return _proved(steps[0], parents, fanout, depth, extra)


def manifest(
    docs: DataFrame, id_col: str, group_col: str, fields: Sequence[str], altered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH
) -> DataFrame:
    """id, grp, leaf, altered, subroot, root, proof, shape of each row.

    proof: the sibling digests of all levels, 32 bytes each, lowest level first and left to right. shape: two bytes a
    level, the node's place in its run and the run's size. altered: the leaf with other columns in the place of fields, of
    the rows that `where` holds for and else null: for checks of what tampering does.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("a run has 2 to 255 nodes")
    as_is = [docs[c] for c in fields]
    other = F.lit(None).cast("string")
    if altered:
        other = F.when(F.lit(True) if where is None else where, leaf([altered.get(c, docs[c]) for c in fields]))
    # a null group sorts before all others, also before the empty one
    grp = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), docs[id_col].alias("id"), F.unhex(leaf(as_is)).alias("leaf"), F.unhex(other).alias("altered"))
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "altered")]
    kept = saved(numbered(rows, ("id", "leaf", "_row")).drop("_row"), "tree").select("grp", "i", "n", "id", *hexed)
    # ids go through pandas as text, which loses none
    leaves = kept.select("grp", "i", "n", F.col("leaf").alias("digest"), F.col("id").cast("string").alias("id"), "altered")
    steps = _steps(leaves, fanout, depth)

    subroots = steps[-1].select(F.col("grp").alias("of"), F.col("digest"), F.lit("").alias("grp"))
    upper = _steps(cut(numbered(subroots, ("of",)).select("grp", "i", "n", "digest", "of")), fanout, depth)
    whole = upper[-1].select("grp", "i", F.lit(b"").alias("proof"), F.lit(b"").alias("shape"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    groups = _descend(upper, whole, fanout, depth, "of string")
    groups = cut(groups.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("i"), "proof", "shape", F.col("digest").alias("subroot"), "root"))

    out = _descend(steps, groups, fanout, depth, "id string, altered string")
    group = F.when(F.col("grp") != "", F.substr(F.col("grp"), F.lit(2)))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), group.alias("grp"), F.col("digest").alias("leaf"), "altered", "subroot", "root", "proof", "shape")


def fold(leaf: str, proof: bytes, shape: bytes) -> str:
    """The root that a leaf and its siblings give."""
    others, at, node = bytes(proof).hex(), 0, leaf
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        mid, end = at + 64 * place, at + 64 * (size - 1)
        node = hashlib.sha256(f"{others[at:mid]}{node}{others[mid:end]}".encode()).hexdigest()
        at = end
    return node


@F.pandas_udf(StringType())
def folded(leaf: pd.Series, proof: pd.Series, shape: pd.Series) -> pd.Series:
    """fold as a column."""
    return pd.Series([fold(*x) for x in zip(leaf, proof, shape, strict=True)], dtype=object)


def proof_digest(proof: Column) -> Column:
    """H of the siblings, as hex text."""
    return F.sha2(F.lower(F.hex(proof)), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z; all else stays."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def tampered(rows: DataFrame) -> DataFrame:
    """Rows of a manifest with folded_root, of the altered leaf where there is one and else of the leaf, and verified."""
    rows = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), "proof", "shape"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
