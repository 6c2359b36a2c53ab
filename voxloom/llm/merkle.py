"""Merkle manifest of a dataset: a root over all documents, and a proof for each.

Every row is a leaf, the SHA-256 of its columns. Per language leaves ascend by ``doc_id``; two
neighbours become one parent until one node, the subroot, is left; the subroots, by language, do the
same and give the root. A proof is the list of siblings from the leaf up to the root.

The rank of a leaf in its language is written in digits of base 16. Ranks are dealt into blocks of
256 (two digits), one shuffle; inside a block one digit after the other is grouped away, each parent
struct nesting its children, so a block is one bounded row at the end. The nodes left over, one a
block, go through the same again: as many rounds as the largest language needs (four for 4 billion
rows). On the way back blocks take the siblings above them by grouping on their own number, and
``transform`` with ``explode`` hands every leaf its proof: no join, and no group over 256 children.

Ranks come from a range shuffle of digests (texts stay where they are), split at any language, so one
language may hold all rows. Rows of equal ``doc_id`` go by their digest; rows equal in all columns
are leaves of equal digest next to each other. A null column is ``-`` in its leaf; null languages
come first, null ids first in their language. An empty table gives an empty table (and no root).
Extra columns are not part of a leaf.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.measure import let
from voxloom.llm.common import stored

#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a rank digit, and digits of a block.
BITS, DIGITS = 4, 2
BLOCK_BITS = BITS * DIGITS


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row of ``FIELDS``; ``columns`` replaces some of them."""
    return digest(*[field((columns or {}).get(c, F.col(c))) for c in FIELDS])


def _deepness(n: Column) -> Column:
    """Levels above ``n`` leaves: the binary digits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0)).cast("int")


def ranked(rows: DataFrame) -> DataFrame:
    """(grp, depth, rank, h, own) from (grp, at, h, own): rank by ``at``, then ``h``, in the group.

    Stored once in ranges of (grp, at, h); a number inside each range plus the counts of earlier
    ranges is the rank. Equal rows are told apart by a random number, so that ranges can split them.
    """
    order = ["grp", "at", "h", "salt"]
    ranged = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    held = stored(ranged.select("grp", "h", "own", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")))
    counts = held.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    group = Window.partitionBy("grp")
    ahead = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("grp", "part", (ahead - F.col("first")).alias("shift"), _deepness(F.sum("n").over(group)).alias("depth")))
    return held.join(starts, ["grp", "part"]).select("grp", "depth", (F.col("nth") + F.col("shift")).alias("rank"), "h", "own")


def _parents(x: Column) -> Column:
    """Digests of two neighbours each; the last may be alone."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")),
        lambda i: F.sha2(F.concat(F.get(x, 2 * i), F.coalesce(F.get(x, 2 * i + 1), F.lit(""))), 256),
    )


def _node(kids: Column, levels: Column) -> Column:
    """A parent of at most 16 children: its digest, the digests below it level by level, the children.

    ``levels`` of the four are in use; a group that ended earlier hands its only child's digest on.
    """
    return let(F.transform(kids, lambda k: k["node"]["h"]), lambda a: let(_parents(a), lambda b: let(_parents(b), lambda c: let(_parents(c), lambda d: F.struct(
        F.element_at(F.array(F.get(a, 0), F.get(b, 0), F.get(c, 0), F.get(d, 0), F.get(_parents(d), 0)), levels + 1).alias("h"),
        F.slice(F.array(a, b, c, d), F.lit(1), levels).alias("tree"),
        F.transform(kids, lambda k: k["node"]).alias("kids"),
    )))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks (grp, depth, block, node), lowest first; the last has one block a group.

    ``nodes`` has (grp, depth, rank, h, own). The deepest group is the one number the driver reads.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    rounds: list[DataFrame] = []
    for r in range(max(1, math.ceil(deepest / BLOCK_BITS))):
        inside = F.col("rank").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        rows = nodes.select("grp", F.shiftright("rank", BLOCK_BITS).alias("block"), "depth", inside.alias("pos"), F.struct("h", "own").alias("node"))
        rows = rows.repartition("grp", "block")
        for d in range(DIGITS):
            levels = F.least(F.greatest(F.col("depth") - (r * BLOCK_BITS + d * BITS), F.lit(0)), F.lit(BITS))
            child = F.struct(F.col("pos").bitwiseAND((1 << BITS) - 1).alias("digit"), "node")
            grouped = rows.groupBy("grp", "block", "depth", F.shiftright("pos", BITS).alias("pos")).agg(F.sort_array(F.collect_list(child)).alias("kids"))
            rows = grouped.select("grp", "block", "depth", "pos", _node(F.col("kids"), levels).alias("node"))
        rounds.append(stored(rows.drop("pos")))
        nodes = rounds[-1].select("grp", "depth", F.col("block").alias("rank"), F.col("node")["h"].alias("h"), F.lit(None).cast("int").alias("own"))
    return rounds


def _siblings(tree: Column, i: Column) -> Column:
    """From child ``i`` upwards: ``L`` or ``R`` and the sibling's digest, or nothing where a node is alone."""

    def one(level: Column, l: Column) -> Column:
        at = F.call_function("shiftright", i, l)
        other = at.bitwiseXOR(F.lit(1))
        return F.when(other >= F.size(level), F.lit("")).otherwise(F.concat(F.when(other < at, F.lit("L")).otherwise(F.lit("R")), F.get(level, other)))

    return F.transform(tree, one)


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, rank, own, proof, subroot, root) of every node the climb began with.

    ``tops`` has (grp, rank, proof, subroot, root) of each group's last node. A block meets what is
    above it by grouping on its number: one row from either side.
    """
    above = tops
    for blocks in reversed(rounds):
        kind = blocks.schema["node"].dataType
        down = above.select("grp", F.col("rank").alias("block"), F.lit(None).cast(kind).alias("node"), F.struct("proof", "subroot", "root").alias("up"))
        up = blocks.select("grp", "block", "node", F.lit(None).cast(down.schema["up"].dataType).alias("up"))
        both = up.unionByName(down).groupBy("grp", "block").agg(F.any_value("node", True).alias("node"), F.any_value("up", True).alias("up"))
        parent, first = F.col("node"), F.shiftleft(F.col("block"), BLOCK_BITS)

        def leaves(kid: Column, i: Column) -> Column:  # used within this round only
            return F.transform(kid["kids"], lambda x, j: F.struct(
                (first + 16 * i + j).alias("rank"), x["own"].alias("own"),
                F.concat(_siblings(kid["tree"], j), _siblings(parent["tree"], i), F.col("up")["proof"]).alias("proof"),
            ))

        rows = both.select("grp", "up", F.explode(F.flatten(F.transform(parent["kids"], leaves))).alias("x"))
        above = rows.select("grp", "x.rank", "x.own", "x.proof", F.col("up")["subroot"].alias("subroot"), F.col("up")["root"].alias("root"))
    return above


def _tops(rounds: list[DataFrame], proof: Column, root: Column) -> DataFrame:
    h = F.col("node")["h"]
    return rounds[-1].select("grp", F.col("block").alias("rank"), proof.alias("proof"), h.alias("subroot"), F.coalesce(root, h).alias("root"))


def tree(rows: DataFrame) -> DataFrame:
    """(grp, own, proof, subroot, root) for (grp, at, h, own): one tree a group, and one over the groups."""
    rounds = climb(ranked(rows))
    group = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("at"), F.col("node")["h"].alias("h"), F.struct("grp").alias("own"))
    over = climb(ranked(group))
    none = F.array().cast("array<string>")
    roots = descend(over, _tops(over, none, F.lit(None).cast("string")))
    tops = stored(roots.select(F.col("own")["grp"].alias("grp"), F.lit(0).cast("long").alias("rank"), "proof", F.lit(None).cast("string").alias("subroot"), "root"))
    last = rounds[-1].select("grp", F.col("block").alias("rank"), F.lit(None).cast("array<string>").alias("proof"), F.col("node")["h"].alias("subroot"), F.lit(None).cast("string").alias("root"))
    whole = tops.unionByName(last).groupBy("grp", "rank").agg(*[F.any_value(c, True).alias(c) for c in ("proof", "subroot", "root")])
    return descend(rounds, whole)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(h: Column, p: Column) -> Column:
        sibling = F.substring(p, 2, 64)
        return F.sha2(F.when(p == "", h).when(F.startswith(p, F.lit("L")), F.concat(sibling, h)).otherwise(F.concat(h, sibling)), 256)

    return F.aggregate(proof, start, step)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, proof (array), subroot, root; ``changed`` is carried along."""
    kept = F.struct("doc_id", (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    lang = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(*FIELDS).select(lang.alias("grp"), F.col("doc_id").alias("at"), leaf().alias("h"), kept.alias("own"))
    # The digest goes on inside ``own``, because only blocks, not leaves, keep their place.
    rows = rows.withColumn("own", F.col("own").withField("leaf", F.col("h")))
    out = tree(rows)
    return out.select("own.doc_id", "own.leaf", "own.changed", "proof", "subroot", "root")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 7 divides the CRC-32 of the decimal ``doc_id``, the fold starts from the digest of the row
    with ``n_chars`` one higher (a null ``n_chars`` or ``doc_id`` stays as it is).
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf({"n_chars": more}))
    rows = manifest(docs, changed)
    siblings = F.transform(F.filter("proof", lambda p: p != ""), lambda p: F.substring(p, 2, 64))
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
