"""Merkle manifest of a table: one binary tree per language over its rows, one over the languages' roots.

Nodes of a level stand in the order of their leaves. Lead and lag columns at the fixed offset 2 ** level, masked by the
node's slot in its run and by the run's length, give each node its sibling; the row of a run's first child hashes the
parent. The windows run within blocks of 2 ** BITS leaves of one language, whose limits no run crosses, so no window
holds more rows than that however large a language is. The blocks' top nodes are the leaves of the next round: each
round takes BITS levels, and a leaf's siblings are those of its block and then those of the block's top node.

Positions come from a range partitioning with offsets per partition, never from one sort of a whole language.

Defined cases: null fields are `-` in the hash; a null language is a group of its own, before all others; a null
doc_id comes first in its language; rows with one doc_id are leaves of their own, in the order of their hashes;
further columns are ignored; a single row is leaf, subroot and root at once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrata.operators.ranks import range_staged, with_running_total
from vistrata.session import stage

# Levels taken in one round; a window holds 2 ** BITS rows.
BITS = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value as it enters a leaf's hash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def _bit(pos: Column, level: int) -> Column:
    return F.shiftright(pos, level) % 2


def _round(nodes: DataFrame) -> DataFrame:
    """Rows of `nodes` (g, n, pos, node and more) with `block`, the siblings of BITS levels and the block's top node
    (on its first row)."""
    inside = Window.partitionBy("g", "block").orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("block", F.shiftright("pos", BITS)).withColumn("top", F.col("node"))
    for level in range(BITS):
        step = 1 << level
        count = F.ceil(F.col("n") / step)
        slot = _bit(F.col("pos"), level)
        last = F.shiftright("pos", level) + 1 >= count
        # Null where this row carries no node of the level, or the tree has ended; empty where a run holds one node.
        beside = (F.when((F.col("pos") % step != 0) | (count <= 1), None)
                  .when(slot == 1, F.lag("top", step).over(inside))
                  .when(last, F.lit("")).otherwise(F.lead("top", step).over(inside)))
        out = out.withColumn("beside", beside)
        out = out.withColumn(f"s{level}", F.last("beside", ignorenulls=True).over(so_far) if level else F.col("beside"))
        out = out.withColumn("top", F.when(F.col("beside").isNotNull() & (slot == 0), digest(F.col("top"), F.col("beside")))
                             .otherwise(F.col("top")))
    levels = [f"s{level}" for level in range(BITS)]
    return out.withColumn("siblings", F.filter(F.array(*levels), lambda s: s.isNotNull())).drop("beside", *levels)


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `nodes` (g, n, pos, node and more; at most `most` in a group) with the siblings of all levels,
    bottom up, and the groups' roots (g, root)."""
    made = stage(_round(nodes), "merkle")
    own = [c for c in nodes.columns]
    tops = made.where(F.col("pos") % (1 << BITS) == 0)
    if most <= 1 << BITS:
        return made.select(*own, "siblings"), tops.select("g", F.col("top").alias("root"))
    upper, roots = climb(tops.select("g", F.ceil(F.col("n") / (1 << BITS)).alias("n"), F.col("block").alias("pos"), F.col("top").alias("node")),
                         -(-most >> BITS))
    upper = upper.select("g", F.col("pos").alias("block"), F.col("siblings").alias("above"))
    return made.join(upper, ["g", "block"]).select(*own, F.concat("siblings", "above").alias("siblings")), roots


def fold(node: Column, pos: Column, siblings: Column) -> Column:
    """The root that a node at a position reaches with its siblings."""
    both = F.struct(node.alias("node"), pos.alias("pos"))
    step = lambda a, s: F.struct(
        F.when(a["pos"] % 2 == 1, digest(s, a["node"])).otherwise(digest(a["node"], s)).alias("node"), F.shiftright(a["pos"], 1).alias("pos"))
    return F.aggregate(siblings, both, step)["node"]


def manifest(leaves: DataFrame) -> DataFrame:
    """The rows of `leaves` (lang, doc_id, leaf and more) with pos, siblings, lang_pos, lang_siblings, subroot and
    root: all that proves a leaf. `most` and the number of languages are the only figures the driver reads."""
    grouped = stage(leaves.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))), "leaves")
    order = ["g", "doc_id", "leaf"]
    placed = with_running_total(range_staged(grouped, order, "placed", spread_ties=True), [*order, "_tie"], F.lit(1), "at")
    placed = stage(placed.drop("_part", "_tie"), "positions")
    groups = stage(placed.groupBy("g").agg(F.min("at").alias("begin"), F.count("*").alias("n")), "groups")
    langs, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = placed.join(groups, "g").withColumn("pos", F.col("at") - F.col("begin")).withColumn("node", F.col("leaf")).drop("at", "begin")
    proven, subroots = climb(nodes, most)
    ordered = with_running_total(range_staged(subroots, ["g"], "subroots"), ["g"], F.lit(1), "pos").drop("_part")
    tops, root = climb(ordered.select(F.col("g").alias("of"), F.lit("").alias("g"), F.lit(langs).cast("bigint").alias("n"), "pos",
                                      F.col("root").alias("node")), langs)
    tops = tops.join(root, "g").select(F.col("of").alias("g"), F.col("pos").alias("lang_pos"), F.col("siblings").alias("lang_siblings"),
                                       F.col("node").alias("subroot"), "root")
    return proven.join(stage(tops, "roots"), "g").drop("g", "n", "node")


def verified(tree: DataFrame, claim: str) -> DataFrame:
    """`tree` with folded_root, recomputed from the leaf in column `claim` and the siblings, and verified."""
    lang = fold(F.col(claim), F.col("pos"), F.col("siblings"))
    return (tree.withColumn("folded_root", fold(lang, F.col("lang_pos"), F.col("lang_siblings")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def proof(tree: DataFrame) -> Column:
    """Digest of a leaf's siblings, level by level from its own to the root's children."""
    return F.sha2(F.array_join(F.concat(tree["siblings"], tree["lang_siblings"]), ""), 256)


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy whose n_chars is one more where 7 divides the doc_id's crc32."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    fields = {c: field(F.col(c)) for c in FIELDS}
    altered = fields | {"n_chars": field(F.col("n_chars").cast("decimal(38,0)") + more)}
    leaves = docs.select("doc_id", "lang", digest(*fields.values()).alias("leaf"), digest(*altered.values()).alias("claim"))
    tree = verified(manifest(leaves), "claim")
    return tree.select("doc_id", "leaf", "subroot", "root", proof(tree).alias("proof_sha256"), "folded_root", "verified")
