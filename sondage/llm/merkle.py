"""A Merkle manifest of a dataset: slots of a parent pivoted into columns, whose concatenation hashes to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import col
from sondage.llm.ranks import fixed, numbered
from sondage.session import cut_lineage

FANOUT = 8
# Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts put together; null parts count as nothing."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def marked(value: Column) -> Column:
    """A field as text: ``-`` for null, else its bytes in UTF-8, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[marked(f) for f in fields])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))))


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


@dataclass
class Tree:
    """Levels of pivoted parents from the leaves up, and the groups' subroots (g, n, pos, node, kids) as they finished."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    fanout: int


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree above (g, n, pos, node, kid): n nodes of a group g with places from 0; ``kid`` goes with a node to its parent.

    A level spreads the children of each parent into ``fanout`` columns by conditional aggregates. A group with one
    node left is finished. Each level is written before the next one reads it, an eighth of the one below.
    """
    slots = _slots(fanout)
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1"))
        if most <= 1:
            return Tree(levels, tops, fanout)
        at = F.pmod("pos", F.lit(fanout))
        spread = [F.max(F.when(at == k, F.col("node"))).alias(c) for k, c in enumerate(slots)]
        kids = [F.max(F.when(at == k, F.col("kid"))).alias(f"kid{k}") for k in range(fanout)] if "kid" in nodes.columns else []
        level = nodes.where("n > 1").groupBy("g", "n", F.expr(f"pos DIV {fanout}").alias("up")).agg(*spread, *kids)
        level = cut_lineage(level.withColumn("node", digest(*[F.col(c) for c in slots])))
        levels.append(level)
        nodes = level.select("g", F.expr(f"(n + {fanout - 1}) DIV {fanout}").alias("n"), F.col("up").alias("pos"), "node")
        most = -(-most // fanout)


def _children(level: DataFrame, tails: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """(g, pos, node, kid, proof, carried ...) of the children of a level, given (g, pos, proof, carried ...) of its parents.

    A child's own step of the proof is the parent's columns without the child's slot: those before it and those after it.
    """
    slots = _slots(fanout)
    kid = f"kid{0}" in level.columns
    each = []
    for k in range(fanout):
        step = F.struct(F.concat_ws("", *[F.col(c) for c in slots[:k]]).alias("left"), F.concat_ws("", *[F.col(c) for c in slots[k + 1 :]]).alias("right"))
        each.append(F.struct(F.lit(k).cast("long").alias("k"), F.col(slots[k]).alias("node"), step.alias("step"), *([F.col(f"kid{k}").alias("kid")] if kid else [])))
    both = level.drop("node", "n").join(tails.withColumnRenamed("pos", "up"), ["g", "up"])
    rows = both.select("g", "up", "proof", *carried, F.explode(F.array(*each)).alias("x")).where("x.node IS NOT NULL")
    return rows.select("g", (F.col("up") * fanout + F.col("x.k")).alias("pos"), F.col("x.node").alias("node"), *([F.col("x.kid").alias("kid")] if kid else []), F.concat(F.array("x.step"), "proof").alias("proof"), *carried)


def paths(tree: Tree, tails: DataFrame, carried: list[str]) -> DataFrame:
    """(g, pos, node, kid, proof, carried ...) of every leaf, top down; ``tails`` has (g, proof, carried ...) of each group's subroot."""
    known = None
    for k in range(len(tree.levels), -1, -1):
        top = tree.tops[k].join(tails, "g").select("g", "pos", "node", *[c for c in ("kid",) if k == 0], "proof", *carried)
        if known is None:
            here = top
        else:
            here = _children(tree.levels[k], known, tree.fanout, carried).unionByName(top)
        known = here if k == 0 else here.drop("node")
    return known


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, present) per row.

    A leaf is the digest of the row's fields. Within a value of ``group`` leaves ascend by id; every ``fanout``
    consecutive nodes become one until a single one is left, the group's subroot. Subroots in the order of their group
    (null first, by bytes) make the root likewise. ``proof`` is an array over the levels, from the leaf up to the root, of
    the siblings before and after the node. ``present`` is the leaf that the row has with the columns in ``now`` in place of
    its own, to hold against the manifest; the leaf itself without ``now``.

    Null ids come first in their group; rows with the same id follow one another by leaf and present leaf, so repeated rows
    get neighbouring places. A group of one row has that leaf as its subroot; where it is the only group, proofs are empty
    arrays. An empty table gives an empty result, other columns are ignored, fields may have any type that has a text.
    Texts are hashed in one pass; after it, only ids, groups and digests move. A group of a third of all rows is numbered and
    hashed in even ranges.
    """
    own = leaf([col(f) for f in fields])
    other = leaf([(now or {}).get(f, col(f)) for f in fields])
    # the group as a text that is never null and sorts null first
    g = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), g.alias("g"), own.alias("leaf"), *([other.alias("present")] if now else []))
    rows = numbered(fixed(rows), ["g"], ["doc_id", "leaf", *(["present"] if now else []), "tie"])
    kid = F.struct("doc_id", (F.col("present") if now else F.col("leaf")).alias("present"))
    tree = grow(rows.select("g", "n", "pos", F.col("leaf").alias("node"), kid.alias("kid")), fanout)

    subroots = tree.tops[0].select("g", "node")
    for top in tree.tops[1:]:
        subroots = subroots.unionByName(top.select("g", "node"))
    ranked = numbered(fixed(subroots), [], ["g", "tie"])
    above = grow(ranked.select(F.lit("").alias("g"), "n", "pos", "node", F.struct(F.col("g").alias("name")).alias("kid")), fanout)
    root = above.tops[-1].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("node").alias("root"))
    tails = paths(above, root, ["root"]).select(F.col("kid.name").alias("g"), F.col("node").alias("subroot"), "root", "proof")
    out = paths(tree, cut_lineage(tails), ["subroot", "root"])
    return out.select(F.col("kid.doc_id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof", F.col("kid.present").alias("present"))


def changed(old: DataFrame, new: DataFrame, group: str = "g") -> DataFrame:
    """Groups whose subroots differ between two tables of (group, subroot): what must be looked at when two roots differ."""
    a, b = old.select(col(group).alias("g"), F.col("subroot").alias("was")).distinct(), new.select(col(group).alias("h"), F.col("subroot").alias("is")).distinct()
    return a.join(b, F.col("g").eqNullSafe(F.col("h")), "full").where(~F.col("was").eqNullSafe(F.col("is"))).select(F.coalesce("g", "h").alias(group), "was", "is")


def upper_to_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, big, big.lower())


def tampered(doc_id: str = "doc_id", text: str = "text", part: int = 3) -> Column:
    """The text as it stands after tampering: lower-cased where ``part`` divides crc32 of the decimal id."""
    hit = F.crc32(col(doc_id).cast("string").cast("binary")) % part == 0
    return F.when(hit, upper_to_lower(col(text))).otherwise(col(text))
