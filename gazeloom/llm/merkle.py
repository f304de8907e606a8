"""A Merkle manifest of a dataset by nested-struct rollup.

Rows of a group are ranked; rank / BLOCK is a row's block, and the base-3 digits of what remains say where
it is in the block's tree. The digits are grouped away one after the other: each grouping collects up to
three child structs, in order, into a struct of their parent, until a block is one nested struct. As
rows are dealt out by (group, block) once, no grouping after it shuffles. The blocks' digests are the rows
of the next round, until a group is one block, and the groups' digests are the rows of one last tree.

Proofs go down the same structs: a transform for each level hands every child the digests beside it and
all that was handed to its parent, and an explode emits the rows. What a block receives from the round
above meets it by grouping (a union of blocks and handed-down paths), so there are no joins here. A group
that is a third of all rows is many blocks of at most BLOCK rows each, and no task holds more than
its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

FAN_OUT, LEVELS = 3, 6
#: Rows of a block.
BLOCK = FAN_OUT**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field of a leaf: `-` for null, else its UTF-8 bytes counted, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """df, written in the order of group (null first) and by, with each row's rank in its group from 0, its group's
    size and the group's own rank among groups. Rows are numbered inside range partitions, so a group may
    be spread over many; the table of partitions and groups that shifts the numbers has a row for
    each group and for each partition, and is broadcast only if counted small."""
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in by]]
    placed = cut(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    each = Window.partitionBy(group)
    sums = runs.withColumns({"_before": F.sum("_n").over(each.orderBy("_part")) - F.col("_n"), "_size": F.sum("_n").over(each)})
    runs = cut(sums.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (F.col("_before") - F.col("_first")).alias("_shift"), "_size"), "runs")
    joined = placed.join(small(runs), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_g", "_shift")


def _levels(size: Column) -> Column:
    """How many times nodes of a group of this size become fewer until one is left, LEVELS at most."""
    return sum((F.when(size > FAN_OUT**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def roll_up(rows: DataFrame) -> DataFrame:
    """rows: (group, rank, size, hash, item), a row a node; size is the group's. (group, block, size, tree): tree
    is a struct of hash and kids, nested LEVELS deep, its innermost kids hash and item. Levels that a
    small group doesn't need pass their only child's hash on."""
    rest = F.col("rank") % BLOCK
    digits = {f"_d{k}": F.floor(rest / FAN_OUT**k).cast("int") % FAN_OUT for k in range(LEVELS)}
    nodes = rows.withColumn("block", F.floor(F.col("rank") / BLOCK)).repartition("group", "block")
    nodes = nodes.select("group", "block", "size", *[c.alias(n) for n, c in digits.items()], F.struct("hash", "item").alias("tree"))
    for k in range(LEVELS):
        above = [f"_d{j}" for j in range(k + 1, LEVELS)]
        kids = nodes.groupBy("group", "block", "size", *above).agg(F.sort_array(F.collect_list(F.struct(f"_d{k}", "tree"))).alias("_kids"))
        kids = kids.withColumn("_kids", F.transform("_kids", lambda x: x["tree"]))
        hashes = F.array_join(F.transform("_kids", lambda x: x["hash"]), "")
        own = F.when(_levels(F.col("size")) > k, F.sha2(hashes, 256)).otherwise(F.col("_kids")[0]["hash"])
        nodes = kids.select("group", "block", "size", *above, F.struct(own.alias("hash"), F.col("_kids").alias("kids")).alias("tree"))
    return nodes


def _step(left: Column, right: Column) -> Column:
    """What a node is handed at a level: the digests before and after it."""
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def _no_steps() -> Column:
    return F.slice(_step(F.lit(""), F.lit("")), F.lit(1), F.lit(0))


def _beside(hashes: Column, i: Column) -> Column:
    return _step(F.array_join(F.slice(hashes, F.lit(1), i), ""), F.array_join(F.slice(hashes, i + 2, F.lit(FAN_OUT)), ""))


def _kids_of(deep: Column):
    """A node's kids with what each is handed; nothing from this level unless deep."""

    def kids(node: Column) -> Column:
        hashes = F.transform(node["node"]["kids"], lambda x: x["hash"])
        step = lambda i: F.when(deep, _beside(hashes, i)).otherwise(_no_steps())
        return F.transform(node["node"]["kids"], lambda x, i: F.struct(x.alias("node"), F.concat(step(i), node["path"]).alias("path")))

    return kids


def hand_down(trees: DataFrame) -> DataFrame:
    """trees: (group, block, size, tree, above), above a struct of path and whatever the rows' reader wants handed
    on (top). (group, size, hash, item, path, top) for every row of the blocks, path from the row upwards."""
    level = F.array(F.struct(F.col("tree").alias("node"), F.col("above.path").alias("path")))
    out = trees.select("group", "size", F.col("above.top").alias("top"), level.alias("nodes"))
    for k in reversed(range(LEVELS)):
        out = out.select("group", "size", "top", F.flatten(F.transform("nodes", _kids_of(_levels(F.col("size")) > k))).alias("nodes"))
    return out.select("group", "size", "top", F.explode("nodes").alias("_n")).select("group", "size", F.col("_n.node.hash").alias("hash"), F.col("_n.node.item").alias("item"), F.col("_n.path").alias("path"), "top")


def _one_tree(rows: DataFrame, what: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of roll_up until every group is one block: the rounds' trees, written, and (group, hash)."""
    rounds = []
    while True:
        rounds.append(cut(roll_up(rows), what))
        tops = rounds[-1].select("group", "block", "size", F.col("tree.hash").alias("hash"))
        if tops.filter("block > 0").isEmpty():
            return rounds, tops.select("group", "hash")
        # A round's blocks are the next one's rows; a group with one block is done and passes through.
        size = F.ceil(F.col("size") / BLOCK)
        rows = tops.select("group", F.col("block").alias("rank"), size.alias("size"), "hash", F.col("block").alias("item"))


def _meet(trees: DataFrame, above: DataFrame) -> DataFrame:
    """trees with what is handed to them: above (group, block, above), by grouping."""
    trees = trees.withColumn("above", F.lit(None).cast(above.schema["above"].dataType))
    handed = above.select("group", "block", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast(trees.schema["tree"].dataType).alias("tree"), "above")
    both = trees.select(handed.columns).unionByName(handed).groupBy("group", "block")
    return both.agg(F.max("size").alias("size"), *[F.element_at(F.collect_list(c), 1).alias(c) for c in ("tree", "above")])


def manifest(docs: DataFrame) -> DataFrame:
    """A Merkle tree over docs (doc_id, source, lang, n_chars, text; other columns are ignored): a leaf a
    row, a tree of fan-out 3 a source (leaves by doc_id, null first; rows of one id by their digest, so that
    repeated rows are leaves of their own beside each other), and one over the sources (null first).
    Null and empty fields have different leaves; an empty table gives an empty result.
    Rows with a CRC-32 of doc_id divisible by 2 are checked with the line feeds of their text taken out, rows
    without id as they are.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (from the checked row), verified."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    leaf = lambda text: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    bare = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = given.select("doc_id", "source", leaf(F.col("text")).alias("hash"), bare.alias("now"))
    rows = ranked(leaves, "source", ["doc_id", "hash"])
    rows = rows.select(F.col("source").alias("group"), F.col("_rank").alias("rank"), F.col("_size").alias("size"), "hash", F.struct("doc_id", "now").alias("item"))
    rounds, subroots = _one_tree(rows, "trees")
    tops = ranked(subroots.select(F.lit(0).alias("all"), F.col("group").alias("source"), "hash"), "all", ["source"])
    tops = tops.select(F.col("all").alias("group"), F.col("_rank").alias("rank"), F.col("_size").alias("size"), "hash", F.col("source").alias("item"))
    upper, root = _one_tree(tops, "sources")
    handed = root.select("group", F.lit(0).cast("bigint").alias("block"), F.struct(_no_steps().alias("path"), F.col("hash").alias("top")).alias("above"))
    for trees in reversed(upper):
        down = hand_down(_meet(trees, handed))
        handed = down.select("group", F.col("item").alias("block"), F.struct("path", "top").alias("above"))
    handed = down.select(F.col("item").alias("group"), F.lit(0).cast("bigint").alias("block"), F.struct("path", F.struct(F.col("top").alias("root"), F.col("hash").alias("subroot")).alias("top")).alias("above"))
    for trees in reversed(rounds):
        down = hand_down(_meet(trees, handed))
        handed = down.select("group", F.col("item").alias("block"), F.struct("path", "top").alias("above"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("item.now", "hash"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = down.select(F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
