"""Messages that hang on each other by parent links, as chat exports have them, in the order of a walk by levels.

The walk goes from the root of each tree down, level by level, children in their order.  It
is not done level by level, though, as a chat is mostly one long chain: every node's link is
doubled in each round (to its parent's parent, and so on), so a tree of n nodes takes log2(n)
rounds.  On its way a link keeps how many steps it spans and, of steps below a node with
several children, which child it took; nodes of one level then sort by these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.graph import materialise

ROLES = ("user", "assistant", "system")
_MESSAGE = "struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>"
_EXPORT = f"struct<mapping:map<string,struct<parent:string,children:array<string>,message:{_MESSAGE}>>>"


def tree_order(nodes: DataFrame) -> DataFrame:
    """(tree, id, depth, path) of the nodes that the walk reaches; sorted by depth and path they are in its order.

    `nodes` is (tree, id, parent, place, at), ids unique in a tree: `place` is where the export
    lists a node, `at` where it stands among its parent's children.  The root is the first
    listed node without a parent in its tree.  Nodes under another root, and those in or below
    a cycle, which have no way up to the root, are not reached.
    """
    nodes = materialise(nodes.select("tree", "id", "parent", "place", "at"))
    ids = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(ids, ["tree", "parent"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    roots = linked.where("not known").groupBy("tree").agg(F.min(F.struct("place", "id"))["id"].alias("root"))
    forks = linked.where("known").groupBy("tree", "parent").agg(F.count("*").alias("children"))
    steps = linked.where("known").join(forks, ["tree", "parent"]).join(roots, "tree")
    turn = F.when(F.col("children") > 1, F.array(F.struct("at", "place"))).otherwise(F.array().cast("array<struct<at:long,place:long>>"))
    start = roots.select("tree", F.col("root").alias("id"), F.col("root").alias("up"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<at:long,place:long>>").alias("path"), "root")
    links = materialise(steps.where("id <> root").select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), turn.alias("path"), "root").unionByName(start))
    most = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(int(most).bit_length()):
        open_ = links.where("up <> root")
        if not open_.limit(1).count():
            break
        above = links.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("path").alias("head"))
        doubled = open_.join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("head", "path").alias("path"), "root")
        links = materialise(links.where("up = root").unionByName(doubled))
    return links.where("up = root").select("tree", "id", "depth", "path")


def ordered_messages(nodes: DataFrame) -> DataFrame:
    """(tree, position, id, role, text, at_s): the messages of each tree in the walk's order, those of known roles that have a text.

    `nodes` is as for tree_order(), with role, text and at_s (seconds, may be null).
    """
    said = nodes.where(F.col("role").isin(*ROLES)).withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where(F.length("text") > 0)
    walk = tree_order(nodes.select("tree", "id", "parent", "place", "at"))
    position = F.row_number().over(W.partitionBy("tree").orderBy("depth", "path")) - 1
    return said.select("tree", "id", "role", "text", "at_s").join(walk, ["tree", "id"]).select("tree", position.alias("position"), "id", "role", "text", "at_s")


def export_nodes(raw: DataFrame) -> DataFrame:
    """Nodes of chat exports (file, text): a JSON object with a mapping of nodes, or a list of such, in each text.

    A node hangs under the first listed one that names it as a child, else under its own
    parent link; parts of a message that are no strings are left out.
    """
    listed = F.from_json("text", f"array<{_EXPORT}>")
    one = F.array(F.from_json("text", _EXPORT))
    docs = raw.select("file", F.posexplode(F.when(F.col("text").rlike(r"^\s*\["), listed).otherwise(one)).alias("n", "conv"))
    docs = docs.select(F.concat_ws("#", "file", F.col("n").cast("string")).alias("tree"), F.posexplode(F.map_entries("conv.mapping")).alias("place", "e"))
    entries = docs.select("tree", F.col("place").cast("long").alias("place"), F.col("e.key").alias("id"), F.col("e.value").alias("v"))
    children = entries.select("tree", F.struct("place", "id").alias("of"), F.posexplode("v.children").alias("at", "child"))
    first = children.groupBy("tree", F.col("child").alias("id")).agg(F.min(F.struct("of", "at")).alias("c"))
    parts = F.filter(F.coalesce("v.message.content.parts", F.array().cast("array<string>")), lambda p: p.isNotNull() & ~p.startswith("{"))
    out = entries.join(first, ["tree", "id"], "left")
    return out.select("tree", "id", F.coalesce("c.of.id", "v.parent").alias("parent"), "place", F.coalesce("c.at", "place").cast("long").alias("at"), F.col("v.message.author.role").alias("role"), F.array_join(parts, "\n").alias("text"), F.col("v.message.create_time").alias("at_s"))
