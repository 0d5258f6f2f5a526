"""Merkle manifest of a dataset: trees of sixteen children per source, and one over the sources, with a proof per row.

A row is a leaf: sha256 of its columns, each as length:value, nulls as "-".  Leaves of a group are ranked without gathering
it: rows are dealt by ranges of (group, order), numbered inside their part, and the numbers of the parts before are added.
The digits of the rank to base 16 are then grouped away: rows with equal higher digits become an array of children in a
parent's struct, parents an array in a block's.  A block spans two digits, 256 rows, so no row grows with the data; what
is left of its hash goes on as a row of the next level, and so on until each group has one node.

Proofs go down the same way.  A block gets the siblings above it as one more row of its group, so that an aggregation by
block, not a join, brings them together; then a transform over the nested children adds the siblings inside the block and
explode emits a row per child.  folded() works a root out again from a leaf and its siblings.

Null ids come first in the order, equal ids go by leaf and by the tampered leaf; rows that are equal in all of that are
interchangeable.  A null source is a group of its own, before all others.  A null text is "-" and isn't tampered with, an
empty one is "0:"; texts of any length are hashed where they are read and never shuffled; other columns don't matter,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discarded, stored

#: Children of a node, rows of a block, and the bits of a rank that a digit and a block take.
FAN, BLOCK, DIGIT_BITS, BLOCK_BITS = 16, 256, 4, 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level of a path: the digests left and right of a node among its parent's children; null where no parent is made.
LEVEL = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """length:value, the length in bytes; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[str], **other: Column) -> Column:
    return digest(*(field(other.get(c, F.col(c))) for c in fields))


def leaves(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", part: int = 5) -> DataFrame:
    """g (the group's name with a 1 in front, 0 if null), id, leaf, and found: the leaf of the row as it is found after tampering.

    Tampering puts A-Z of the text in lower case where part divides the crc32 of the id."""
    found = F.when(crc_bucket(key, part) == 0, leaf_of(fields, **{text: F.translate(text, UPPER, LOWER)})).otherwise(F.col("leaf"))
    rows = docs.select(*dict.fromkeys([*fields, key, group, text])).withColumn("leaf", leaf_of(fields))
    return rows.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"), F.col(key).alias("id"), "leaf", found.alias("found"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with r, the rank from 0 in its group, and n, the group's size; and the folder that it is read from.

    Rows are dealt by ranges; rows equal in group and order are told apart by a number, so they may be dealt as well."""
    once, first = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), "manifest-rows")
    dealt = once.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    held, path = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "manifest-ranked")
    discarded(rows.sparkSession, first)
    part = F.shiftright("_at", 33).alias("_part")
    sizes = held.groupBy(group, part).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_m"))
    # rows of a group here: parts that hold some of it, packed in one array each
    packed = sizes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_part", "_low", "_m"))).alias("_parts"))
    running = F.aggregate("_parts", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<p:bigint,base:bigint>>").alias("out")),
        lambda acc, x: F.struct((acc["n"] + x["_m"]).alias("n"), F.concat(acc["out"], F.array(F.struct(x["_part"].alias("p"), (acc["n"] - x["_low"]).alias("base")))).alias("out")))
    bases = packed.select(group, running.alias("_s")).select(group, F.col("_s.n").alias("n"), F.explode("_s.out").alias("_b")).select(group, "n", F.col("_b.p").alias("_part"), F.col("_b.base").alias("_base"))
    out = held.withColumn("_part", part).join(bases, [group, "_part"])
    return out.select(*rows.columns, (F.col("_at") + F.col("_base")).alias("r"), "n"), [path]


def parent(several: Column, hashes: Column) -> Column:
    """The digest over the children, or the only one's own where nothing is left to be joined."""
    return F.when(several, F.sha2(F.array_join(hashes, ""), 256)).otherwise(F.get(hashes, F.lit(0)))


def nested(nodes: DataFrame) -> DataFrame:
    """g, block, n, h and mids from nodes (g, r, n, h, p): two digits of the rank grouped away, one after the other."""
    rows = nodes.select("g", "n", "h", "p", F.shiftright("r", BLOCK_BITS).alias("block"), (F.shiftright("r", DIGIT_BITS) % FAN).cast("int").alias("d1"), (F.col("r") % FAN).cast("int").alias("d0")).repartition("g", "block")
    kids = rows.groupBy("g", "block", "d1").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("d0", "h", "p"))).alias("kids"))
    kids = kids.withColumn("h", parent(F.col("n") > 1, F.col("kids.h")))
    mids = kids.groupBy("g", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("d1", "h", "kids"))).alias("mids"))
    return mids.withColumn("h", parent(F.col("n") > FAN, F.col("mids.h"))).select("g", "block", "n", "h", "mids")


def rolled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """The nested blocks of each level from the leaves up, one node per group at last, and the folders they are read from."""
    levels, folders = [], []
    while True:
        blocks, path = stored(nested(nodes), "manifest-blocks")
        levels.append(blocks)
        folders.append(path)
        nodes = blocks.select("g", F.col("block").alias("r"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "h")
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return levels, nodes, folders
        nodes = nodes.withColumn("p", F.lit(None).cast("string"))


def siblings(hashes: Column, at: Column, several: Column) -> Column:
    """The digests left and right of place at (from 0) among its parent's children."""
    left, right = F.slice(hashes, F.lit(1), at), F.slice(hashes, at + 2, F.lit(FAN))
    return F.when(several, F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r")))


def proofs(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """g, r, h, p, path and up of each node in blocks, from above (g, block, path, up): path has a level of siblings per
    parent from the node to the top, up is whatever above brings along."""
    one = blocks.select("g", "block", "n", "mids", F.lit(None).cast(above.schema["path"].dataType).alias("path"), F.lit(None).cast(above.schema["up"].dataType).alias("up"))
    two = above.select("g", "block", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast(blocks.schema["mids"].dataType).alias("mids"), "path", "up")
    met = one.unionByName(two).repartition("g", "block").groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "mids", "path", "up")))
    within = lambda m, i: F.transform(m["kids"], lambda k, j: F.struct(
        (F.col("block") * BLOCK + m["d1"] * FAN + k["d0"]).alias("r"), k["h"].alias("h"), k["p"].alias("p"),
        F.array(siblings(m["kids"]["h"], j, F.col("n") > 1), siblings(F.col("mids")["h"], i, F.col("n") > FAN)).alias("own")))
    rows = met.select("g", "path", "up", F.explode(F.flatten(F.transform("mids", within))).alias("x"))
    path = F.concat(F.filter(F.col("x.own"), lambda s: s.isNotNull()), F.col("path"))
    return rows.select("g", "x.r", "x.h", "x.p", path.alias("path"), "up")


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """proofs() from the highest level down to the leaves."""
    for blocks in levels[:0:-1]:
        above = proofs(blocks, above).select("g", F.col("r").alias("block"), "path", "up")
    return proofs(levels[0], above)


def folded(leaf: Column, path: Column) -> Column:
    """The root that leaf and siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["l"], acc, s["r"]))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", part: int = 5) -> DataFrame:
    """The key, leaf, subroot, root, proof_sha256, folded_root (from the leaf that is found after tampering) and verified."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    rows, spent = ranked(leaves(docs, fields, key, group, text, part), "g", ["id", "leaf", "found"])
    levels, tops, _ = rolled(rows.select("g", "r", "n", F.col("leaf").alias("h"), F.struct("id", "found").alias("p")))
    groups, more = ranked(tops.select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("h").alias("subroot")), "all", ["name"])
    over, root, folders = rolled(groups.select(F.lit("").alias("g"), "r", "n", F.col("subroot").alias("h"), F.col("name").alias("p")))
    # the node of all groups has nothing above it
    whole = root.select("g", F.lit(0).cast("bigint").alias("block"), F.array().cast(f"array<{LEVEL}>").alias("path"), F.col("h").alias("up"))
    sources = descended(over, whole).select(F.col("p").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", F.struct(F.col("h").alias("subroot"), F.col("up").alias("root")).alias("up"))
    above, path = stored(sources, "manifest-sources")
    for folder in (*spent, *more, *folders):
        discarded(spark, folder)
    out = descended(levels, above)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = out.select(F.col("p.id").cast(kind).alias(key), F.col("h").alias("leaf"), F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"), proof.alias("proof_sha256"), folded(F.col("p.found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32(text: str) -> str:
    """crc32 of ASCII text in SQL: eight steps a character, the first of which takes the character in."""
    steps = f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"


def oracle(depth: int = 5, over: int = 3) -> str:
    """The same in SQL over the documents table, for up to 16^depth rows a source and 16^over sources."""

    def leaf(text: str) -> str:
        cols = {"doc_id": "CAST(doc_id AS VARCHAR)", "source": "source", "lang": "lang", "n_chars": "CAST(n_chars AS VARCHAR)", "text": text}
        return "sha256(" + " || ".join(f"COALESCE(strlen({x}) || ':' || {x}, '-')" for x in cols.values()) + ")"

    def up(name: str, k: int, group: str) -> str:
        low = f"{name}{k}"
        return f"""{name}{k + 1} AS (SELECT {group}, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (max(n) + 15) // 16 AS n FROM {low} GROUP BY ALL),
        {name}s{k} AS (SELECT a.{group}, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, max(a.n) > 1 AS several
            FROM {low} a JOIN {low} b ON a.{group} = b.{group} AND a.i // 16 = b.i // 16 GROUP BY ALL)"""

    lower = "text"
    for x, y in zip(UPPER, LOWER, strict=True):
        lower = f"replace({lower}, '{x}', '{y}')"
    parts = [f"""d AS (SELECT doc_id, COALESCE('1' || source, '0') AS g, {leaf('text')} AS leaf, {leaf(f'({lower})')} AS low FROM documents),
        a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d)""", *(up("a", k, "g") for k in range(depth)),
        f"b0 AS (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a{depth})", *(up("b", k, "g") for k in range(over))]
    steps = [(f"as{k}", f"x.i // {16 ** k} = {{}}.i AND x.g = {{}}.g") for k in range(depth)] + [(f"bs{k}", f"s.i // {16 ** k} = {{}}.i") for k in range(over)]
    joins = " ".join(f"JOIN {t} t{j} ON {on.replace('{}', f't{j}')}" for j, (t, on) in enumerate(steps))
    proof = " || ".join(f"CASE WHEN t{j}.several THEN t{j}.l || t{j}.r ELSE '' END" for j in range(len(steps)))
    parts.append(f"j AS (SELECT x.*, s.h AS subroot, (SELECT h FROM b{over}) AS root, {proof} AS proof, {', '.join(f't{j}.l AS l{j}, t{j}.r AS r{j}, t{j}.several AS s{j}' for j in range(len(steps)))} FROM a0 x JOIN b0 s ON s.name = x.g {joins})")
    parts.append(f"f0 AS (SELECT *, CASE WHEN {crc32("COALESCE(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN low ELSE leaf END AS f FROM j)")
    parts += [f"f{j + 1} AS (SELECT * EXCLUDE (f), CASE WHEN s{j} THEN sha256(l{j} || f || r{j}) ELSE f END AS f FROM f{j})" for j in range(len(steps))]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"
