"""A Merkle manifest of a table: every row's leaf, its group's root, the root of all, and the proof between them.

Rows are numbered within their group without bringing a group together: the table is sorted by ranges, and each range's place
follows from the counts of the ranges before it. Runs of three nodes become their hash; five levels are climbed at a time, in
blocks of 243 nodes. Proofs come by pointer jumping: a node first holds its run's other members, as far as its parent. Joined
with the node that its pointer leads to it reaches twice as far and holds both segments. A leaf needs, beside its own segment,
the node 1, 2, 4, 8, ... levels above it with the segment of 1, 2, 4, 8, ... levels; so levels that no leaf will ask for are
left out as the distance doubles, and leaves are joined only once a doubling.

Nulls: a null field is hashed as ``-``, a null group is a group of its own and comes first, a null id comes before all others.
Empty texts are fields of no bytes. Rows alike in id and group are ordered by their leaves; rows alike in all fields have
interchangeable places. A group of one row has its leaf for its root, a single group's root is the root of all. An empty
table has no rows and no root. Columns that aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Nodes in a run, and levels that are climbed at a time.
ARITY, LEVELS = 3, 5
#: Up to so many rows of short columns are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000
#: Of the rows that meet one group's proof, so many share a key.
CHUNK = 65_536


def digest_of(*texts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts, one behind the other."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def field_text(c: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon, and itself; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest_of(*map(field_text, fields))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _met(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``idx``, their place in their tree, and ``n``, the tree's rows; and the trees with their n."""
    held = durable(rows.repartitionByRange("tree", *order, "spread").sortWithinPartitions("tree", *order).drop("spread"))
    held = held.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    parts = held.groupBy("tree", "part").agg(F.min("at").alias("began"), F.count("*").alias("rows"))
    # one row for each tree and range that holds some of it: never more rows a tree than ranges
    parts = durable(parts.selectExpr("tree", "part", "began", "sum(rows) OVER (PARTITION BY tree ORDER BY part) - rows AS before", "sum(rows) OVER (PARTITION BY tree) AS n"))
    places = held.join(_met(parts, parts.count() <= BROADCAST_ROWS), ["tree", "part"])
    return places.withColumn("idx", F.col("before") + F.col("at") - F.col("began")).drop("part", "at", "began", "before"), parts.groupBy("tree").agg(F.first("n").alias("n"))


def _parents(nodes: Column, n: Column) -> Column:
    """The hashes of a block's runs; what is alone in its tree stays."""
    run = lambda i: F.sha2(F.concat_ws("", *(_hex(F.get(nodes, ARITY * i + k)) for k in range(ARITY))).cast("binary"), 256)
    places = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    return F.when(n > 1, F.transform(places, lambda i: F.unhex(run(i)))).otherwise(nodes)


def _segment(nodes: Column, i: Column) -> Column:
    """The other members of a node's run: those before it and those behind it."""
    nothing, place = F.lit(b""), i % ARITY
    others = lambda wanted: F.concat(*(F.when(wanted(F.lit(k)), F.coalesce(F.get(nodes, i - place + k), nothing)).otherwise(nothing) for k in range(ARITY)))
    return F.struct(others(lambda k: k < place).alias("before"), others(lambda k: k > place).alias("after"))


def _climbed(rows: DataFrame) -> DataFrame:
    """(tree, idx, n, digest, info) to blocks with the nodes of ``LEVELS`` levels, a0 (those given) to a5 (one node)."""
    width = ARITY**LEVELS
    blocks = rows.groupBy("tree", F.expr(f"idx div {width}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", "info"))).alias("members"))
    blocks = blocks.withColumn("a0", F.transform("members", lambda m: m["digest"])).withColumn("infos", F.transform("members", lambda m: m["info"])).drop("members")
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"a{k + 1}", _parents(F.col(f"a{k}"), _nodes_at(F.col("n"), k)))
    return durable(blocks)


def _nodes_at(n: Column, level: int) -> Column:
    """How many nodes a tree of n leaves has on a level."""
    return F.ceil(n / F.lit(float(ARITY**level))) if ARITY**level < 2**53 else F.lit(1)


def _level(blocks: DataFrame, k: int, level: int) -> DataFrame:
    """The nodes of array k, which have parents, with their segments."""
    start, a = F.col("block") * ARITY ** (LEVELS - k), F.col(f"a{k}")
    found = F.transform(a, lambda x, i: F.struct((start + i).alias("idx"), F.array(_segment(a, i)).alias("path")))
    return blocks.where(_nodes_at(F.col("n"), k) > 1).select("tree", F.lit(level).alias("level"), F.inline(found))


def _proved(leaves: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, idx, n, digest, info) to (tree, idx, n, digest, info, path) and (tree, subroot).

    A path holds, from the leaf upwards, the members of each run before and behind the node on the way to the root.
    """
    top = trees.agg(F.max("n")).first()[0] or 0
    depth = 0
    while ARITY**depth < top:
        depth += 1
    sizes = trees.agg(*(F.sum(F.when(_nodes_at(F.col("n"), k) > 1, _nodes_at(F.col("n"), k))).alias(f"k{k}") for k in range(depth + 1))).first()
    first = blocks = _climbed(leaves)
    above, roots, base = [], None, 0
    while True:
        above += [_level(blocks, k, base + k) for k in range(LEVELS) if 0 < base + k < depth]
        left = blocks.select("tree", F.col("block").alias("idx"), _nodes_at(F.col("n"), LEVELS).cast("long").alias("n"), F.get("a5", F.lit(0)).alias("digest"), F.lit(None).cast("int").alias("info"))
        done = left.where("n = 1").select("tree", F.col("digest").alias("subroot"))
        roots, base = done if roots is None else roots.unionAll(done), base + LEVELS
        if base >= depth:
            break
        blocks = _climbed(left.where("n > 1"))
    own = F.transform("a0", lambda x, i: F.struct((F.col("block") * ARITY**LEVELS + i).alias("idx"), x.alias("digest"), F.get("infos", i).alias("info"), F.when(F.col("n") > 1, F.array(_segment(F.col("a0"), i))).alias("path")))
    out = first.select("tree", "n", F.inline(own))
    jumps, reach = None, 1
    for nodes in above:
        jumps = nodes if jumps is None else jumps.unionAll(nodes)
    while reach < depth:
        # the node that a leaf's pointer leads to; with many leaves below, a level has few nodes, which are then broadcast
        far = jumps.where(F.col("level") == reach).select("tree", F.col("idx").alias("to"), F.col("path").alias("more"))
        out = _jumped(out, far, reach, (sizes[f"k{reach}"] or 0) <= BROADCAST_ROWS)
        if 2 * reach < depth:
            near = jumps.where(F.col("level") % (2 * reach) == 0)
            far = jumps.where(F.col("level") % (2 * reach) == reach).select("tree", (F.col("level") - reach).alias("level"), F.col("idx").alias("to"), F.col("path").alias("more"))
            jumps = durable(_jumped(near, far, reach, sum(sizes[f"k{k}"] or 0 for k in range(3 * reach, depth, 2 * reach)) <= BROADCAST_ROWS))
        reach *= 2
    return out, roots


def _jumped(nodes: DataFrame, far: DataFrame, reach: int, few: bool) -> DataFrame:
    """Nodes joined with those ``reach`` levels above, whose segments are put behind their own."""
    keys = ["tree", "to", *(["level"] if "level" in far.columns else [])]
    met = nodes.withColumn("to", F.expr(f"idx div {ARITY**reach}L")).join(_met(far, few), keys, "left")
    return met.withColumn("path", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))).select(*nodes.columns)


def merkle_manifest(df: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: id, ``leaf``, ``subroot``, ``root`` (hexadecimal) and ``path``, an array of (before, after) digests.

    carried: further columns, computed where the table is read and handed on.
    """
    own = {f"c{k}": c for k, c in enumerate((carried or {}).values())}
    group = F.col(f"`{group_col}`").cast("string")
    rows = df.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(leaf_of([F.col(f"`{c}`") for c in fields])).alias("digest"), F.monotonically_increasing_id().alias("spread"), *(c.alias(n) for n, c in own.items()),
    )
    placed, trees = _numbered(durable(rows), "id", "digest")
    leaves, roots = _proved(placed.select("tree", "idx", "n", "digest", F.struct("id", *own).alias("info")), trees)
    roots = durable(roots)
    tops, one = _numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("subroot").alias("digest"), F.lit(0).alias("spread")), "id")
    tops, root = _proved(tops.select("tree", "idx", "n", "digest", F.struct("id").alias("info")), one)
    found = root.first()
    tops = tops.select(F.col("info.id").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    if roots.count() <= BROADCAST_ROWS:
        out = leaves.join(F.broadcast(tops), "tree")
    else:  # a large group's row is there once for each chunk of its leaves
        copies = tops.join(trees, "tree").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}")))).drop("n")
        out = leaves.withColumn("chunk", F.expr(f"idx div {CHUNK}")).join(copies, ["tree", "chunk"])
    path = F.concat(*(F.coalesce(c, F.array().cast("array<struct<before:binary,after:binary>>")) for c in ("path", "upper")))
    return out.select(
        F.col("info.id").alias(id_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.lit(bytes(found[1]) if found else b"")).alias("root"), path.alias("path"),
        *(F.col(f"info.{n}").alias(name) for n, name in zip(own, carried or {}, strict=True)),
    )


def proof_digest(path: Column) -> Column:
    """The hash of all digests of a path, from the leaf upwards and from left to right."""
    return digest_of(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest_of(_hex(s["before"]), h, _hex(s["after"])))


def audited(df: DataFrame) -> DataFrame:
    """The manifest's digests, and for every row whether a fold of its path gives the root, for half of the rows after their
    text has lost its line breaks."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.unhex(F.when(hit, leaf_of([*(F.col(c) for c in fields[:-1]), F.translate(F.col("text").cast("string"), "\n", "")])))
    found = merkle_manifest(df, fields, carried={"tampered": tampered})
    found = found.withColumn("folded_root", folded(F.coalesce(_hex(F.col("tampered")), F.col("leaf")), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 14, upper: int = 4) -> str:
    """DuckDB's form, for groups of up to 3^levels rows and up to 3^upper groups."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    cut = fields.replace("AS VARCHAR)", "AS VARCHAR)").replace("CAST(text AS VARCHAR)", r"replace(text, chr(10), '')")
    step = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step})"

    def climb(name: str, first: str, depth: int) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(depth):
            out.append(f"{name}{k + 1} AS (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3)")
        for k in range(depth):
            run = f"(PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"
            out.append(f"{name}s{k} AS (SELECT g, i, n, list(d) OVER {run} AS o FROM {name}{k})")
        return out

    def path(name: str, depth: int, i: str) -> str:
        """For every node of the lowest level the (before, after) of each level below the root."""
        at = lambda k: f"({i} // {3**k})"
        joins = " ".join(f"JOIN {name}s{k} ON {name}s{k}.g = {name}0.g AND {name}s{k}.i = {at(k)}" for k in range(depth))
        each = ", ".join(f"CASE WHEN {name}s{k}.n > 1 THEN {{'b': array_to_string(coalesce({name}s{k}.o, [])[1:CAST({at(k)} % 3 AS INT)], ''), 'a': array_to_string(coalesce({name}s{k}.o, [])[CAST({at(k)} % 3 AS INT) + 1:], '')}} END" for k in range(depth))
        return f"SELECT {name}0.g, {name}0.i, {name}0.d, list_filter([{each}], lambda x: x IS NOT NULL) AS path FROM {name}0 {joins}"

    leaves = f"SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({fields}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN sha256({cut}) ELSE sha256({fields}) END AS changed FROM documents"
    parts = [
        f"l AS ({leaves})", "x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l)",
        *climb("t", "SELECT g, i, leaf AS d, n FROM x", levels), f"p AS ({path('t', levels, 't0.i')})",
        *climb("u", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS own FROM t{levels}", upper), f"q AS ({path('u', upper, 'u0.i').replace('SELECT u0.g', 'SELECT u0.own AS g', 1)})",
        f"y AS (SELECT x.doc_id, x.leaf, x.changed, q.d AS subroot, (SELECT d FROM u{upper}) AS root, list_concat(p.path, q.path) AS path FROM x JOIN p ON p.g = x.g AND p.i = x.i JOIN q ON q.g = x.g)",
        "z AS (SELECT *, list_reduce(list_concat([{'b': changed, 'a': ''}], path), lambda h, s: {'b': sha256(s.b || h.b || s.a), 'a': ''}).b AS folded_root FROM y)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z"
