"""Merkle manifest of a table: a hash tree over each group's rows and one over
the groups, with every row's proof checked against the root.

A row's leaf is the SHA-256 of its columns, each written as its UTF-8 byte
count, a colon and its value (``-`` if null).  Leaves are numbered within their
group by key; every ``FAN`` consecutive nodes become one parent until one node
is left.

A tree grows by blocks of ``FAN ** 2`` aligned nodes.  A block keeps each of its
levels as one string of hex digests, so that a parent is the hash of a
fixed-width substring and a node's siblings are the two substrings that flank
it in its run.  The digests of a group's blocks are the nodes of the next
round, until every group has one node: a round shrinks its table by 256, and
no task ever holds more than a block, however large a group is.  Going back, a
block hands its own flanks, those of all upper rounds, to its members.  The
groups' roots go through the same rounds as one group.

DataFrame operations only.  Rows are numbered by range partitions, so a group
that holds most rows spreads over many tasks; equal keys are ordered by leaf,
and rows equal in everything are interchangeable.

Defined results: null keys come first; a null group is a group of its own, the
first one; a group of one row has its leaf as root; an empty table has no rows;
columns that are not hashed are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import stored
from helixframe.operators.ranking import global_row_number

FAN = 16
BLOCK = FAN * FAN
HEX = 64  # letters of a digest


def digest(columns: list[Column]) -> Column:
    """SHA-256 over the columns' values, each with its length in front."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _cut(level: Column, start: Column, count) -> Column:
    """``count`` digests of a level from number ``start``; what lies beyond its end is left out."""
    return F.substring(level, (start * HEX + 1).cast("int"), (count * HEX if isinstance(count, Column) else F.lit(count * HEX)).cast("int"))


def _parents(level: Column, n: Column) -> Column:
    """The next level of a block of ``n`` nodes, as one string."""
    runs = F.sequence(F.lit(0), ((n - 1) / FAN).cast("int"))
    return F.concat_ws("", F.transform(runs, lambda r: F.sha2(_cut(level, r * FAN, FAN), 256))).cast("binary")


def _flanks(level: Column, at: Column) -> Column:
    """The siblings before and after node ``at`` in its run."""
    within = at % FAN
    return F.struct(_cut(level, at - within, within).cast("string").alias("l"), _cut(level, at + 1, F.lit(FAN - 1) - within).cast("string").alias("r"))


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its flanks, lowest level first, lead to."""
    return F.aggregate(path, start, lambda h, f: F.sha2(F.concat(f["l"], h, f["r"]), 256))


_PATH = "array<struct<l:string,r:string>>"


def _rounds(nodes: DataFrame, tag: str) -> DataFrame:
    """``nodes`` has grp, i (from 0 in its group), n (the group's nodes), d
    (digest) and ``x`` (a struct carried along).  Returns one row per block: grp, base, xs (the
    members' x), low (the block's level of nodes, as bytes), mid (its parents), n, up (flanks of the
    upper rounds) and root of the group."""
    block = F.floor(F.col("i") / BLOCK).cast("long")
    got = (nodes.groupBy("grp", block.alias("b"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "d", "x"))).alias("m"))
           .select("grp", "b", "n", F.transform("m", lambda m: m["x"]).alias("xs"), F.concat_ws("", F.transform("m", lambda m: m["d"])).cast("binary").alias("low")))
    got = got.withColumn("mid", F.when(F.col("n") > 1, _parents(F.col("low"), F.size("xs"))))
    top = F.when(F.col("n") > FAN, F.sha2("mid", 256)).when(F.col("n") > 1, F.col("mid").cast("string")).otherwise(F.col("low").cast("string"))
    got = stored(got.withColumn("top", top), f"{tag}-blocks")
    above = got.where(F.col("n") > BLOCK)
    if above.isEmpty():
        return got.select("*", F.array().cast(_PATH).alias("up"), F.col("top").alias("root")).drop("top")
    upper = members(_rounds(above.select("grp", F.col("b").alias("i"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("d"), F.struct("b").alias("x")), tag))
    upper = stored(upper.select("grp", F.col("x.b").alias("b"), F.col("path").alias("up"), "root"), f"{tag}-upper")
    out = got.join(upper, ["grp", "b"], "left")
    return out.withColumn("up", F.coalesce("up", F.array().cast(_PATH))).withColumn("root", F.coalesce("root", "top")).drop("top")


def _paths(at: Column) -> Column:
    """Flanks of member ``at`` of a block, its own levels and those above."""
    own = F.when(F.col("n") > FAN, F.array(_flanks(F.col("low"), at), _flanks(F.col("mid"), F.floor(at / FAN).cast("int"))))
    return F.concat(own.when(F.col("n") > 1, F.array(_flanks(F.col("low"), at))).otherwise(F.array().cast(_PATH)), F.col("up"))


def members(blocks: DataFrame) -> DataFrame:
    """One row per node of a tree: grp, x, d, path, root."""
    one = F.transform("xs", lambda x, j: F.struct(x.alias("x"), _cut(F.col("low"), j, 1).cast("string").alias("d"), _paths(j).alias("path")))
    return blocks.select("grp", "root", F.inline(one))


def manifest(rows: DataFrame, group: str, key: str, columns: dict[str, Column], tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof (its SHA-256), folded_root, verified``
    per row.  ``columns`` are hashed in their order.  Where ``when`` holds,
    ``folded_root`` starts from the row with ``tampered`` columns replaced."""
    leaf = digest(list(columns.values()))
    other = F.when(when, digest([(tampered or {}).get(c, v) for c, v in columns.items()])) if when is not None else F.lit(None).cast("string")
    leaves = stored(rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf.alias("d"), other.alias("t")), "leaves")
    numbered = global_row_number(leaves, [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("d")], "row")
    groups = numbered.groupBy("grp").agg(F.min("row").alias("first"), F.count("*").alias("n")).withColumnRenamed("grp", "name")
    groups = stored(global_row_number(groups, [F.col("first")], "g"), "groups")
    nodes = numbered.join(groups, F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("g").alias("grp"), (F.col("row") - F.col("first")).alias("i"), "n", "d", F.struct("key", "t").alias("x"))
    blocks = _rounds(nodes, "leaves")
    subroots = blocks.where("b = 0").select(F.lit(0).cast("long").alias("grp"), (F.col("grp") - 1).alias("i"), F.lit(groups.count()).cast("long").alias("n"), F.col("root").alias("d"), F.struct("grp").alias("x"))
    top = members(_rounds(subroots, "groups")).select(F.col("x.grp").alias("grp"), F.col("path").alias("top"), F.col("root").alias("whole"))
    blocks = blocks.join(stored(top, "roots"), "grp")
    path = lambda j: F.concat(_paths(j), F.col("top"))
    leaf_of = lambda j: _cut(F.col("low"), j, 1).cast("string")
    one = F.transform("xs", lambda x, j: F.struct(
        x["key"].alias("key"), leaf_of(j).alias("leaf"), F.sha2(F.concat_ws("", F.flatten(F.transform(path(j), lambda f: F.array(f["l"], f["r"])))), 256).alias("proof_sha256"),
        fold(F.coalesce(x["t"], leaf_of(j)), path(j)).alias("folded_root")))
    out = blocks.select(F.col("root").alias("subroot"), F.col("whole").alias("root"), F.inline(one))
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a ``documents`` table by source; rows whose id's CRC-32
    is divisible by 5 are checked with their text in lower case (A-Z alone)."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, "source", "doc_id", columns, {"text": low}, F.coalesce(bad, F.lit(False)))


def manifest_sql(leaf_levels: int = 6, group_levels: int = 3) -> str:
    """The same in SQL, level by level, for up to 16 ** leaf_levels rows of a
    source and 16 ** group_levels sources."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    crc = ("xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), "
           "lambda h, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)), 4294967295), 4294967295)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"leaf AS MATERIALIZED (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {leaf('text')} AS leaf, "
           f"CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS t FROM documents)",
           "num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf)",
           "a0 AS (SELECT g, i, n, leaf AS d FROM num)"]
    for k in range(leaf_levels):
        sql += [f"ra{k} AS MATERIALIZED (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, string_agg(d, '' ORDER BY i) AS s FROM a{k} WHERE n > 1 GROUP BY ALL)",
                f"a{k + 1} AS MATERIALIZED (SELECT g, i, n, sha256(s) AS d FROM ra{k})"]
    sql += ["sub AS MATERIALIZED (SELECT g, d FROM (" + " UNION ALL ".join(f"SELECT g, d FROM a{k} WHERE n = 1" for k in range(leaf_levels + 1)) + "))",
            "b0 AS (SELECT g AS i, count(*) OVER () AS n, d FROM sub)"]
    for k in range(group_levels):
        sql += [f"rb{k} AS MATERIALIZED (SELECT i // 16 AS i, (n + 15) // 16 AS n, string_agg(d, '' ORDER BY i) AS s FROM b{k} WHERE n > 1 GROUP BY ALL)",
                f"b{k + 1} AS MATERIALIZED (SELECT i, n, sha256(s) AS d FROM rb{k})"]
    sql.append("root AS (" + " UNION ALL ".join(f"SELECT d FROM b{k} WHERE n = 1" for k in range(group_levels + 1)) + ")")
    last, number = "p0", 0
    sql.append("p0 AS (SELECT doc_id, g, i, leaf, coalesce(t, leaf) AS h, '' AS proof FROM num)")
    for name, levels, at in (("ra", leaf_levels, "i"), ("rb", group_levels, "g")):
        for k in range(levels):
            number += 1
            at_k = f"(p.{at} // {16 ** k})"
            left, right = f"substr(r.s, 1, 64 * ({at_k} % 16))", f"substr(r.s, 64 * ({at_k} % 16) + 65)"
            sql.append(f"p{number} AS (SELECT p.* REPLACE (CASE WHEN r.s IS NULL THEN h ELSE sha256({left} || h || {right}) END AS h, "
                       f"proof || coalesce({left} || {right}, '') AS proof) FROM {last} p LEFT JOIN {name}{k} r ON r.i = p.{at} // {16 ** (k + 1)}" + (" AND r.g = p.g)" if name == "ra" else ")"))
            last = f"p{number}"
    return ("WITH " + ", ".join(sql) + f" SELECT doc_id, leaf, sub.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = root.d AS verified FROM {last} p JOIN sub USING (g), root")
