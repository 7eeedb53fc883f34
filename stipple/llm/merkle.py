"""Merkle manifest of a table: digests of rows, roots of groups, proofs.

Every node carries the interval [lo, hi) of leaf ranks that it covers.  A
level is made from the one below by grouping the intervals that fall into one
of its buckets.  Proofs come from containment joins: items (leaves, later the
nodes of every third level) meet the nodes of the next three levels in the
bucket of the highest of them and keep those whose interval contains theirs;
the children of such a node whose interval lies outside the item's are its
siblings.  What lies above a bucket is attached once per bucket, not per leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.order import numbered
from stipple.session import Scratch

#: children of a node
FAN = 3
#: levels that one containment join attaches
BAND = 3
#: copies of a repeated row that one array may hold
CHUNK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def _digest(children: Column) -> Column:
    """Digest of the digests of nodes in order."""
    return F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256)


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FAN ** level}")


def _levels(store: Scratch, label: str, leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes per level: tree, lo, hi, n, hash and, above the leaves, their children.

    ``leaves`` has tree, lo, hi, n, hash.  A tree ends with the node that covers its n leaves.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while FAN ** (len(levels) - 1) < largest:
        below = levels[-1].where("hi - lo < n").select("tree", _bucket(len(levels)).alias("b"), "lo", "hi", "n", "hash")
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "hash")))  # at most FAN
        level = below.groupBy("tree", "b").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"), children.alias("children"))
        levels.append(store.save(level.drop("b").withColumn("hash", _digest(F.col("children"))), f"{label}{len(levels)}"))
    return levels


def _attach(items: DataFrame, levels: list[DataFrame], at: int, above: DataFrame) -> DataFrame:
    """Adds ``path`` to items of level ``at`` (tree, lo and others): what stands left and right of it up to the root.

    ``above`` holds for every bucket of the next band (tree, bucket) the path
    of what covers it, and other columns, which the items take over.
    """
    top = at + BAND
    nodes = None
    for level, table in enumerate(levels[at + 1:top + 1], at + 1):
        part = table.select(F.col("tree").alias("_t"), _bucket(top).alias("_b"), F.lit(level).alias("level"),
                            F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "children")
        nodes = part if nodes is None else nodes.unionByName(part)
    items = items.withColumn("bucket", _bucket(top))
    if nodes is None:
        found = items.withColumn("own", F.array().cast("array<struct<level:int,left:string,right:string>>"))
    else:
        contains = (F.col("tree") == F.col("_t")) & (F.col("bucket") == F.col("_b")) & (F.col("_lo") <= F.col("lo")) & (F.col("lo") < F.col("_hi"))

        def beside(side) -> Column:
            return F.array_join(F.transform(F.filter("children", side), lambda c: c["hash"]), "")

        siblings = F.struct("level", beside(lambda c: c["hi"] <= F.col("lo")).alias("left"),
                            beside(lambda c: c["lo"] > F.col("lo")).alias("right"))
        others = [c for c in items.columns if c not in ("tree", "bucket", "lo")]
        found = items.join(nodes, contains, "left").withColumn("s", F.when(F.col("level").isNotNull(), siblings)).groupBy(
            "tree", "bucket", "lo").agg(*[F.first(c).alias(c) for c in others], F.sort_array(F.collect_list("s")).alias("own"))
    steps = F.transform("own", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    return found.join(above.withColumnRenamed("path", "_above"), ["tree", "bucket"]).withColumn(
        "path", F.concat(steps, "_above")).drop("bucket", "own", "_above")


def _paths(store: Scratch, label: str, items: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Adds the ``path`` up to the root of everything to the leaves ``items``; ``top`` has one row a tree with the path of its root."""
    above = top.withColumn("bucket", F.lit(0).cast("bigint"))
    bands = [at for at in range(0, max(1, len(levels) - 1), BAND)]
    for at in reversed(bands[1:]):
        # a tree that ended lower goes on with its root
        rows = levels[at].select("tree", "lo")
        for lower in levels[:at]:
            rows = rows.unionByName(lower.where("hi - lo = n").select("tree", "lo"))
        above = store.save(_attach(rows, levels, at, above).withColumn("bucket", _bucket(at)).drop("lo"), f"{label}{at}")
    return _attach(items, levels, 0, above)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS,
             altered: dict[str, Column] | None = None) -> DataFrame:
    """The key column, leaf, other_leaf, subroot, root and path of every row.

    A leaf is the digest of the ``fields``; leaves ascend by key within their
    group, and runs of three nodes become their digest until one is left, the
    subroot; the subroots in the order of their groups (null first, by UTF-8
    bytes) give the root in the same way.  ``path`` holds the siblings on the
    way to the root as concatenated digests, (left, right) a level.
    ``altered`` replaces fields by other expressions; other_leaf is the digest
    of the row with them.

    Null fields have their own code; a null key comes first in its group.
    Rows of one key are ordered by their digests; repeated rows are leaves
    each.  Other columns are left out, whatever their names.  An empty table
    gives an empty manifest.
    """
    store = Scratch(docs.sparkSession, "manifest")
    altered = altered or {}
    rows = docs.select(
        F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("hash"),
        (leaf_digest([altered.get(f, F.col(f)) for f in fields]) if altered else F.lit(None).cast("string")).alias("other"))
    # repeated rows are counted first, so that no range has to hold a hot one
    once = rows.groupBy("tree", "key", "hash", "other").agg(F.count(F.lit(1)).alias("c"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(c - 1) div {CHUNK}")))
    each = once.withColumn("chunk", chunk).withColumn("copy", F.explode(F.sequence(
        F.col("chunk") * CHUNK, F.least(F.col("c"), (F.col("chunk") + 1) * CHUNK) - 1))).drop("c", "chunk")
    ranked = numbered(each, ["key", "hash", "other", "copy"], by=["tree"], name="lo", size="n")
    leaves = store.save(ranked.select("tree", "key", "lo", (F.col("lo") + 1).alias("hi"), "n", "hash", "other"), "leaves")
    levels = _levels(store, "level", leaves)

    roots = None
    for level in levels:
        part = level.where("hi - lo = n").select(F.col("tree").alias("group"), "hash")
        roots = part if roots is None else roots.unionByName(part)
    tops = numbered(roots, ["group"], name="lo", size="n").select(
        F.lit("").alias("tree"), "group", "lo", (F.col("lo") + 1).alias("hi"), "n", "hash")
    tops = store.save(tops, "tops")
    upper = _levels(store, "upper", tops)
    last = upper[-1].where("hi - lo = n")
    root = last.select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    over = _paths(store, "over", tops.select("tree", "group", "lo", F.col("hash").alias("subroot")), upper, root)
    over = store.save(over.select(F.col("group").alias("tree"), "subroot", "root", "path"), "groups")
    out = _paths(store, "path", leaves.select("tree", "key", "lo", "hash", "other"), levels, over)
    return out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("other").alias("other_leaf"),
                      "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of the siblings from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def audit(docs: DataFrame, altered: dict[str, Column], key: str = "doc_id", **names) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified: does the altered row still lead to the root?"""
    m = manifest(docs, key, altered=altered, **names)
    return m.select(key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    folded(F.col("other_leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text without line ends where 2 divides the crc32 of the key as text, else as it is."""
    even = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))


def audit_sql() -> str:
    """DuckDB text of the audit of ``documents`` with tampered texts."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    crc = """CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i:
      CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS BIGINT)"""
    plain = " || ".join(field(c) for c in FIELDS)
    other = " || ".join(field("t2" if c == "text" else c) for c in FIELDS)
    return f"""
WITH RECURSIVE d0 AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND xor({crc}, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END t2 FROM documents),
d1 AS (SELECT doc_id, coalesce('=' || source, '') tree, sha256({plain}) leaf, sha256({other}) leaf2 FROM d0),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, leaf2) - 1 r, count(*) OVER (PARTITION BY tree) n FROM d1),
up AS (
  SELECT tree, 0 lev, r, n c, leaf h FROM leaves
  UNION ALL
  SELECT tree, lev + 1, r // 3, (any_value(c) + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM up WHERE c > 1 GROUP BY tree, lev, r // 3),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 r, count(*) OVER () n FROM up WHERE c = 1),
top AS (
  SELECT 0 lev, r, n c, h FROM subroots
  UNION ALL
  SELECT lev + 1, r // 3, (any_value(c) + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM top WHERE c > 1 GROUP BY lev, r // 3),
node AS (SELECT tree, lev, r, h FROM up WHERE c > 1 UNION ALL SELECT '/', lev, r, h FROM top WHERE c > 1),
at_level AS (SELECT tree, lev, r, coalesce(string_agg(s, '' ORDER BY q) FILTER (q < r), '') a, coalesce(string_agg(s, '' ORDER BY q) FILTER (q > r), '') b
  FROM (SELECT x.*, y.r q, y.h s FROM node x LEFT JOIN node y ON x.tree = y.tree AND x.lev = y.lev AND x.r // 3 = y.r // 3 AND x.r <> y.r) GROUP BY ALL),
heights AS (SELECT tree, max(lev) top_lev FROM up GROUP BY tree),
steps AS (
  SELECT l.tree, l.r leaf_r, s.lev step, s.a, s.b FROM leaves l JOIN at_level s ON s.tree = l.tree AND s.r = l.r // CAST(3 ** s.lev AS BIGINT)
  UNION ALL
  SELECT l.tree, l.r, h.top_lev + s.lev, s.a, s.b FROM leaves l JOIN heights h USING (tree) JOIN subroots q ON q.tree = l.tree
    JOIN at_level s ON s.tree = '/' AND s.r = q.r // CAST(3 ** s.lev AS BIGINT)),
fold AS (
  SELECT tree, r, 0 step, leaf2 h FROM leaves
  UNION ALL
  SELECT f.tree, f.r, f.step + 1, sha256(s.a || f.h || s.b) FROM fold f JOIN steps s ON s.tree = f.tree AND s.leaf_r = f.r AND s.step = f.step),
folded AS (SELECT tree, r, arg_max(h, step) h FROM fold GROUP BY ALL),
proof AS (SELECT tree, leaf_r r, sha256(string_agg(a || b, '' ORDER BY step)) p FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, q.h subroot, t.h root, coalesce(p.p, sha256('')) proof_sha256, f.h folded_root, f.h = t.h verified
FROM leaves l JOIN subroots q USING (tree) JOIN top t ON t.c = 1 JOIN folded f ON f.tree = l.tree AND f.r = l.r LEFT JOIN proof p ON p.tree = l.tree AND p.r = l.r
"""
