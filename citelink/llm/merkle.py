"""A Merkle manifest of a dataset: parents keep their children's digests as one string, and leaves join their ancestors' strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.llm.common import crc32_sql, read_table
from citelink.sources.scratch import dropped, stored

#: Children of a node, and hexadecimal digits of a digest.
FANOUT, DIGITS = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:int>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """The digest of a record: of each field "-" if null, else its UTF-8 byte count, ":" and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the number of a row in its group by ``order`` (from 0), and ``total``, the rows of the group.

    Rows are sorted in range partitions, so that a group of any size is spread over many tasks. Only one row for each group and
    partition takes part in the prefix sums.
    """
    keys = [group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    spans = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_part", group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    found = stored(placed.join(spans, ["_part", group]).withColumn("pos", F.expr("_at - _first + _before")).drop("_part", "_at", "_first", "_before"), "numbered")
    dropped(placed)
    return found


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (grp, pos, total, hash): for each a table (grp, up, total, preimage), and (grp, hash) of each group's top.

    A row holds the digests of up to FANOUT neighbouring nodes; its own digest is node ``up`` of the next level. ``total`` counts the nodes below.
    """
    found, tops = [], nodes.where("total = 1").select("grp", "hash")
    nodes = nodes.where("total > 1").select("grp", "pos", "total", "hash")
    while not nodes.isEmpty():
        runs = nodes.groupBy("grp", F.expr(f"pos div {FANOUT}").alias("up")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("run"))
        level = stored(runs.select("grp", "up", "total", F.array_join(F.col("run.hash"), "").alias("preimage")), "level")
        found.append(level)
        above = level.select("grp", F.col("up").alias("pos"), F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total"), digest(F.col("preimage")).alias("hash"))
        tops = tops.unionByName(above.where("total = 1").select("grp", "hash"))
        nodes = above.where("total > 1")
    return found, tops


def with_paths(nodes: DataFrame, tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with what ``tops`` (grp, path, ...) gives their group and ``path``: (preimage, slot) of every ancestor, from the nearest to the root.

    Paths are joined from the top down, level to level, so that each join has a sixteenth of the rows of the next one. Only a group's
    topmost node joins ``tops``; all others join the one parent they share with up to 15 more, so no key is hot.
    """
    carried = [c for c in tops.columns if c not in ("grp", "path")]

    def joined(rows: DataFrame, at: str, parents: DataFrame | None) -> DataFrame:
        top = rows.where("total = 1").join(tops, "grp")
        if parents is None:
            return top
        slot = F.expr(f"int(_pos % {FANOUT})")
        up = parents.select("grp", F.col("up").alias("_up"), "preimage", F.col("path").alias("_path"), *carried)
        low = rows.where("total > 1").withColumn("_pos", F.col(at)).withColumn("_up", F.expr(f"_pos div {FANOUT}")).join(up, ["grp", "_up"])
        low = low.withColumn("path", F.concat(F.array(F.struct("preimage", slot.alias("slot"))).cast(_PATH), "_path"))
        return top.unionByName(low.select(*top.columns))

    parents = None
    for level in reversed(tree):
        # of a level's rows: as nodes of the level above there are a sixteenth of ``total``
        as_nodes = level.select("grp", "up", F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total"), F.col("preimage").alias("own"))
        parents = joined(as_nodes, "up", parents).withColumnRenamed("own", "preimage")
    return joined(nodes, "pos", parents)


def _around(x: Column) -> tuple[Column, Column]:
    """What stands before and after a node's own digest in its parent's preimage."""
    at = x["slot"] * DIGITS
    return F.substring(x["preimage"], F.lit(1), at), F.substring(x["preimage"], at + DIGITS + 1, F.length(x["preimage"]))


def siblings(path: Column) -> Column:
    """The digests of all siblings along a path, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda x: F.concat(*_around(x))), "")


def folded(path: Column, own: Column) -> Column:
    """The root that follows from a leaf's digest and its path: it takes its slot in each preimage in turn."""

    def step(below: Column, x: Column) -> Column:
        before, after = _around(x)
        return digest(F.concat(before, below, after))

    return F.aggregate(path, own, step)


def manifest(docs: DataFrame, other: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, other_leaf, subroot, root, path) of each row of docs (doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id; runs of FANOUT become their parent until one node is left, the subroot. Subroots ascend by source, null
    first, and become the root likewise. ``other_leaf`` is the leaf that the row has with the columns given in ``other`` in place of its own.

    Nulls in any column are a field of their own ("-"); a null doc_id comes first, a null source is a source. Empty and very long texts are fields like any other:
    a text is read once, and only its digest travels. Rows that repeat a doc_id stay rows and ascend by their digest; equal rows have equal leaves and follow
    each other. An empty table has no rows and no root. Columns beyond those named are left out, whatever their names.
    """
    own = [F.col(f) for f in FIELDS]
    changed = [(other or {}).get(f, F.col(f)) for f in FIELDS]
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    leaves = stored(docs.select("doc_id", group.alias("grp"), leaf_digest(*own).alias("hash"), leaf_digest(*changed).alias("other_leaf")), "leaves")
    nodes = numbered(leaves, "grp", ["doc_id", "hash"])
    tree, tops = levels(nodes)
    sources = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "hash"), "grp", ["source"])
    upper, root = levels(sources)
    roots = root.select("grp", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    subroots = stored(with_paths(sources, upper, roots).select(F.col("source").alias("grp"), F.col("hash").alias("subroot"), "root", "path"), "subroots")
    paths = with_paths(nodes, tree, subroots)
    return paths.select("doc_id", F.col("hash").alias("leaf"), "other_leaf", "subroot", "root", "path")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, every leaf's proof, and whether the texts verify once those of some documents are lower-cased."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, {"text": F.when(tampered, lower).otherwise(F.col("text"))})
    rows = rows.withColumn("proof_sha256", digest(siblings(F.col("path")))).withColumn("folded_root", folded(F.col("path"), F.col("other_leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total,
           row_number() OVER () AS row_no
    FROM (
        SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
               CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0
                    THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS other_leaf
        FROM documents)
), trees AS (
    SELECT source, 0 AS level, pos, total, leaf AS hash FROM leaves
    UNION ALL
    SELECT source, level + 1, pos // 16, (total + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM trees WHERE total > 1 GROUP BY source, level, pos // 16, total
), subroots AS (
    SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM trees WHERE total = 1
), top AS (
    SELECT 0 AS level, pos, total, subroot AS hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (total + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE total > 1 GROUP BY level, pos // 16, total
), root AS (
    SELECT hash AS root FROM top WHERE total = 1
), lower_siblings AS (
    SELECT l.row_no, t.level, string_agg(t.hash, '' ORDER BY t.pos) AS hashes
    FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source AND t.total > 1 AND t.pos // 16 = l.pos // (16 ** (t.level + 1))::BIGINT
    WHERE t.pos <> l.pos // (16 ** t.level)::BIGINT GROUP BY ALL
), upper_siblings AS (
    SELECT s.source, t.level, string_agg(t.hash, '' ORDER BY t.pos) AS hashes
    FROM subroots s JOIN top t ON t.total > 1 AND t.pos // 16 = s.pos // (16 ** (t.level + 1))::BIGINT
    WHERE t.pos <> s.pos // (16 ** t.level)::BIGINT GROUP BY ALL
), lower_proof AS (
    SELECT row_no, string_agg(hashes, '' ORDER BY level) AS hashes FROM lower_siblings GROUP BY row_no
), upper_proof AS (
    SELECT source, string_agg(hashes, '' ORDER BY level) AS hashes FROM upper_siblings GROUP BY source
), folds AS (
    SELECT row_no, source, 0 AS level, pos, total, other_leaf AS hash FROM leaves
    UNION ALL
    SELECT f.row_no, f.source, f.level + 1, f.pos // 16, (f.total + 15) // 16, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.hash ELSE t.hash END, '' ORDER BY t.pos))
    FROM folds f JOIN trees t ON f.source IS NOT DISTINCT FROM t.source AND f.level = t.level AND f.pos // 16 = t.pos // 16
    WHERE f.total > 1 GROUP BY f.row_no, f.source, f.level, f.pos, f.total
), upper_folds AS (
    SELECT f.row_no, 0 AS level, s.pos, s.total, f.hash FROM folds f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.total = 1
    UNION ALL
    SELECT f.row_no, f.level + 1, f.pos // 16, (f.total + 15) // 16, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.hash ELSE t.hash END, '' ORDER BY t.pos))
    FROM upper_folds f JOIN top t ON f.level = t.level AND f.pos // 16 = t.pos // 16
    WHERE f.total > 1 GROUP BY f.row_no, f.level, f.pos, f.total
)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.hashes, '') || coalesce(u.hashes, '')) AS proof_sha256, f.hash AS folded_root, f.hash = r.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN root r
LEFT JOIN lower_proof p ON l.row_no = p.row_no LEFT JOIN upper_proof u ON l.source IS NOT DISTINCT FROM u.source
JOIN upper_folds f ON l.row_no = f.row_no AND f.total = 1
"""
