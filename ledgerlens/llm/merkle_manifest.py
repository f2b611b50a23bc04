"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf.  Leaves are numbered in order inside their group; of each
run of ``FANOUT`` consecutive nodes the row at slot 0 hashes the run, which is
the parent, until one node remains per group (its subroot).  The subroots form
a tree of their own whose top is the root.

A level is one window pass: ``FANOUT - 1`` lag and lead columns at fixed
offsets, masked by the row's slot and the length of its run, are its siblings,
and the slot-0 row concatenates itself and its leads into the parent.  Windows
run over aligned stretches of ``STRETCH`` nodes, so a group of any size is
spread over many tasks.  Proofs are put together from the top down: a node's
path is its own siblings followed by the path of its parent, which is joined on
a table an eighth as large; leaves get theirs in the last join only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._util import stored
from ledgerlens.operators.ordinals import with_ordinal

FANOUT = 8
#: Nodes that one window covers; a multiple of the fan-out, so no run is cut.
STRETCH = FANOUT ** 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


# --- leaves -----------------------------------------------------------------

def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the checksum of the decimal id (null ids: as it is)."""
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


# --- one tree per group -----------------------------------------------------

def _sizes(size: Column, level: int) -> Column:
    """Nodes of a group on a level: its leaves divided by the fan-out, rounded up, once per level."""
    for _ in range(level):
        size = F.ceil(size / F.lit(FANOUT))
    return size.cast("long")


def with_siblings(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes(g, size, i, h)`` of one level with ``left``, ``right`` and, at slot 0, ``parent``.

    ``left`` and ``right`` are the hex digests of the run's nodes before and
    after the row.
    """
    along = Window.partitionBy("g", "stretch").orderBy("i")
    slot = F.pmod(F.col("i"), F.lit(FANOUT))
    length = F.least(F.lit(FANOUT).cast("long"), F.col("n") - (F.col("i") - slot))
    before = [F.when(slot >= k, F.lag("h", k).over(along)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("h", k).over(along)) for k in range(1, FANOUT)]
    placed = nodes.withColumns({"n": _sizes(F.col("size"), level), "stretch": F.floor(F.col("i") / F.lit(STRETCH))})
    joined = placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after), "slot": slot})
    return joined.withColumn("parent", F.when(F.col("slot") == 0, digest(F.col("h"), F.col("right"))))


@dataclass(frozen=True)
class Trees:
    """Levels ``(g, size, i, h)`` from the leaves up; a group ends at the level where it has one node."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``g, top``: the one node that remains of each group."""
        found = [level.where(_sizes(F.col("size"), k) == 1).select("g", F.col("h").alias("top"))
                 for k, level in enumerate(self.levels)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def build_trees(leaves: DataFrame, name: str) -> Trees:
    """All levels above the stored ``leaves(g, size, i, h)``; each is written once, an eighth of the one below."""
    levels = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        level = len(levels) - 1
        grown = with_siblings(levels[-1].where(_sizes(F.col("size"), level) > 1), level).where("slot = 0")
        levels.append(stored(grown.select(
            "g", "size", F.floor(F.col("i") / F.lit(FANOUT)).alias("i"), F.col("parent").alias("h")), name))
        largest = -(-largest // FANOUT)
    return Trees(levels)


def paths_above_leaves(trees: Trees, above: DataFrame, name: str) -> DataFrame:
    """``g, i, path`` of the nodes one level above the leaves, built from the top down.

    ``above(g, path)`` continues each group's path beyond its top.
    """
    own: DataFrame | None = None
    for level in range(len(trees.levels) - 1, 0, -1):
        nodes = trees.levels[level]
        single = _sizes(F.col("size"), level) == 1
        tops = nodes.where(single).select("g", "i").join(above, "g").select("g", "i", "path")
        if own is None:
            own = stored(tops, name)
            continue
        inner = with_siblings(nodes.where(~single), level).select(
            "g", "i", F.floor(F.col("i") / F.lit(FANOUT)).alias("up"), F.struct("left", "right").alias("own"))
        parents = own.select(F.col("g").alias("pg"), F.col("i").alias("pi"), "path")
        met = inner.join(parents, (inner.g == parents.pg) & (inner.up == parents.pi)).select(
            "g", "i", F.concat(F.array("own"), "path").alias("path"))
        own = stored(met.unionByName(tops), name)
    if own is None:
        return above.select("g", F.lit(0).cast("long").alias("i"), "path").limit(0)
    return own


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


# --- the operator -----------------------------------------------------------

def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    Groups are the languages (null is a group of its own and the first), leaves
    ascend by ``doc_id`` (null first), leaves of one id by their digest; rows
    equal in both are interchangeable.  Null, empty and long values are leaves
    like any other.  A single leaf is its group's subroot, a single subroot the
    root; its proof is then the hash of nothing.  An empty table gives no rows;
    further columns are not read.
    """
    values = [encoded(F.col(c)) for c in LEAF_COLUMNS[:-1]]
    text = F.col("text")
    changed = digest(*values, encoded(tampered(F.col("doc_id"), text)))
    rows = stored(docs.select(
        "doc_id", "lang", digest(*values, encoded(text)).alias("leaf"), changed.alias("bent")), "merkle-leaves")

    # one global order by (lang, id, leaf); a language's first place turns it into places inside the language
    placed = with_ordinal(rows, ["lang", "doc_id", "leaf"], "at", nulls_first=True,
                          spread=[F.monotonically_increasing_id()])
    langs = stored(placed.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-langs")
    groups = stored(with_ordinal(langs, ["lang"], "g", nulls_first=True), "merkle-groups")
    leaves = stored(placed.join(groups.withColumnRenamed("lang", "of"), placed["lang"].eqNullSafe(F.col("of"))).select(
        "g", "size", (F.col("at") - F.col("first")).alias("i"), F.col("leaf").alias("h"), "doc_id", "bent"), "merkle-level")

    trees = build_trees(leaves.select("g", "size", "i", "h"), "merkle-level")
    tops = stored(trees.tops(), "merkle-subroots")
    subroots = stored(tops.select(
        F.lit(0).cast("long").alias("g"), F.lit(groups.count()).cast("long").alias("size"), F.col("g").alias("i"),
        F.col("top").alias("h")), "merkle-subroots")
    upper = build_trees(subroots, "merkle-upper")
    found = upper.tops().first()
    root = found["top"] if found else None
    zero = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.array().cast(_PATH).alias("path"))
    above = stored(_leaf_paths(upper, subroots, zero, "merkle-upper-paths").select(
        F.col("i").alias("g"), "path"), "merkle-above")

    proven = _leaf_paths(trees, leaves, above, "merkle-paths")
    subroot = tops.select(F.col("g").alias("tg"), "top")
    found = proven.join(subroot, proven.g == subroot.tg)
    end = folded(F.col("bent"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return found.select("doc_id", F.col("h").alias("leaf"), F.col("top").alias("subroot"),
                        F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), end.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _leaf_paths(trees: Trees, leaves: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """``leaves`` (any further columns kept) with their ``path`` up to the top and beyond by ``above``."""
    alone = leaves.where("size = 1").join(above, "g")
    parents = paths_above_leaves(trees, above, name).select(
        F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("path").alias("rest"))
    many = with_siblings(leaves.where("size > 1"), 0)
    met = many.join(parents, (many.g == parents.pg) & (F.floor(many.i / F.lit(FANOUT)) == parents.pi))
    full = met.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest"))
    return full.select(*leaves.columns, "path").unionByName(alone.select(*leaves.columns, "path"))


# --- DuckDB twin ------------------------------------------------------------

def _sql_enc(column: str, expression: str | None = None) -> str:
    text = f"({expression or column})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """Levels ``name0, name1, ..`` (g, i, h, n) above ``leaves(g, i, h)`` and their runs ``namer0, ..`` (g, i2, hs, n)."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT g, i // {FANOUT} AS i2, list(h ORDER BY i) AS hs, any_value(n) AS n "
                   f"FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT g, i2 AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, "
                   f"count(*) OVER (PARTITION BY g) AS n FROM {name}r{k})")
    return ",\n".join(out)


def _sql(levels: int = 7, upper: int = 3) -> str:
    """Twin of ``manifest`` for up to 8**levels documents of a language and 8**upper languages."""
    steps = [("t", k, "i", "g") for k in range(levels)] + [("u", k, "g", "0") for k in range(upper)]
    joins, lefts, rights, alone = [], [], [], []
    for name, k, place, group in steps:
        alias = f"{name}r{k}"
        joins.append(f"JOIN {alias} ON {alias}.g = d.{group} AND {alias}.i2 = d.{place} // {FANOUT ** (k + 1)}"
                     if group != "0" else f"JOIN {alias} ON {alias}.i2 = d.{place} // {FANOUT ** (k + 1)}")
        slot = f"((d.{place} // {FANOUT ** k}) % {FANOUT})"
        lefts.append(f"CASE WHEN {alias}.n > 1 THEN array_to_string({alias}.hs[1:{slot}], '') ELSE '' END")
        rights.append(f"CASE WHEN {alias}.n > 1 THEN array_to_string({alias}.hs[{slot} + 2:], '') ELSE '' END")
        alone.append(f"{alias}.n = 1")
    columns = ", ".join(f"{x} AS l{j}, {y} AS r{j}, {z} AS o{j}" for j, (x, y, z) in enumerate(zip(lefts, rights, alone)))
    fold, ctes = "bent", []
    for j in range(len(steps)):
        ctes.append(f"f{j} AS (SELECT *, CASE WHEN o{j} THEN {fold} ELSE sha256(l{j} || {fold} || r{j}) END AS x{j} "
                    f"FROM {'paths' if j == 0 else f'f{j - 1}'})")
        fold = f"x{j}"
    proof = " || ".join(f"l{j} || r{j}" for j in range(len(steps)))
    values = " || ".join(_sql_enc(c) for c in LEAF_COLUMNS[:-1])
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH {{crc}}
hashed AS (SELECT doc_id, lang, sha256({values} || {_sql_enc('text')}) AS leaf,
  sha256({values} || {_sql_enc('text', f"CASE WHEN crc % 3 = 0 THEN {lowered} ELSE text END")}) AS bent FROM summed),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, bent) - 1 AS i FROM hashed),
leaves AS (SELECT g, i, leaf AS h FROM numbered),
{_sql_tree('t', 'leaves', levels)},
subroots AS (SELECT 0 AS g, g AS i, h FROM t{levels}),
{_sql_tree('u', 'subroots', upper)},
paths AS (SELECT d.doc_id, d.leaf, d.bent, t{levels}.h AS subroot, u{upper}.h AS root, {columns} FROM numbered d
  JOIN t{levels} ON t{levels}.g = d.g CROSS JOIN u{upper} {' '.join(joins)}),
{', '.join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified
FROM f{len(steps) - 1}
"""


#: CRC-32 of the decimal id, bit by bit over its bytes.
_CRC = """
bytes AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) AS crc FROM bytes),
summed AS (SELECT d.*, crcs.crc FROM documents d LEFT JOIN crcs USING (doc_id)),"""

#: DuckDB twin of ``manifest``.
SQL = _sql().replace("{crc}", _CRC)
