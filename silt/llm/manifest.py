"""A Merkle manifest of a dataset as a persistent tree: a change copies a path and shares all other nodes.

Each row is a leaf.  Per group (a source) leaves ascend by key; 16 nodes in a row become one, level by level, until one is left, the group's subroot; subroots in the
order of their groups become the root alike.  Positions come from ranges of keys and sums (``ranks``), so a group may hold any share of the rows.  The tree is cut into aligned blocks of
256 nodes, two levels each: a task builds a block's tree from its digests, and blocks' roots are the nodes of the next step up, a table of a 256th of the rows.
Then paths go down: each node gets the siblings of all its ancestors, as one row for each block.

Every leaf makes a version, a tampered one with its other digest and any other with its own: its ancestors inside the block are copied, with one child replaced, and every other node is
shared with the untampered tree.  The version goes on in the same task through the siblings that came down, so no upper block ever meets the versions of all leaves under it.

Defined cases: null fields count as ``-``, so null keys and texts have leaves; null keys come first, a null group is a group, the first one; rows of equal keys are in the order of their leaves, and repeated
rows are a leaf each; an empty table gives an empty result; columns other than the fields don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import CRC_SQL, crc32_sql, saved
from silt.llm.ranks import ranked

ARITY, DEPTH = 16, 2
BLOCK_BITS = 8  # ARITY ** DEPTH nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "g string, pos long, digest string, n long"
PATHS = "g string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Node:
    """A node of a persistent tree; nodes never change."""

    __slots__ = ("digest", "children")

    def __init__(self, digest: str, children: tuple[Node, ...] = ()):
        self.digest, self.children = digest, children

    @classmethod
    def over(cls, children: Sequence[Node]) -> Node:
        return cls(joined([c.digest for c in children]), tuple(children))

    def version(self, way: Sequence[int], digest: str) -> Node:
        """The tree with another leaf at the end of ``way``: copies of the nodes on it, whose other children are shared."""
        if not way:
            return Node(digest)
        i = way[0]
        return Node.over([*self.children[:i], self.children[i].version(way[1:], digest), *self.children[i + 1 :]])

    def siblings(self, way: Sequence[int]) -> Iterator[tuple[str, str]]:
        """The digests left and right of ``way``, level by level from the leaf up."""
        if way:
            i = way[0]
            yield from self.children[i].siblings(way[1:])
            yield "".join(c.digest for c in self.children[:i]), "".join(c.digest for c in self.children[i + 1 :])


def depth(n: int) -> int:
    """Levels of a block in a group of ``n`` nodes: none where one is left."""
    return 0 if n == 1 else 1 if n <= ARITY else DEPTH


def built(digests: Sequence[str], levels: int) -> Node:
    nodes = [Node(d) for d in digests]
    for _ in range(levels):
        nodes = [Node.over(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
    (root,) = nodes
    return root


def way_to(pos: int, levels: int) -> list[int]:
    """Child numbers from the block's root down to its node ``pos``."""
    return [pos >> 4 * k & ARITY - 1 for k in reversed(range(levels))]


def folded(digest: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    for a, b in zip(lefts, rights):
        digest = joined((a, digest, b))
    return digest


def _block(nodes: pa.Table) -> tuple[Node, int, list[int], list[str]]:
    nodes = nodes.sort_by("pos")
    digests, levels = nodes["digest"].to_pylist(), depth(nodes["n"][0].as_py())
    return built(digests, levels), levels, nodes["pos"].to_pylist(), digests


def _blocks(df: DataFrame):
    return df.withColumn("block", F.shiftright("pos", BLOCK_BITS)).groupBy("g", "block")


def step_up(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks, as nodes (g, pos, digest, n)."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        root, levels, *_ = _block(t)
        n = t["n"][0].as_py()
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [root.digest], "n": pa.array([n if not levels else -(-n >> BLOCK_BITS) if levels == DEPTH else 1], pa.int64())})

    return _blocks(nodes.select("g", "pos", "digest", "n")).applyInArrow(run, NODES)


def climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """``nodes`` and all steps above them; the last has one node a group."""
    steps = [nodes]
    while (steps[-1].agg(F.max("n")).first()[0] or 1) > 1:
        steps.append(saved(step_up(steps[-1]), label))
    return steps


def _met(nodes: DataFrame, above: DataFrame, fn, schema: str) -> DataFrame:
    return _blocks(nodes).cogroup(above.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(fn, schema)


def _paths(t: pa.Table, above: pa.Table) -> Iterator[tuple[Node, list[int], int, str, list[str], list[str]]]:
    root, levels, places, digests = _block(t)
    lefts, rights = above["lefts"][0].as_py(), above["rights"][0].as_py()
    for pos, digest in zip(places, digests):
        way = way_to(pos, levels)
        own = list(root.siblings(way))
        yield root, way, pos, digest, [a for a, _ in own] + lefts, [b for _, b in own] + rights


def step_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of ``nodes`` from the paths of their blocks."""
    names = [c.split()[0] for c in PATHS.split(", ")]

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        rows = [(up["g"][0].as_py(), pos, lefts, rights, up["subroot"][0].as_py(), up["root"][0].as_py()) for _, _, pos, _, lefts, rights in _paths(t, up)]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})

    return _met(nodes, above, run, PATHS)


def descend(steps: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """Paths of the nodes of ``steps[0]``, from those of the nodes above the last step."""
    for nodes in reversed(steps):
        above = saved(step_down(nodes, above), label)
    return above


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def versions(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, tampered: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, lefts, rights, version_root): each row's leaf, what stands left and right of its ancestors from the leaf up, and the root of
    the version in which the row has ``changes`` (field: new value), where ``tampered`` holds; elsewhere that of the version with the row's own leaf put in again, by
    the same hashes: equal to the root only if nothing on the way is damaged.
    """
    leaf = leaf_of([F.col(f) for f in fields])
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_of([(changes or {}).get(f, F.col(f)) for f in fields])) if tampered is not None else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before ":", so the null group is the first
    made = saved(docs.select(g.alias("g"), F.col(key).alias("key"), leaf.alias("digest"), other.alias("other"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "manifest-leaves")
    leaves = ranked(made, "g", ["key", "digest", "salt"], "manifest-ranked")  # the salt spreads repeated rows over ranges; which of them comes first makes no difference
    steps = climb(leaves, "manifest-nodes")
    tops = steps[-1].select(F.lit("").alias("top"), "g", "digest")
    tops = saved(ranked(tops, "top", ["g"], "manifest-tops").select(F.col("top").alias("g"), F.col("g").alias("own"), "digest", "pos", "n"), "manifest-tops")
    upper = climb(tops.select("g", "pos", "digest", "n"), "manifest-nodes")
    none = F.array().cast("array<string>")
    crown = upper[-1].select("g", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    crown = descend(upper[:-1], crown, "manifest-paths")
    found = crown.join(tops.select("pos", "own", "digest"), "pos").select(F.col("own").alias("g"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    above = descend(steps[1:-1], saved(found, "manifest-paths"), "manifest-paths")

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        subroot, root, rows = up["subroot"][0].as_py(), up["root"][0].as_py(), []
        upper_l, upper_r = up["lefts"][0].as_py(), up["rights"][0].as_py()
        for (tree, way, _, leaf, lefts, rights), other in zip(_paths(t, up), t["other"].to_pylist()):
            new = folded(tree.version(way, leaf if other is None else other).digest, upper_l, upper_r)
            rows.append((leaf, subroot, root, lefts, rights, new))
        kinds = [pa.string()] * 3 + [pa.list_(pa.string())] * 2 + [pa.string()]
        return pa.table({key: t["key"], **{n: pa.array(c, k) for n, c, k in zip(["leaf", "subroot", "root", "lefts", "rights", "version_root"], zip(*rows), kinds)}})

    kind = docs.schema[key].dataType.simpleString()
    return _met(leaves, above, run, f"`{key}` {kind}, leaf string, subroot string, root string, lefts array<string>, rights array<string>, version_root string")


def report(docs: DataFrame) -> DataFrame:
    """Leaves, subroots, the root and digests of the proofs of all documents; a fifth of them, by key, are tampered with by lower-casing their texts."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    v = versions(docs, tampered=tampered, changes={"text": lowered(F.col("text"))})
    proof = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return v.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), F.col("version_root").alias("folded_root"), (F.col("version_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _sql_nodes(name: str, base: str) -> str:
    """A table of all nodes (lvl, g, pos, digest, n) over those of ``base``."""
    return f"""{name} AS (
  SELECT 0 AS lvl, g, pos, digest, n FROM {base}
  UNION ALL
  SELECT lvl + 1, g, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY lvl, g, pos // 16, n)"""


def _sql_folds(name: str, base: str, nodes: str) -> str:
    """The digests on the way up (r, lvl, g, pos, n, digest) with the siblings met, from rows (r, g, pos, n, digest, proof) of ``base``."""
    return f"""{name} AS (
  SELECT r, 0 AS lvl, g, pos, n, digest, proof FROM {base}
  UNION ALL
  SELECT f.r, f.lvl + 1, f.g, f.pos // 16, (f.n + 15) // 16, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.digest ELSE s.digest END, '' ORDER BY s.pos)),
    f.proof || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
  FROM {name} f JOIN {nodes} s ON s.lvl = f.lvl AND s.g = f.g AND s.pos // 16 = f.pos // 16 WHERE f.n > 1 GROUP BY f.r, f.lvl, f.g, f.pos, f.n, f.proof)"""


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(':' || source, '-') AS g, {_sql_leaf("text")} AS digest,
    CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_sql_nodes("nodes", "leaves")},
subroots AS (SELECT '' AS g, g AS own, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_sql_nodes("tops", "subroots")},
starts AS (SELECT r, g, pos, n, coalesce(other, digest) AS digest, '' AS proof FROM leaves),
{_sql_folds("folds", "starts", "nodes")},
middles AS (SELECT f.r, s.g, s.pos, s.n, f.digest, f.proof FROM folds f JOIN subroots s ON s.own = f.g WHERE f.n = 1),
{_sql_folds("ends", "middles", "tops")}
SELECT doc_id, leaves.digest AS leaf, subroots.digest AS subroot, tops.digest AS root, sha256(ends.proof) AS proof_sha256, ends.digest AS folded_root, ends.digest = tops.digest AS verified
FROM leaves JOIN subroots ON subroots.own = leaves.g JOIN tops ON tops.n = 1 JOIN ends ON ends.r = leaves.r AND ends.n = 1
"""
