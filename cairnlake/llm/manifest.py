"""Merkle manifest of a dataset, with a witness for every document, by incremental witnesses.

A leaf is the hash of a document's fields, each as byte count, colon and value. Per key the leaves ascend by id; while
several nodes are left, each two consecutive ones become the hash of their digests as hex text, a last one alone the hash
of its own. The roots of the keys, in key order and null first, make the root likewise.

1. Digests are computed beside the texts; from then on only (id, key, digest) rows move. A rank by range partitions
   gives each leaf its place; no key, however large, is one task.
2. Leaves are dealt in aligned blocks of 2 ** `HEIGHT`. A task appends a block's leaves one after the other: a new leaf is an
   open subtree, two neighbours of one height close into one, and this moment extends the witness of every leaf below the left one
   by the right digest and the other way round. So a leaf's witness is partial until its siblings have come.
3. What a block ends in is its root. Block roots are the leaves of further appends, block by block again, until a key has one
   node; then the keys' roots are appended in the same way. A leaf's witness is its own, its block's, that block's block's, and so on.
4. Folding a digest with a witness needs the leaf's place and the number of leaves only: they say which sibling is left
   and where a node was alone.

Defined cases: an empty table gives no rows; null fields hash as `-`, a null key is a key of its own, null ids come first and are
never tampered with; rows that share an id stand in the order of their digests; whole texts of any length are hashed in the
scan; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_rank
from .common import materialise

#: Leaves of a block: 2 ** HEIGHT.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_ONE_IN = 7


def node(*digests: bytes) -> bytes:
    """The hash of some digests as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(*values: Column) -> Column:
    """A document's digest: per value its UTF-8 byte count, a colon and itself, or a dash for null."""
    text = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


class Append:
    """The open subtrees of one block and the witnesses of its leaves so far."""

    def __init__(self):
        self.open: list[tuple[int, int, bytes]] = []  # height, first leaf, digest; heights fall
        self.witness: list[bytearray] = []

    def add(self, digest: bytes) -> None:
        self.open.append((0, len(self.witness), digest))
        self.witness.append(bytearray())
        self._close()

    def _close(self) -> None:
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            height, middle, right = self.open.pop()
            _, first, left = self.open.pop()
            for k in range(first, middle):
                self.witness[k] += right
            for k in range(middle, len(self.witness)):
                self.witness[k] += left
            self.open.append((height + 1, first, node(left, right)))

    def end(self, height: int | None) -> bytes:
        """The block's root: the last open subtree is alone until its neighbour's height, and until `height` if that is given."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            at, first, digest = self.open.pop()
            self.open.append((at + 1, first, node(digest)))
            self._close()
        return self.open[0][2]


def fold(digest: bytes, witness: bytes, at: int, count: int) -> tuple[bytes, bytes]:
    """The root over `digest`, leaf `at` of `count`, and what of the witness is left."""
    used = 0
    while count > 1:
        if at ^ 1 < count:
            other = witness[used : used + 32]
            used += 32
            digest = node(other, digest) if at & 1 else node(digest, other)
        else:
            digest = node(digest)
        at, count = at >> 1, (count + 1) >> 1
    return digest, witness[used:]


_NODE = [T.StructField("g", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]


def _grown(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes (g, at, n, digest and others) with their witness within the block and, on a block's first row, its root."""
    others = [f for f in nodes.schema.fields if f.name not in {x.name for x in _NODE}]
    schema = T.StructType([*_NODE, *others, T.StructField("witness", T.BinaryType()), T.StructField("top", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, work, held = None, None, []

        def finished() -> pa.RecordBatch:
            root = work.end(height if held[0][2] > 1 << height else None)
            columns = [*zip(*held, strict=True), [bytes(w) for w in work.witness], [root] + [None] * (len(held) - 1)]
            from pyspark.sql.pandas.types import to_arrow_type

            arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != (row[0], row[1] >> height):
                    if held:
                        yield finished()
                    block, work, held = (row[0], row[1] >> height), Append(), []
                work.add(row[3])
                held.append(row)
        if held:
            yield finished()

    dealt = nodes.repartition("g", F.shiftright("at", height)).sortWithinPartitions("g", "at")
    return dealt.select(*[f.name for f in _NODE], *[f.name for f in others]).mapInArrow(run, schema)


def tree(nodes: DataFrame, most: int, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, at, n, digest, others), at most `most` a g: themselves with their whole witness, and (g, root) rows."""
    grown, block = materialise(_grown(nodes, height), "manifest-nodes"), 1 << height
    heads = grown.filter("top IS NOT NULL")
    if most <= block:
        return grown.drop("top"), heads.select("g", F.col("top").alias("root"))
    blocks = heads.select("g", F.shiftright("at", height).alias("at"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.col("top").alias("digest"))
    above, roots = tree(blocks, -(-most // block), height)
    more = above.select("g", F.col("at").alias("block"), F.col("witness").alias("more"))
    whole = grown.withColumn("block", F.shiftright("at", height)).join(more, ["g", "block"])
    return whole.withColumn("witness", F.concat("witness", "more")).drop("block", "more", "top"), roots


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame | None:
    """Leaves (key, id, digest and others) with g (the key's rank from 0), at, n, groups, witness, subroot and root; None if there are none."""
    ranked = global_rank(leaves, F.asc_nulls_first("key"), F.asc_nulls_first("id"), "digest", name="rank")
    keys = ranked.groupBy("key").agg((F.min("rank") - 1).alias("first"), F.count("*").alias("n"))
    keys = materialise(global_rank(keys, F.asc_nulls_first("key"), name="g").withColumn("g", F.col("g") - 1), "manifest-keys")
    groups, most = keys.agg(F.count("*"), F.max("n")).first()
    if not groups:
        return None
    own = keys.withColumnRenamed("key", "own")
    nodes = ranked.join(own, F.col("key").eqNullSafe(F.col("own"))).withColumn("at", F.col("rank") - 1 - F.col("first"))
    below, subroots = tree(nodes.drop("rank", "first", "key", "own"), most, height)
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.lit(groups).cast("long").alias("n"), F.col("root").alias("digest"))
    above, root = tree(tops, groups, height)
    above = above.select(F.col("at").alias("g"), F.col("digest").alias("subroot"), F.col("witness").alias("more"), F.lit(groups).cast("long").alias("groups"))
    whole = below.join(above, "g").withColumn("witness", F.concat("witness", "more")).drop("more")
    return whole.withColumn("root", F.lit(bytes(root.first()["root"])))


RESULT = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(leaves: DataFrame, forged: str) -> DataFrame:
    """Rows of `manifest`: id, leaf, subroot, root, proof_sha256, and the root folded from `forged` (or the leaf where null) with whether it is the root."""
    schema = T.StructType([T.StructField("id", leaves.schema["id"].dataType)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, forged_, witness, at, n, g, groups, subroot, root = [c.to_pylist() for c in batch.columns[1:]]
            proof = [sha256(w.hex().encode()).hexdigest() for w in witness]
            folded = []
            for k in range(batch.num_rows):
                under, rest = fold(forged_[k] or digest[k], witness[k], at[k], n[k])
                folded.append(fold(under, rest, g[k], groups[k])[0].hex())
            columns = [[d.hex() for d in digest], [s.hex() for s in subroot], [r.hex() for r in root], proof, folded]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=schema.names)

    needed = leaves.select("id", "digest", F.col(forged).alias("forged"), "witness", "at", "n", "g", "groups", "subroot", "root")
    return needed.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """The manifest of a table of documents by lang, checked against the same documents with n_chars tampered with."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    touched = F.pmod(F.crc32(fields["doc_id"].cast("string").cast("binary")), F.lit(TAMPERED_ONE_IN)) == 0
    forged = leaf(*[v + 1 if c == "n_chars" else v for c, v in fields.items()])
    leaves = docs.select(
        fields["lang"].cast("string").alias("key"), fields["doc_id"].alias("id"), leaf(*fields.values()).alias("digest"),
        F.when(touched & fields["n_chars"].isNotNull(), forged).alias("forged"),
    )
    made = manifest(materialise(leaves, "manifest-leaves"), height)
    if made is None:
        return docs.sparkSession.createDataFrame([], RESULT.format(docs.schema["doc_id"].dataType.simpleString()))
    return verify(made, "forged").withColumnRenamed("id", "doc_id")


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    return documents_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


#: Levels as lists, one row a level and group; CRC-32 bit by bit over the digits of an id.
OP11_SQL = """
WITH RECURSIVE tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
),
d AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS touched
  FROM documents, tbl
),
leaves AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN touched AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS forged
  FROM d
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS h FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM levels WHERE len(h) > 1
),
subroots AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM levels WHERE len(h) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY g) AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM tops WHERE len(h) > 1
),
steps AS (
  SELECT p.doc_id, p.leaf, p.lang, l.lvl, (p.pos >> l.lvl) & 1 AS side, h[xor(p.pos >> l.lvl, 1) + 1] AS other
  FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(h) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, 1000 + t.lvl, (s.g >> t.lvl) & 1, h[xor(s.g >> t.lvl, 1) + 1]
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, tops t WHERE len(h) > 1
),
paths AS (
  SELECT doc_id, leaf, lang, list({'side': side, 'other': other} ORDER BY lvl) AS path, coalesce(string_agg(other, '' ORDER BY lvl), '') AS proof FROM steps GROUP BY doc_id, leaf, lang
),
folds AS (
  SELECT p.doc_id, p.leaf, p.lang, 1 AS k, path, coalesce(p.forged, p.leaf) AS h FROM placed p JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf AND q.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT doc_id, leaf, lang, k + 1, path, CASE WHEN path[k].other IS NULL THEN sha256(h) WHEN path[k].side = 1 THEN sha256(path[k].other || h) ELSE sha256(h || path[k].other) END
  FROM folds WHERE k <= len(path)
)
SELECT f.doc_id, f.leaf, s.subroot, t.h[1] AS root, sha256(q.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h[1] AS verified
FROM folds f JOIN paths q ON q.doc_id IS NOT DISTINCT FROM f.doc_id AND q.leaf = f.leaf AND q.lang IS NOT DISTINCT FROM f.lang
JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang, tops t
WHERE len(t.h) = 1 AND f.k = len(f.path) + 1
"""
