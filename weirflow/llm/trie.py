"""A prefix trie of conversations, without walking it.

Each conversation's turns are hashed and scanned into polynomial prefix fingerprints, one per depth. Rows that share depth and
fingerprint are a candidate node; each row is held against the group's representative: the same last turn (SHA-256 of role and
text) and the same parent. As that holds at every depth, equal prefixes are equal turn by turn. Groups where it fails are split
by scanning the rows once more, with terms of other bits of the digests from the failed groups on, until none fails.

Sums over subtrees come without iterating over levels: a node counts with its smallest member c, which is a member of all its
ancestors, too. So a subtree holds, for every member c, the nodes that count with c: all of them, but for the top's own
conversation, of which only those from the top on. That is a sum per conversation, summed again over the members of each node,
and a running sum along one conversation.

No text is shuffled, and no key is bound to one task: turns are numbered and scanned by ranges (``scans``), groups are
aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import materialize, released
from weirflow.llm.mixing import word_count
from weirflow.llm.scans import scan

NODE = ["depth", "fp"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of (conv_id, turn, role, text): null role or text is empty, rows without a conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).alias("words"))


def rebuild(turns: DataFrame, begins: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, phase, turn, digest, words) and all conv_ids. Every conversation c begins with the first
    ``borrowed`` original turns of conversation ``begins`` (all if it has fewer, none if it isn't there), then has its own after
    its first ``borrowed``. Both are expressions of conv_id; ``borrowed`` is at most ``most``.

    Turns are in order of turn, null first, then of digest.
    """
    own = scan(turns, "conv_id", ["turn", "digest"])
    convs = materialize(own.where("at = 0").select("conv_id"), "convs")
    heads = own.where(F.col("at") < most).select(F.col("conv_id").alias("base"), F.col("at").alias("i"), "digest", "words")
    first = convs.withColumn("base", begins).join(heads, "base").where(F.col("i") < borrowed).select("conv_id", F.lit(0).alias("phase"), F.col("i").alias("turn"), "digest", "words")
    rest = own.where(F.col("at") >= borrowed).select("conv_id", F.lit(1).alias("phase"), F.col("at").alias("turn"), "digest", "words")
    return first.unionByName(rest), convs


def _fingerprints(turns: DataFrame, order: list[str], bits: int) -> DataFrame:
    """(conv_id, depth, fp, before, words) of every turn, verified: rows of equal (depth, fp) are equal up to there."""
    depth = (F.col("at") + 1).alias("depth")
    mask = lambda c: F.col(c) if bits == 64 else F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    found = scan(turns, "conv_id", order, poly="digest").select("conv_id", depth, mask("fp").alias("fp"), mask("before").alias("before"), "digest", "words")
    seed = 0
    while True:
        found = materialize(found, "fingerprints")
        differs = lambda c: F.min(c) != F.max(c)
        failed = materialize(found.groupBy(*NODE).agg((differs("digest") | differs("before")).alias("failed")).where("failed"), "failed")
        if failed.isEmpty():
            return found
        seed += 1
        marked = found.join(failed, NODE, "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        again = scan(marked.withColumnRenamed("fp", "fp_0").withColumnRenamed("before", "before_0"), "conv_id", ["depth"], poly="digest", seed=seed, salt="before_0", on="failed")
        told = lambda c: F.when(F.col(c) == 0, F.col(f"{c}_0")).otherwise(F.xxhash64(F.col(f"{c}_0"), c)).alias(c)
        found = again.select("conv_id", "depth", told("fp"), told("before"), "digest", "words")


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) from (depth, fp, conv_id): SHA-256 of the decimal conv_ids, ascending, joined by commas.

    Ids are joined where ranges of (node, conv_id) put them; only the joined pieces of a node meet in one task, in order, and
    run through the hash one by one.
    """
    ranged = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, fp, conv = (b.column(b.schema.names.index(c)).to_pylist() for c in [*NODE, "conv_id"])
            rows, at = [], 0
            for i in range(1, len(conv) + 1):
                if i == len(conv) or fp[i] != fp[at] or depth[i] != depth[at]:
                    rows.append((depth[at], fp[at], conv[at], ",".join(map(str, conv[at:i]))))
                    at = i
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "conv_id", "ids"])

    pieces = ranged.mapInArrow(released(join_up), "depth long, fp long, conv_id long, ids string").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")

    def hash_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        kind = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for d, f, ids in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if (d, f) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (d, f), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in done], schema=kind)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*node, sha.hexdigest()), strict=True))], schema=kind)

    return pieces.mapInArrow(released(hash_up), "depth long, fp long, ends_sha256 string")


def prefix_trie(turns: DataFrame, order: list[str], convs: DataFrame, bits: int = 64) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and fp, its fingerprint (with depth, the node's key).

    ``turns`` has conv_id, the columns of ``order``, digest and words; ``convs`` has every conv_id once, those without turns
    too: they are members of the root alone. No conversations, no nodes. ``bits`` narrows the fingerprints, for tests of what
    happens when they collide.
    """
    rows = _fingerprints(turns, order, bits)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("fp"))
    paths = rows.select("conv_id", "depth", "fp").unionByName(roots)
    grouped = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("before").alias("before"), F.first("words").alias("words"))
    root = roots.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).withColumns({"before": F.lit(None).cast("long"), "words": zero})
    nodes = materialize(grouped.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("conv_id").alias("parent_conv_id"))
    ends = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("last")).select("last.depth", "last.fp", "conv_id")
    known = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)).join(_ends_sha256(ends), NODE, "left").join(parents, ["depth", "before"], "left")
    known = known.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    # along each conversation from its deepest node: what lies below, then all of it
    below = materialize(scan(known, "conv_id", [F.col("depth").desc()], add=("leaves", "saved")), "below")
    per_conv = below.groupBy("conv_id").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved")).where("all_leaves != 0 or all_saved != 0")
    in_all = paths.join(per_conv, "conv_id").groupBy(*NODE).agg(F.sum("all_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved_tokens"))
    whole = below.join(in_all, NODE, "left").join(per_conv, "conv_id", "left")
    total = lambda c, own: (F.coalesce(c, zero) - F.coalesce(f"all_{own}", zero) + F.col(f"sum_{own}")).alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("n_leaves", "leaves"), total("saved_tokens", "saved"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "fp")
