"""Sharding: a k-d tree over the metadata of documents, cut at distributed weighted medians.

Column expressions only. All nodes of a level are cut together: a scan of the narrow metadata
table sums bytes by (node, bin), the driver reads at most nodes * BINS sums and narrows each
node's interval to one bin, until the cut is one value. No row of data is moved to find a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS, BINS = 24, 2048
#: A group of equal texts stays whole if it has no more than this share of a shard's bytes.
WHOLE_SHARE = 0.1
#: Documents of at most this share of a shard's bytes level the shards.
SMALL_SHARE = 0.01
#: Rows that one task numbers at a time.
NUMBERED = 50_000

#: Metadata of a text; equal texts have equal metadata, so that they share a place in the tree.
DIMENSIONS = ("bytes", "chars", "wide", "lines")


def _by_node(values: list, kind: str = "long") -> Column:
    """The value that each node has; a node without one has null."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node") + 1)


def _narrowed(rows: DataFrame, live: list[int], before: dict[int, int], targets: dict[int, float], extent: dict[int, tuple[int, int]]) -> tuple[dict, dict, dict]:
    """Where the running sum of sizes over v reaches each live node's target: (value, bytes below it, bytes of it), by node."""
    extent, before, held, left = dict(extent), dict(before), {}, list(live)
    while left:
        widths = {i: -(-(extent[i][1] - extent[i][0] + 1) // BINS) for i in left}
        each = lambda of: _by_node([of(i) if i in widths else None for i in range(max(live) + 1)])  # noqa: E731, B023
        low, high, width = each(lambda i: extent[i][0]), each(lambda i: extent[i][1]), each(lambda i: widths[i])
        within = rows.where((F.col("node") <= max(live)) & F.col("v").between(low, high))
        sums: dict[int, list] = {}
        for r in within.groupBy("node", F.floor((F.col("v") - low) / width).alias("bin")).agg(F.sum("size").alias("s")).collect():
            sums.setdefault(r.node, []).append((r.bin, r.s))
        for i in list(left):
            bins = sorted(sums[i])
            for b, s in bins:
                if before[i] + s >= targets[i] or b == bins[-1][0]:
                    break
                before[i] += s
            first = extent[i][0] + int(b) * widths[i]
            extent[i], held[i] = (first, min(first + widths[i] - 1, extent[i][1])), s
            if widths[i] == 1:
                left.remove(i)
    return {i: extent[i][0] for i in live}, before, held


def kd_leaves(meta: DataFrame, weights: dict[int, float], dimensions: tuple[str, ...] = DIMENSIONS, whole_bytes: float = 0) -> DataFrame:
    """meta (doc_id, size, crc, spread and dimensions) with the shard of each row; a shard gets bytes in proportion to its weight. Each level reads meta some times and writes it once.

    A group of equal texts on a cut goes whole to the side that is nearer its target, unless it has over whole_bytes; it is then dealt by id.
    """
    nodes, rows = [sorted(weights)], meta.withColumn("node", F.lit(0))
    whole = meta.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).first()
    while any(len(n) > 1 for n in nodes):
        facts = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *[F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in dimensions]).collect()}
        live = [i for i, n in enumerate(nodes) if len(n) > 1 and i in facts]
        widest = {i: max(range(len(dimensions)), key=lambda d: (facts[i][dimensions[d]].hi - facts[i][dimensions[d]].lo) / max(1, whole[d] or 0)) for i in live}  # noqa: B023
        share = lambda n: sum(weights[s] for s in n[: len(n) // 2]) / sum(weights[s] for s in n)
        targets = {i: facts[i].total * share(nodes[i]) for i in live}
        each = lambda of: _by_node([of.get(i) for i in range(len(nodes))])  # noqa: E731, B023
        rows = rows.withColumn("own", F.element_at(F.array(*dimensions), each({i: d + 1 for i, d in widest.items()}).cast("int")))
        extent = {i: (facts[i][dimensions[d]].lo, facts[i][dimensions[d]].hi) for i, d in widest.items()}
        words = dict.fromkeys(live, (0, (1 << 32) - 1))
        cut, before, _ = _narrowed(rows.withColumn("v", F.col("own")), live, dict.fromkeys(live, 0), targets, extent)
        # Ties in the dimension are cut by the checksum of the text, so that equal texts stay together.
        tied = rows.where(F.col("own") == each(cut))
        crc, before, held = _narrowed(tied.withColumn("v", F.col("crc")), live, before, targets, words)
        hot = [i for i in live if held[i] > whole_bytes]
        dealt = _narrowed(tied.where(F.col("crc") == each(crc)).withColumn("v", F.col("spread")), hot, before, targets, words)[0] if hot else {}
        last = {i: dealt.get(i, (1 << 32) if before[i] + held[i] / 2 <= targets[i] else -1) for i in live}
        above = (F.col("own") > each(cut)) | ((F.col("own") == each(cut)) & ((F.col("crc") > each(crc)) | ((F.col("crc") == each(crc)) & (F.col("spread") > each(last)))))
        kept, below_at, above_at, new = {}, {}, {}, []
        for i, n in enumerate(nodes):
            if i in targets:
                below_at[i], above_at[i] = len(new), len(new) + 1
                new += [n[: len(n) // 2], n[len(n) // 2 :]]
            elif i in facts:
                kept[i] = len(new)
                new.append(n)
        rows = materialize(rows.withColumn("node", F.coalesce(each(kept), F.when(above, each(above_at)).otherwise(each(below_at))).cast("int")).drop("own"))
        nodes = new
    return rows.withColumn("shard", _by_node([n[0] for n in nodes]).cast("int")).drop("node")


def _moved(placed: DataFrame, shards: int, limit: float, give: dict[int, float], take: dict[int, float], whole_bytes: float, past: bool) -> DataFrame:
    """placed, with a run of documents of at most limit bytes, by the checksum of the text, from each shard of give to those of take in proportion. A run ends nearest to what is to be given or, if past, not short of it."""
    rows = placed.withColumn("node", F.col("shard")).withColumn("v", F.col("crc"))
    have = {r.node: r.s for r in rows.where(F.col("size") <= limit).groupBy("node").agg(F.sum("size").alias("s")).collect()}
    live = [s for s in give if s in have]
    if not live or not take:
        return placed
    want = {s: min(give[s], have[s]) for s in live}
    cut, before, held = _narrowed(rows.where(F.col("size") <= limit), live, dict.fromkeys(live, 0), want, dict.fromkeys(live, (0, (1 << 32) - 1)))
    last = {s: cut[s] if past or before[s] + held[s] / 2 <= want[s] else cut[s] - 1 for s in live}
    gives = (F.col("size") <= limit) & (F.col("crc") <= _by_node([last.get(s, -1) for s in range(shards)]))
    marked = materialize(rows.withColumn("gives", F.coalesce(gives, F.lit(False))).drop("v", "node"))
    pool = marked.where("gives").drop("gives", "shard")
    return marked.where("NOT gives").drop("gives").unionByName(kd_leaves(pool, take, ("spot",), whole_bytes).select(*placed.columns))


def levelled(placed: DataFrame, shards: int, small_share: float = SMALL_SHARE, whole_bytes: float = 0) -> DataFrame:
    """placed with shards nearer to equal. A tree of few large documents leaves shards uneven, as the error of a cut stays with all leaves below it.

    Small documents, of at most small_share of a shard, go from shards over the mean to those under it. A
    shard over the mean that hasn't enough of them first gives large ones to the shards that have most.
    """
    small = F.when(F.col("size") <= F.lit(small_share) * F.lit(placed.agg(F.sum("size")).first()[0] / shards), F.col("size"))
    for large_first in (True, False):
        facts = {r.shard: (r.s, r.small or 0) for r in placed.groupBy("shard").agg(F.sum("size").alias("s"), F.sum(small).alias("small")).collect()}
        mean = sum(s for s, _ in facts.values()) / shards
        over = {k: s - mean for k, (s, _) in facts.items() if s > mean}
        if large_first:
            stuck = {k: x for k, x in over.items() if x > max(facts[k][1], small_share * mean)}
            rich = {k: float(n) for k, (_, n) in facts.items() if k not in stuck and n > 0.2 * mean}
            placed = _moved(placed, shards, mean, stuck, rich, whole_bytes, True) if stuck and rich else placed
        else:
            lack = {k: mean - facts.get(k, (0, 0))[0] for k in range(shards) if facts.get(k, (0, 0))[0] < mean}
            placed = _moved(placed, shards, small_share * mean, over, lack, whole_bytes, False)
    return placed


def kd_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", whole_share: float = WHOLE_SHARE) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 8; the law is `bytes`: shards' sizes are near
    equal. The tree's leaves are levelled by small documents. Equal texts share a shard unless their
    group has over whole_share of a shard's bytes and lies on a cut; it is then dealt by id. slot numbers a shard's rows from 0 without gaps.
    grown_shard is null under this law. Null ids are dealt like any other; repeated rows keep their
    own slots. Other columns are left out. No rows give no rows; fewer texts than shards leave some empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes, n_chars = F.octet_length(text).cast("long"), F.length(text).cast("long")
    meta = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (n_bytes + 8).alias("size"), F.crc32(text).alias("crc"),
            F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("spread"), n_bytes.alias("bytes"), n_chars.alias("chars"),
            (n_bytes - n_chars).alias("wide"), (n_chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"), F.lit(0).cast("long").alias("spot"),
        )
    )
    n, total = meta.agg(F.count("*"), F.sum("size")).first()
    parts = max(1, -(-n // (shards * NUMBERED)))
    whole_bytes = whole_share * (total or 0) / shards
    placed = levelled(kd_leaves(meta, dict.fromkeys(range(shards), 1.0), DIMENSIONS, whole_bytes), shards, SMALL_SHARE, whole_bytes) if n else meta.withColumn("shard", F.lit(0))
    rows = placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(parts)).alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("c"))
    first = counts.select("shard", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return rows.join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + nth - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
