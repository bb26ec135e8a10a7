"""Groups of similar sets from signatures of which linked sets share several.

``grouped`` is shared by the similarity joins of this folder. Each brings its
own signatures (rows of a node and one signature, in one or two classes), the
number ``need`` of signatures of a class that linked nodes have in common at
least, and a sketch with a test that rules out pairs. Work is linear in the
signatures, but for pairs that resist every test:

1. Signatures of one node are dropped; a node with fewer than ``need`` shared
   ones in a class can link to nothing there. Of c shared ones only the
   c - need + 1 rarest make lists: two nodes with ``need`` in common meet in
   one of those. Dropped nodes make other signatures lone, so this is done
   twice. Passages that many documents share thus make no lists as long as
   the documents differ enough elsewhere.
2. Star rounds: in each list that spans components one node is paired with
   those of other components; sketches, then whole sets decide; links give
   components.
3. Lists that still span components and have the same node of most lists are
   one star, whose nodes are compared across components inside tasks, in
   blocks of bounded size that travel as one packed row each. First sketches
   tell which nodes have a possible partner at all, then the whole sets of
   those are compared, and only links that join components come out. So what
   is shuffled and written grows with nodes, not with pairs.

Every linked pair is in one component at the end: it meets in a list, and a
list's pairs are either inside a component or were tested.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .encoding import tidy

BLOCK = 4_096  # nodes compared at once with as many; members of a star in one task
BLOCK_BYTES = 16_000_000  # of whole sets compared at once with as many
STAR_ROUNDS = 2
BROADCAST_ROWS = 1_000_000  # a few longs each; larger sides are shuffled


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of longs if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rarest_lists(signs: DataFrame, part, need: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sig, node): the rarest shared signatures of every node that shares
    enough. ``signs``: (sig, node), rows of copies repeated or not; ``part``: a
    signature's class, over sig; ``need``: (node, part, need). The first count
    takes copies' signatures for shared ones, the second, over distinct rows,
    does not."""
    def shared_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")

    def enough(rows: DataFrame) -> DataFrame:
        per_node = rows.groupBy("node", part.alias("part")).agg(F.sort_array(F.collect_set(F.struct("n", "sig"))).alias("sigs"))
        return per_node.join(need, ["node", "part"]).where("size(sigs) >= need")

    shared = scratch.table(shared_of(signs.select("sig")), f"{name}-shared")
    left = scratch.table(enough(signs.join(shared, "sig")).select("node", F.explode("sigs.sig").alias("sig")), f"{name}-left")
    again = scratch.table(shared_of(left), f"{name}-again")
    rarest = enough(left.join(again, "sig")).select("node", F.explode(F.expr("slice(sigs.sig, 1, size(sigs) - need + 1)")).alias("sig"))
    lists = scratch.table(rarest.distinct(), f"{name}-lists")
    out = scratch.table(lists.join(shared_of(lists).select("sig"), "sig"), f"{name}-kept")
    scratch.drop(*[f"{name}-{x}" for x in ("shared", "left", "again", "lists")])
    return out


def only(payload: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of ``payload`` for some nodes, before they are shuffled."""
    wanted = scratch.table(nodes.select("node").distinct(), name)
    return payload.join(small(wanted), "node", "left_semi")


def by_star(pairs: DataFrame, payload: DataFrame, keep: Callable) -> DataFrame:
    """The distinct pairs (a, b) that ``keep(centre, members)`` leaves: the
    rows of ``payload`` (node, ...) of a star's centre a, sent once, and of a
    batch of its members b. Stars of many members are dealt in chunks."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("of"))
    placed = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "of").alias("chunk"))
    cols = [c for c in payload.columns if c != "node"]
    members = placed.withColumnRenamed("b", "node").join(payload, "node").select("a", "chunk", F.lit(1).alias("role"), "node", *cols)
    centres = placed.select("a", "chunk").distinct().withColumn("node", F.col("a")).join(payload, "node")
    both = centres.select("a", "chunk", F.lit(0).alias("role"), "node", *cols).unionByName(members)
    dealt = both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def stars(batches):
        centre = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b["a"].to_numpy(), b["chunk"].to_numpy()], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                rows = b.slice(lo, hi - lo)
                if rows["role"][0].as_py() == 0:
                    centre, rows = rows.slice(0, 1), rows.slice(1)
                if rows.num_rows:
                    out.append(rows.select(["a", "node"]).filter(pa.array(keep(centre, rows), pa.bool_())))
            if out:
                got = pa.Table.from_batches(out).combine_chunks()
                yield from got.rename_columns(["a", "b"]).to_batches()

    return dealt.mapInArrow(tidy(stars), "a long, b long")


def fetched(wanted: DataFrame, docs: DataFrame, items_of: Callable) -> DataFrame:
    """(node, items): the whole sets of ``wanted`` (node, rep_id, rep_key),
    read again from one text of each; ``items_of`` gives (node, set) of a
    text column. Texts are found by id and text hash, so rows without an id,
    or that share one, are found, too."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("rep_key"))
    of = small(wanted).select(F.col("node").alias("of"), "rep_id", F.col("rep_key").alias("of_key"))
    found = texts.join(of, (F.col("rep_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))

    def items(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [(w, s) for w, (n, s) in zip(part["of"].to_pylist(), items_of(part["text"])) if n == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in sets], pa.int64()),
                                                  pa.array([s.tobytes() for _, s in sets], pa.binary())], names=["node", "items"])

    return found.select("of", "text").mapInArrow(tidy(items), "node long, items binary").dropDuplicates(["node"])


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, items_of: Callable, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.table(wanted.join(nodes.select("node", "rep_id", "rep_key"), "node"), f"{name}-wanted")
    sets = scratch.table(fetched(wanted, docs, items_of), f"{name}-sets")

    def check(centre, rows):
        x = np.frombuffer(centre["items"][0].as_buffer(), np.uint64)
        for r in rows["items"]:
            y = np.frombuffer(r.as_buffer(), np.uint64)
            common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            yield den * common >= num * (len(x) + len(y) - common)

    out = scratch.table(by_star(pairs, sets, lambda c, r: list(check(c, r))), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-wanted")
    return out


def _sketch_test(block: Callable, num: int, den: int) -> Callable:
    def keep(centre, rows):
        both = block(*[np.concatenate([centre[c].to_numpy(zero_copy_only=False), rows[c].to_numpy(zero_copy_only=False)])
                       for c in ("n_shingles", "sketch")], num, den)
        out = np.zeros(rows.num_rows + 1, bool)
        out[both.near(0, np.arange(1, rows.num_rows + 1))] = True
        return out[1:]
    return keep


def _packed(cols: list[str]):
    """One row of Arrow bytes for each (star, block); rows come sorted."""
    def packed(batches):
        held, last = [], None

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int32()), pa.array([last[2]], pa.int32()),
                                               pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["star", "block", "blocks", "rows"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b[c].to_numpy() for c in ("star", "block", "blocks")], 1)
            cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                if held and tuple(key[lo].tolist()) != last:
                    yield row()
                    held = []
                last = tuple(key[lo].tolist())
                held.append(b.slice(lo, hi - lo).select(cols))
        if held:
            yield row()
    return packed


def _blocks_met(rows: DataFrame, cols: list[str], size, most: int, meet: Callable, schema: str, scratch: Scratch, name: str) -> DataFrame:
    """``meet(first, second)`` of all pairs of a star's blocks (second is None
    for a block with itself), as Arrow batches. ``rows``: (star, node, ...);
    a block's sizes add up to about ``most``; each is packed into one row."""
    sizes = rows.groupBy("star").agg(F.ceil(F.sum(size) / most).cast("int").alias("blocks"))
    rows = rows.join(sizes, "star").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = rows.select("star", "block", "blocks", *cols).repartition("star", "block").sortWithinPartitions("star", "block")
    packs = scratch.table(dealt.mapInArrow(tidy(_packed(cols)), "star long, block int, blocks int, rows binary"), name)
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    met = packs.select("star", "block", "rows", other).select("star", F.least("block", "other").alias("one"),
                                                              F.greatest("block", "other").alias("two"), "block", "rows")
    dealt = met.repartition("star", "one", "two").sortWithinPartitions("star", "one", "two", "block")

    def across(batches):
        held, last = [], None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                key = (r["star"], r["one"], r["two"])
                if held and key != last:
                    yield meet(*held, *[None] * (2 - len(held)))
                    held = []
                held.append(pa.ipc.open_stream(r["rows"]).read_all())
                last = key
        if held:
            yield meet(*held, *[None] * (2 - len(held)))

    return dealt.mapInArrow(tidy(across), schema)


def _close(block: Callable, num: int, den: int):
    """Nodes that have a partner of another component in their block that no
    sketch rules out."""
    def close(first, second):
        rows = first if second is None else pa.concat_tables([first, second])
        comp, cut = rows["comp"].to_numpy(), len(first)
        held = block(rows["n_shingles"].to_numpy(), rows["sketch"].to_numpy(), num, den)
        found = np.zeros(len(comp), bool)
        for i in range(cut):
            js = np.arange(i + 1 if second is None else cut, len(comp))
            js = js[comp[js] != comp[i]]
            if found[i]:
                js = js[~found[js]]
            for at in range(0, len(js), 64):  # once i is known to have one, only unknown ones matter
                part = js[at:at + 64]
                near = held.near(i, part[~found[part]] if found[i] else part)
                found[near] = True
                found[i] |= len(near) > 0
        return pa.RecordBatch.from_arrays([rows["node"].combine_chunks().filter(pa.array(found))], names=["node"])
    return close


def _joined(num: int, den: int):
    """Links that join the components of a block, by whole sets. Common items
    of one set with all others are counted in an inverted list."""
    def joined(first, second):
        rows = first if second is None else pa.concat_tables([first, second])
        node, cut = rows["node"].to_numpy(), len(first)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"].combine_chunks()]
        size = np.asarray([len(x) for x in sets])
        at = np.append(0, np.cumsum(size))
        _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        begin = np.cumsum(times) - times
        owner = np.repeat(np.arange(len(sets)), size)[np.argsort(item, kind="stable")]
        _, root = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        out_a, out_b = [], []
        for i in range(cut):
            js = np.arange(i + 1 if second is None else cut, len(sets))
            js = js[root[js] != root[i]]
            js = js[np.minimum(size[js], size[i]) * den >= np.maximum(size[js], size[i]) * num]
            if not len(js):
                continue
            mine = item[at[i]:at[i + 1]]
            mine = mine[times[mine] > 1]
            n = times[mine]
            places = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[places], minlength=len(sets))[js]
            for j in js[den * common >= num * (size[js] + size[i] - common)].tolist():
                if root[j] != root[i]:
                    out_a.append(int(node[i]))
                    out_b.append(int(node[j]))
                    root[root == root[j]] = root[i]
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    return joined


def _far_links(placed: DataFrame, nodes: DataFrame, docs: DataFrame, block: Callable, items_of: Callable, num: int, den: int,
               scratch: Scratch) -> DataFrame:
    """Links across the components that lists still span: enough to join
    whatever any of them joins."""
    # A list's star is its node with most lists, so lists of the same nodes share one.
    often = placed.groupBy("node").agg(F.count("*").alias("times"))
    rank = F.struct(-F.col("times"), "node")
    spans = placed.join(often, "node").groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("node", rank).alias("star"))
    spans = spans.where("lo != hi")
    rows = placed.join(spans.select("sig", "star"), "sig").select("star", "node", "comp").distinct()
    rows = scratch.table(rows, "far")
    sketched = rows.join(only(nodes.select("node", "n_shingles", "sketch"), rows, scratch, "far-nodes"), "node")
    near = _blocks_met(sketched, ["node", "comp", "n_shingles", "sketch"], F.lit(1), BLOCK, _close(block, num, den), "node long", scratch, "far-packs")
    near = scratch.table(near.distinct().join(nodes.select("node", "rep_id", "rep_key"), "node"), "far-near")
    sets = scratch.table(fetched(near, docs, items_of), "far-sets")
    whole = rows.join(sets, "node")
    found = _blocks_met(whole, ["node", "comp", "items"], F.length("items"), BLOCK_BYTES, _joined(num, den), "a long, b long", scratch, "far-whole")
    found = scratch.table(found, "far-links")
    scratch.drop("far", "far-packs", "far-near", "far-sets", "far-whole", "far-nodes")
    return found


def grouped(docs: DataFrame, nodes: DataFrame, signs: DataFrame, need: DataFrame, block: Callable, items_of: Callable,
            num: int, den: int, scratch: Scratch, part) -> DataFrame:
    """(node, comp, component_id): the component of every node, and the
    smallest doc_id in it. ``nodes``: (node, rep_id, rep_key, n_shingles,
    sketch); ``block(sizes, sketches, num, den)`` has ``near(i, js)``, those
    of js that no sketch rules out for i; ``signs``, ``part``, ``need``:
    see ``rarest_lists``."""
    lists = rarest_lists(signs, part, need, scratch, "signs")
    sketches = nodes.select("node", "n_shingles", "sketch")
    test = _sketch_test(block, num, den)
    spark = docs.sparkSession
    labels = spark.createDataFrame([], "node long, comp long")
    tested = spark.createDataFrame([], "a long, b long")

    def placed(labels):
        return lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def stars(labels):
        return labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))

    def untested(pairs):
        done = tested.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        return pairs.join(done, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")

    for k in range(STAR_ROUNDS):
        now = placed(labels)
        centre = now.groupBy("sig").agg(F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(k), "node")).alias("c"),
                                        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        met = now.join(centre.select("sig", "c"), "sig").where("comp != c.comp")
        pairs = met.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        pairs = scratch.table(untested(pairs), f"star-{k}-met")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        near = scratch.table(by_star(pairs, only(sketches, ends, scratch, f"star-{k}-ends"), test), f"star-{k}-near")
        found = linked(near, nodes, docs, items_of, num, den, scratch, f"star-{k}")
        tested = tested.union(pairs)
        scratch.drop(f"star-{k}-near", f"star-{k}-ends")
        if found.isEmpty():
            break
        labels = components(stars(labels).union(found), scratch, f"round-{k}")
    far = _far_links(placed(labels), nodes, docs, block, items_of, num, den, scratch)
    if not far.isEmpty():
        labels = components(stars(labels).union(far), scratch, "last")
    joined = nodes.select("node", "rep_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = joined.groupBy("comp").agg(F.min("rep_id").alias("component_id"))
    ids = scratch.table(joined.join(smallest, "comp").select("node", "comp", "component_id"), "ids")
    scratch.drop("signs-kept", "far-links", *[f"star-{k}-met" for k in range(STAR_ROUNDS)])
    return ids


def per_row(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node, ...) with comp and component_id; a row of the
    empty set (null node) is alone."""
    inside = rows.where("node is not null").join(ids, "node").select(*rows.columns, "comp", "component_id")
    alone = rows.where("node is null").select(*rows.columns, F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return inside.unionByName(alone)
