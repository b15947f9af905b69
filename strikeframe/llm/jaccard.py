"""N-gram Jaccard join: size-aware, heavy and light, with one component for each group of linked documents.

Every text becomes its set of hashed word shingles; equal sets are one node. Nodes with Jaccard similarity of at
least ``num / den`` share a shingle within their first size - need + 1 shingles, need = ceil(num * size / den),
in any order that all share; and two within one more. The order is by document frequency (of shingles frequent in
portions of the text: the sum over those portions), so that a node whose own shingles fill that prefix has nothing to
look up.

* ``node_table`` reads the texts once: size, set digest and a 1024-bit parity sketch, whose Hamming distance never
  exceeds the symmetric difference and so rules pairs out but never in.
* ``prefixes`` deals packed shingles by value, counts nodes, and deals the shared ones back by node. Shingles that
  are frequent within portions of the text are summed beforehand; their postings carry the sum and are dealt at
  random, so none of them gathers in a task.
* Small sets enumerate the pairs (subsets of two) of their longer prefix; large sets, and the small ones near them
  in size, are put on inverted lists of their prefix. The boundary in size is where the sum of both costs is least.
* Stars first: each list's members are compared with its most typical member only, which is linear (a long list is
  dealt in parts, whose centres are compared in turn). What links is merged; then only members of different components on a list are compared, in blocks of bounded size. A link
  inside a component changes no component, so none is lost that matters.
* Comparisons are exact, over the whole sets of the texts concerned.

Defined results: null and empty texts and texts without words have no shingles, no node, and are their own
component; a text of fewer words than the width has one shingle, the whole; repeated rows each get a row; rows that
share an id keep their own sets; ties in the order go to the smaller hash; an empty table gives an empty table;
extra columns are ignored by ``join``, whatever their names, and kept by ``one_of_each``; a text is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.llm import textvec as V
from strikeframe.llm.common import discard, has, lean, lean_group, membership, written

WIDTH, NUM, DEN = 5, 75, 100
SKETCH = 1024
#: Postings that a task packs or unpacks at a time.
PACKED = 1_000_000
#: Pairs that a task remembers so as not to tell them twice; all are made distinct afterwards.
REMEMBERED = 200_000
#: A shingle in this share of a portion's nodes is summed beforehand; so many such shingles are kept at most (which
#: are kept is a matter of speed only: the rest are counted like all others).
FREQUENT, KEPT = 1 / 200, 500_000
#: Members of a list that are compared with each other in one block, and about as many that one task leads.
BLOCK, DEALT = 512, 4096
#: A member's least keys, by which a pair is told only by the first list that holds both, if that is among them (a
#: list that holds nodes of two components is compared, so that first list surely is).
FIRST_KEYS = 8


def _nodes(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set size and node: the first 8 bytes of its set's digest (0 for empty sets)."""
    size = V.row_counts(rows, n)
    ends = np.cumsum(size)
    raw = values.astype("<u8").tobytes()
    node = np.zeros(n, np.int64)
    for i in np.flatnonzero(size):
        node[i] = int.from_bytes(hashlib.blake2b(raw[8 * (ends[i] - size[i]) : 8 * ends[i]], digest_size=8).digest(), "little", signed=True)
    return size, node


def _sketches(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Parity of the shingles that fall on each of SKETCH bits, in 64-bit words."""
    bit = (V.mix(values) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(rows * SKETCH + bit, minlength=n * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH), axis=1, bitorder="little").view("<i8")


def _portions(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = V.flat(batch.column(column))
    for i, j in V.portions(bounds):
        yield i, j, *V.shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], width)


def node_table(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, size, node and sketch of each row; and, in rows of kind 1, shingles (node) frequent in a portion (size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, rows in _portions(batch, 1, width):
                n = j - i
                size, node = _nodes(values, rows, n)
                first = np.zeros(n, bool)
                first[np.unique(node, return_index=True)[1]] = True
                shingles, count = np.unique(values[first[rows]], return_counts=True)
                often = count >= max(8, FREQUENT * first.sum())
                words = SKETCH // 64
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array(_sketches(values, rows, n).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), batch.column(0).slice(i, n), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), sketch],
                    names=["kind", "doc_id", "size", "node", "sketch"],
                )
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(shingles[often].view(np.int64)), pa.nulls(k, pa.list_(pa.int64()))],
                    names=["kind", "doc_id", "size", "node", "sketch"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(lean(run), "kind int, doc_id long, size long, node long, sketch array<long>")


def _pack48(ordered: np.ndarray) -> bytes:
    """Rising 64-bit integers as differences, of 6 bytes if they fit."""
    steps = np.diff(ordered, prepend=np.uint64(0)).astype("<u8")
    head = steps[:1].tobytes()
    if len(steps) > 1 and steps[1:].max() < (1 << 48):
        return b"6" + head + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"8" + steps.tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.cumsum(np.frombuffer(data, "<u8", offset=1), dtype=np.uint64)
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, :6] = rest
    steps[0] = np.frombuffer(data[1:9], np.uint8)
    return np.cumsum(steps.ravel().view("<u8"), dtype=np.uint64)


def _cuts(sorted_buckets: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(sorted_buckets, np.arange(buckets + 1))


_BLOB = "bucket int, known boolean, shingles binary, at binary, counts binary, nodes binary"


def _blob(bucket: int, known: bool, shingles: np.ndarray, at: np.ndarray, nodes: np.ndarray, counts: np.ndarray | None = None) -> dict:
    used, at = np.unique(at, return_inverse=True)
    at = at.astype("<u2" if len(used) < 65536 else "<u4")
    return {
        "bucket": int(bucket), "known": known, "shingles": _pack48(shingles), "at": at.tobytes(), "nodes": nodes[used].astype("<i8").tobytes(),
        "counts": None if counts is None else counts.astype("<u4").tobytes(),
    }


def _unblob(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shingles = _unpack48(row["shingles"]) if row["at"] else np.zeros(0, np.uint64)
    nodes = np.frombuffer(row["nodes"], "<i8")
    at = np.frombuffer(row["at"], "<u2" if len(nodes) < 65536 else "<u4")
    counts = np.zeros(len(at), np.int64) if row["counts"] is None else np.frombuffer(row["counts"], "<u4").astype(np.int64)
    return shingles, nodes[at], counts


_ARROW_BLOB = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("shingles", pa.binary()), ("at", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary())])


def prefixes(docs: DataFrame, info: DataFrame, text: str, width: int, num: int, den: int) -> DataFrame:
    """node, size, own (shingles of no other node), sketch, and the shared shingles of the longer prefix with their
    frequencies, rarest first; ``short`` of them are in the shorter prefix. Nodes without any have no row."""
    spark = docs.sparkSession
    frequent = info.where("kind = 1").groupBy("node").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "node").limit(KEPT).collect()
    known = sorted((r.node & 0xFFFFFFFFFFFFFFFF, r.n) for r in frequent)
    shared = spark.sparkContext.broadcast((np.array([k for k, _ in known], np.uint64), np.array([n for _, n in known], np.int64)))
    total = info.where("kind = 0").agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // PACKED))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sums = shared.value
        seed = 0
        for batch in batches:
            for i, j, values, rows in _portions(batch, 0, width):
                size, node = _nodes(values, rows, j - i)
                first = np.zeros(j - i, bool)
                first[np.unique(node, return_index=True)[1]] = True
                keep = first[rows]
                order = np.argsort(values[keep], kind="stable")
                values, rows = values[keep][order], rows[keep][order]
                place = np.searchsorted(often, values)
                hit = np.zeros(len(values), bool) if not len(often) else often[np.minimum(place, len(often) - 1)] == values
                out = []
                if hit.any():
                    seed += 1
                    at = int(V.mix(node[:1].view(np.uint64) + np.uint64(seed))[0] % np.uint64(buckets))
                    out.append(_blob(at, True, values[hit], rows[hit], node, sums[place[hit]]))
                values, rows = values[~hit], rows[~hit]
                cut = _cuts(_bucket(values, buckets), buckets)
                out += [_blob(b, False, values[cut[b] : cut[b + 1]], rows[cut[b] : cut[b + 1]], node) for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_pylist(out, _ARROW_BLOB)

    def count(table: pa.Table) -> pa.Table:
        parts: dict[bool, list] = {True: [], False: []}
        for row in table.to_pylist():
            parts[row["known"]].append(_unblob(row))
        done = []
        for is_known, got in parts.items():
            if not got:
                continue
            shingles, nodes, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((nodes, shingles))
            shingles, nodes, counts = shingles[order], nodes[order], counts[order]
            new = np.ones(len(shingles), bool)
            new[1:] = (shingles[1:] != shingles[:-1]) | (nodes[1:] != nodes[:-1])
            shingles, nodes, counts = shingles[new], nodes[new], counts[new]
            if not is_known:
                starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
                counts = np.repeat(np.diff(np.append(starts, len(shingles))), np.diff(np.append(starts, len(shingles))))
            done.append((shingles[counts > 1], nodes[counts > 1], counts[counts > 1]))
        shingles, nodes, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        to = _node_bucket(nodes, buckets)
        order = np.lexsort((shingles, to))
        shingles, nodes, counts, to = shingles[order], nodes[order], counts[order], to[order]
        cut = _cuts(to, buckets)
        out = [_by_node(b, *(x[cut[b] : cut[b + 1]] for x in (shingles, nodes, counts))) for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.Table.from_pylist(out, _ARROW_BLOB)

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        got = [_unblob(r) for r in rows if r["known"]]
        about = [r for r in rows if not r["known"]]
        out = {k: [] for k in ("node", "size", "own", "sketch", "shingles", "counts", "short")}
        if got and about:
            shingles, nodes, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((shingles, counts, nodes))
            shingles, nodes, counts = shingles[order], nodes[order], counts[order]
            new = np.ones(len(shingles), bool)
            new[1:] = (shingles[1:] != shingles[:-1]) | (nodes[1:] != nodes[:-1])
            shingles, nodes, counts = shingles[new], nodes[new], counts[new]
            for r in about:
                node, size = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["counts"], "<u4").astype(np.int64)
                sketch = np.frombuffer(r["at"], "<i8").reshape(len(node), -1)
                begin, end = np.searchsorted(nodes, node), np.searchsorted(nodes, node, "right")
                own = size - (end - begin)
                left = size - -(-num * size // den) + 1 - own
                for k in np.flatnonzero((left > -1) & (end > begin)):
                    short, long = max(0, left[k]), left[k] + 1
                    taken = slice(begin[k], min(begin[k] + long, end[k]))
                    if taken.stop > taken.start:
                        out["node"].append(int(node[k]))
                        out["size"].append(int(size[k]))
                        out["own"].append(int(own[k]))
                        out["sketch"].append(sketch[k])
                        out["shingles"].append(shingles[taken].view(np.int64))
                        out["counts"].append(counts[taken])
                        out["short"].append(int(min(short, taken.stop - taken.start)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sketch = np.asarray(batch.column(2).flatten()).reshape(len(node), -1)
            to = _node_bucket(node, buckets)
            out = []
            for b in np.unique(to):
                k = to == b
                out.append({"bucket": int(b), "known": False, "shingles": b"", "at": sketch[k].astype("<i8").tobytes(), "counts": size[k].astype("<u4").tobytes(), "nodes": node[k].astype("<i8").tobytes()})
            yield pa.RecordBatch.from_pylist(out, _ARROW_BLOB)

    packed = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(lean(pack), _BLOB)
    counted = packed.groupBy("bucket").applyInArrow(lean_group(count), _BLOB)
    nodes = info.where("kind = 0 and node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    described = nodes.select("node", "size", "sketch").mapInArrow(lean(describe), _BLOB)
    return counted.unionByName(described).groupBy("bucket").applyInArrow(
        lean_group(choose), "node long, size long, own long, sketch array<long>, shingles array<long>, counts array<long>, short long"
    )


def _bucket(sorted_values: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the 64-bit integers; keeps their order."""
    return ((sorted_values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _node_bucket(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return (V.mix(nodes.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64)


def _by_node(bucket: int, shingles: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> dict:
    used, at = np.unique(nodes, return_inverse=True)
    return _blob(bucket, True, shingles, at, used, counts)


#: What comparing with one more member of a list costs, in postings; a list's main component costs no more than a block.
COMPARED = 1 / 256


def boundary(prefix: DataFrame) -> int:
    """The size up to which enumerating pairs is cheaper than scanning lists.

    A pair costs the posting that it writes; a place on a list costs its posting and what comparing with the list's
    members costs. The costs are summed over size classes, and the classes from the smallest on are light as long as
    that lowers the sum.
    """
    step = F.ceil(F.log2("size") * 4)
    pairs = F.size("shingles").cast("double") * (F.size("shingles") - 1) / 2
    scans = F.aggregate(F.slice("counts", F.lit(1), F.col("short").cast("int")), F.lit(0.0), lambda s, n: s + 1.0 + F.least(n, F.lit(BLOCK)) * COMPARED)
    classes = prefix.groupBy(step.alias("step")).agg(F.max("size"), F.sum(pairs), F.sum(scans)).orderBy("step").collect()
    best, at = 0.0, 0
    so_far = 0.0
    for _, largest, light, heavy in classes:
        so_far += light - heavy
        if so_far < best:
            best, at = so_far, largest
    return at


def keyed(prefix: DataFrame, most_light: int, num: int, den: int) -> DataFrame:
    """node, size, share (of own shingles), sketch, the node's keys in order with a bound of each one's frequency, and
    the first of the keys: pairs of small sets, lists of large ones and of small ones near them."""
    light = F.col("size") <= most_light
    n = F.size("shingles")
    count = lambda i: F.element_at("counts", i)
    entry = lambda key, often: F.struct(key.alias("key"), often.alias("n"))
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.slice("shingles", i + 1, n - i), lambda y, j: entry(F.xxhash64(F.element_at("shingles", i), y, F.lit("pair")), F.least(count(i), count(i + j + 1)))
            ),
        )
    )
    none = F.array().cast("array<struct<key:bigint,n:bigint>>")
    near = F.col("size") * den >= F.lit(num * (most_light + 1))
    short = F.col("short").cast("int")
    listed = F.zip_with(F.slice("shingles", F.lit(1), short), F.slice("counts", F.lit(1), short), entry)
    keys = F.concat(F.when(light & (n > 1), pairs).otherwise(none), F.when(~light | near, listed).otherwise(none))
    found = prefix.select(F.array_sort(keys).alias("keys"), "node", "size", (F.col("own") / F.col("size")).cast("float").alias("share"), "sketch")
    firsts = F.slice(F.concat("keys.key", F.array_repeat(F.lit(2**63 - 1), FIRST_KEYS)), 1, FIRST_KEYS)
    return found.where(F.size("keys") > 0).withColumn("firsts", firsts)


def lists(keys: DataFrame) -> DataFrame:
    """key, node, share, and how many parts a list as frequent as the key is dealt in."""
    return keys.select("node", "share", F.inline("keys")).select("key", "node", "share", F.ceil(F.col("n") / DEALT).cast("int").alias("parts"))


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """What sizes and sketches allow."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (small * den >= large * num) & (apart * (den + num) <= (small + large) * (den - num))


def led(members: DataFrame) -> DataFrame:
    """node and centre of each member of a part of a list, and, of parts of long lists, the centre's own row with its
    key (and a null centre): one pass over the lists in order, so no list is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            key, part, node, share, parts = (np.asarray(c) for c in batch.columns)
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            carried = last is not None and last[:2] == (key[0], part[0])
            fresh[0] = not carried
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            centre = node[at]
            if carried:
                centre[: int(np.argmax(fresh)) if fresh.any() else len(key)] = last[2]
            last = (int(key[-1]), int(part[-1]), int(centre[-1]))
            pair, head = np.flatnonzero(node != centre), np.flatnonzero(fresh & (parts > 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[pair], node[head]])),
                    pa.array(np.concatenate([centre[pair], np.zeros(len(head), np.int64)]), mask=np.arange(len(pair) + len(head)) >= len(pair)),
                    pa.array(np.concatenate([np.zeros(len(pair), np.int64), key[head]])),
                    pa.array(np.concatenate([np.zeros(len(pair), np.float32), share[head]])),
                ],
                names=["node", "centre", "key", "share"],
            )

    dealt = members.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "share", "parts")
    spread = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(spread, "key", "part").sortWithinPartitions("key", "part", "share", "node").mapInArrow(lean(run), "node long, centre long, key long, share float")


def stars(keys: DataFrame, num: int, den: int, scratch: list[str]) -> DataFrame:
    """Pairs of each member and the most typical member of its list: the one with the least share of own shingles.

    A long list is dealt in parts with a centre each, and the parts' centres are compared with the first of them.
    """
    first = written(led(lists(keys)), "jaccard-centres", scratch)
    heads = first.where("centre is null").select("key", "node", "share", F.lit(1).alias("parts"))
    pairs = first.where("centre is not null").select("node", "centre").union(led(heads).where("centre is not null").select("node", "centre")).distinct()
    about = keys.select("node", F.struct("size", "sketch").alias("m"))
    both = pairs.join(about.select("node", F.col("m").alias("x")), "node").join(about.select(F.col("node").alias("centre"), F.col("m").alias("y")), "centre")
    return both.where(may_link("x", "y", num, den)).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def across(keys: DataFrame, merged: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of a list that are in different components and that sizes and sketches allow.

    The members of a list's most frequent component aren't compared with each other, so they are dealt in blocks by
    themselves: only the rest, few as a rule, is copied to all of these blocks and compared with itself.
    """
    labelled = keys.join(merged, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = labelled.select("node", "label", F.explode("keys.key").alias("key"))
    by_label = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("main.label").alias("main"), blocks(F.col("main.n")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n")).alias("rest_blocks"))
    about = labelled.select("node", "size", "sketch", "firsts")
    member = placed.join(mixed, "key").join(about, "node").withColumn("in_main", F.col("label") == F.col("main"))
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))

    def cell(across_main: bool, rest: Column, other: Column, side: Column, alone: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(across_main), rest, other).alias("cell"), side.alias("side"), alone.alias("alone"))

    rest_blocks, main_blocks = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("rest_blocks", "main_blocks"))
    block, no = F.col("block"), F.lit(False)
    of_main = F.transform(rest_blocks, lambda x: cell(True, x, block, F.lit(1), no))
    of_rest = F.concat(
        F.transform(main_blocks, lambda x: cell(True, block, x, F.lit(0), no)),
        F.transform(rest_blocks, lambda x: cell(False, F.least(block, x), F.greatest(block, x), F.when(block <= x, 0).otherwise(1), block == x)),
    )
    member = member.withColumn("place", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_rest)))
    member = member.select("place.cell", "key", "node", "size", "label", "sketch", "firsts", "place.side", "place.alone")
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: dict) -> tuple[np.ndarray, np.ndarray]:
            n = len(t["node"])
            i, j = np.triu_indices(n, 1)
            keep = (t["label"][i] != t["label"][j]) & (t["alone"][i] | (t["side"][i] != t["side"][j]))
            i, j = i[keep], j[keep]
            small, large = np.minimum(t["size"][i], t["size"][j]), np.maximum(t["size"][i], t["size"][j])
            keep = small * den >= large * num
            i, j, both = i[keep], j[keep], (small + large)[keep]
            apart = np.bitwise_count((t["sketch"][i] ^ t["sketch"][j]).view(np.uint64)).sum(1, dtype=np.int64)
            keep = apart * (den + num) <= both * (den - num)
            i, j = i[keep], j[keep]
            x, y = t["firsts"][i], t["firsts"][j]
            told = ((x[:, :, None] == y[:, None, :]) & (x < t["key"][i][:, None])[:, :, None]).any((1, 2))
            keep = ~told
            return t["node"][i[keep]], t["node"][j[keep]]

        rest: dict[str, np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()

        def cells(t: dict, last: bool) -> tuple[list, dict]:
            edges = np.flatnonzero(np.append(True, t["cell"][1:] != t["cell"][:-1])) if len(t["cell"]) else np.zeros(0, np.int64)
            stop = len(t["cell"])
            ends = np.append(edges[1:], stop)
            if not last and len(edges):
                stop = edges[-1]
                edges, ends = edges[:-1], ends[:-1]
            out = []
            for a, b in zip(edges, ends, strict=True):
                if b - a > 1:
                    x, y = pairs({k: v[a:b] for k, v in t.items()})
                    out += zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)
            return out, {k: v[stop:] for k, v in t.items()}

        def emitted(found: list) -> pa.RecordBatch:
            new = sorted({p for p in found if p not in seen})
            if len(seen) < REMEMBERED:
                seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        for batch in batches:
            t = {c: np.asarray(batch.column(c)) for c in ("cell", "key", "node", "size", "label", "side")}
            t["alone"] = np.asarray(batch.column("alone").cast(pa.int8())).astype(bool)
            for c in ("sketch", "firsts"):
                t[c] = np.asarray(batch.column(c).flatten()).reshape(len(batch), -1)
            t = t if rest is None else {k: np.concatenate([rest[k], v]) for k, v in t.items()}
            found, rest = cells(t, False)
            yield emitted(found)
        if rest is not None:
            yield emitted(cells(rest, True)[0])

    return member.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lean(compare), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, text: str, width: int, num: int, den: int, scratch: list[str]) -> DataFrame:
    """The pairs whose sets are similar enough, by comparing them whole."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shared = membership(ends)  # texts that surely aren't concerned go no further

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, rows in _portions(batch, 0, width):
                size, node = _nodes(values, rows, j - i)
                keep = (size > 0) & has(shared, node)
                first = np.zeros(j - i, bool)
                first[np.unique(node, return_index=True)[1]] = True
                end = np.cumsum(size)
                at = np.flatnonzero(keep & first)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([values[end[k] - size[k] : end[k]].tobytes() for k in at], pa.binary())], names=["node", "hashes"])

    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(lean(sets), "node long, hashes binary")
    found = written(found.join(ends, "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets", scratch)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * same >= num * (len(p) + len(q) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(found.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(found.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(similar), "a long, b long")


def components(links: DataFrame, scratch: list[str], label: str = "components") -> DataFrame:
    """node and label (the smallest node that links reach), by large stars and small stars in turn."""
    edges = written(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), label, scratch)
    before = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("hi")).where("x <> hi").select(F.col("x").alias("lo"), "hi")
        edges = written(small.distinct(), label, scratch)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select("lo", "lo").distinct())
        before = now


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row."""
    scratch: list[str] = []
    info = written(node_table(docs, key, text, width), "jaccard-nodes")
    prefix = written(prefixes(docs, info, text, width, num, den), "jaccard-prefixes", scratch)
    keys = written(keyed(prefix, boundary(prefix), num, den), "jaccard-keys", scratch)
    near = written(stars(keys, num, den, scratch), "jaccard-stars", scratch)
    first = written(verified(near, docs, text, width, num, den, scratch), "jaccard-links", scratch)
    merged = written(components(first, scratch), "jaccard-merged", scratch)
    rest = written(across(keys, merged, num, den), "jaccard-across", scratch)
    second = written(verified(rest, docs, text, width, num, den, scratch), "jaccard-links", scratch)
    labels = components(first.union(second), scratch)
    rows = info.where("kind = 0").select("doc_id", "size", "node")
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = written(ids, "jaccard-ids")
    discard(docs.sparkSession, scratch)  # only info and ids are read from here on
    final = ids.select("node", "label").join(ids.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return rows.join(final, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those linked to one of a smaller id; rows of one id count as one, rows without id stay.

    Only rows that a membership filter can't clear are shuffled for the exact test.
    """
    groups = written(join(docs, key, text, **options), "jaccard-groups")
    verdict = groups.where("doc_id is not null").groupBy("doc_id").agg((F.min("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows"))
    verdict = written(verdict.where("not stays or rows > 1"), "jaccard-verdict")
    shared = membership(verdict.select("doc_id"))
    own = [f"__c{i}__" for i in range(len(docs.columns))]  # columns keep their names, whatever they are
    names, docs_key = own, own[docs.columns.index(key)]
    given, docs = docs.columns, docs.toDF(*own)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(names))
            doubt = has(shared, np.asarray(ids.fill_null(0))) & np.asarray(ids.is_valid())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids, pa.array(doubt)], names=[*names, "__id__", "__doubt__"])

    schema = docs.select("*", F.col(docs_key).cast("long").alias("__id__"), F.lit(True).alias("__doubt__")).schema
    rows = docs.select("*", F.col(docs_key).cast("long").alias("__id__")).mapInArrow(lean(marked), schema)
    doubtful = rows.where("__doubt__").join(verdict.withColumnRenamed("doc_id", "__id__"), "__id__", "left")
    exact = doubtful.where(F.coalesce("stays", F.lit(True))).dropDuplicates(["__id__"])
    kept = rows.where("not __doubt__").select(*names).unionByName(exact.select(*names))
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, given, strict=True)])
