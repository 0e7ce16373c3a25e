"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit where over half of the hashes of a text's shingles have it.  Fingerprints link at
``distance`` or fewer differing bits; linked texts form classes.

The index has three levels.  Upper nodes stand for a masked bit pattern: the bits are dealt into
``distance + 2`` segments, and a node fixes two of them.  Two fingerprints that link differ in at most
``distance`` segments, so they meet in one upper node at least, and differ by nothing on its mask.  Below
it fingerprints are sorted by Gray rank, where neighbours share most bits, and runs of them become lower
nodes that carry the bits all their fingerprints share.  A pair of lower nodes is pruned as a whole if
what they share already differs in more than ``distance`` bits; only fingerprints of the pairs that are
left are compared.  A link is never missed, and no upper node has to fit a task: its sorted run may go on
in the next partition, and pairs of its lower nodes are independent.

Equal fingerprints are one row of the index, so exact copies cost nothing.  A comparison of two lower nodes
gives a star for each of its components instead of all links.

Defined results: null and empty texts have fingerprint zero, which links like any other; fewer words than
a shingle make one shingle; repeated rows are one class; classes are named by their least id, null if all
ids are null; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.shared import stored

from .components import components
from .text import batch, lower_words

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of a lower node.
LEAF = 256
_PART = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; the hashes of shingles are unsigned XXH64 of their UTF-8."""
    some = lower_words(text)
    if not some:
        return 0
    joined = b" ".join(some)
    if len(some) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in some))
        digest = xxhash.xxh64_intdigest
        begins = [0, *ends]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins, ends[shingle - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        some_bits = np.unpackbits(hashes[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(some_bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: the id column as doc_id, and fp (a long with the same 64 bits)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            found = np.array([fingerprint(t, shingle) for t in given.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([given.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(read, f"doc_id {rows.dtypes[0][1]}, fp long")


# -- index ---------------------------------------------------------------------------------------


def masks(distance: int = DISTANCE) -> list[int]:
    """One mask for each pair of ``distance + 2`` segments of the 64 bits."""
    cuts = [64 * i // (distance + 2) for i in range(distance + 3)]
    segments = [((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [a | b for a, b in combinations(segments, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def lower_nodes(distinct: DataFrame, distance: int = DISTANCE, leaf: int = LEAF, on: list[int] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lower nodes of all upper nodes that have two fingerprints: mask, pattern, node, shared, bits, fps.

    ``shared`` has the bits in which all fingerprints of a node agree, ``bits`` their values.  The masks are ``on``, by
    default those that miss no link; ``extra`` columns of longs are packed beside the fingerprints.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("on")) for i, m in enumerate(on or masks(distance)))))
    rows = distinct.select("fp", *extra, each.alias("m")).select(
        F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.on")).alias("pattern"), "fp", gray_rank(F.col("fp")).alias("rank"), *extra
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "mask", "pattern", "rank").sortWithinPartitions("mask", "pattern", "rank")
    ordered = ordered.select("mask", "pattern", "fp", *extra)
    schema = pa.schema(
        [("mask", pa.int32()), ("pattern", pa.int64()), ("node", pa.int64()), ("shared", pa.int64()), ("bits", pa.int64()), ("fps", pa.binary())]
        + [(f"{name}s", pa.binary()) for name in extra]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40
        held, first = None, True

        def nodes(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, *others: np.ndarray, last: bool) -> pa.RecordBatch:
            """Runs of one upper node; lone fingerprints go, except at the partition's ends."""
            nonlocal made, first
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            begins, ends = np.r_[0, new], np.r_[new, len(fp)]
            use = ends - begins > 1
            use[0] |= first
            use[-1] |= last
            first = False
            out: dict[str, list] = {f.name: [] for f in schema}
            for a, b in zip(begins[use].tolist(), ends[use].tolist(), strict=True):
                for i in range(a, b, leaf):
                    some = fp[i : min(i + leaf, b)]
                    every, any_ = np.bitwise_and.reduce(some), np.bitwise_or.reduce(some)
                    packed = (x[i : i + len(some)].tobytes() for x in others)
                    for name, value in zip(schema.names, (mask[a], pattern[a], made, ~(every ^ any_), every, some.tobytes(), *packed), strict=True):
                        out[name].append(value)
                    made += 1
            return batch(schema, **out)

        for given in batches:
            now = [c.to_numpy() for c in given.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])  # the last run may go on
            keep = int(np.argmax(same))
            whole = keep + (len(same) - keep) // leaf * leaf  # but its full lower nodes are done
            if whole > keep and whole == len(same):
                whole -= leaf
            edge = max(keep, whole)
            if edge:
                yield nodes(*(x[:edge] for x in now), last=whole > keep)
                first = first or whole > keep
            held = [x[edge:] for x in now]
        if held is not None and len(held[0]):
            yield nodes(*held, last=True)

    return ordered.mapInArrow(cut, ", ".join(["mask int, pattern long, node long, shared long, bits long, fps binary", *(f"{n}s binary" for n in extra)]))


def node_pairs(nodes: DataFrame, distance: int, columns: list[str]) -> DataFrame:
    """Pairs of lower nodes of one upper node that may hold a link, each pair once; the second one's columns end in _2."""
    names = ["node", "shared", "bits", *columns]
    left = nodes.select("mask", "pattern", *names)
    right = nodes.select("mask", "pattern", *(F.col(n).alias(f"{n}_2") for n in names))
    apart = F.bit_count(
        F.col("bits").bitwiseXOR(F.col("bits_2")).bitwiseAND(F.col("shared")).bitwiseAND(F.col("shared_2"))
    )
    return left.join(right, ["mask", "pattern"]).filter((F.col("node") <= F.col("node_2")) & (apart <= distance))


def _stars(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of unsigned fingerprints, as a star for each component."""
    both = np.unique(np.concatenate([a, b]))
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= distance
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    i, j = np.nonzero(near)
    u, v = at_a[i], at_b[j]
    root = np.arange(len(both))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    leaf = np.flatnonzero(root != np.arange(len(both)))
    return both[leaf], both[root[leaf]]


def links(distinct: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) whose components are those of all links between distinct fingerprints (column fp)."""
    nodes = stored(lower_nodes(distinct, distance, leaf), "simhash-nodes")
    pairs = node_pairs(nodes, distance, ["fps"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            same = given.column(0).to_numpy() == given.column(1).to_numpy()
            twos = []
            for alike, x, y in zip(same.tolist(), given.column(2).to_pylist(), given.column(3).to_pylist(), strict=True):
                if alike and len(x) == 16:
                    twos.append(x)
                elif not alike or len(x) > 8:
                    found.append(_stars(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), distance))
            if twos:
                pair = np.frombuffer(b"".join(twos), np.uint64).reshape(-1, 2)
                pair = pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= distance]
                found.append((pair[:, 0], pair[:, 1]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch(schema, a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)))

    return pairs.select("node", "node_2", "fps", "fps_2").mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and component_id (least doc_id of the class) for each fingerprint of a stored table (doc_id, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, distance))
    rooted = stored(
        distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    named = classes(prints, distance)
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")

