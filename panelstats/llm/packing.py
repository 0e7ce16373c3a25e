"""Best-fit packing by linear grouping.

Pieces of documents are packed into as few sequences of a fixed capacity as the scheme finds:

1. large pieces (over ``capacity / small_share``) are sorted by length and cut into groups of equal
   cardinality; every piece of a group counts as long as the group's longest;
2. configurations over these few sizes are chosen one after the other: each takes the largest size
   that is left and the set of further sizes that fills it best, as often as the groups allow;
3. the actual pieces of a group replace the rounded sizes, longest first;
4. small pieces go, longest first, to the sequence with the least room that suffices.

All of this needs only how many pieces there are of each length: at most ``capacity`` numbers, which is
all that the driver sees.  Pieces of one length are interchangeable, so the plan says which ranks of a
length go to which run of sequences, and every piece finds its place by its length and rank.

Defined results: a null text is empty, an empty document is one piece of its end token; repeated rows are
packed each for itself; an empty table gives an empty result; null ids are kept.  Only id and text columns
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import stored

from .text import batch, raw

CAPACITY = 2048
END_ID = 0
#: Pieces of at most this share of a sequence are small.
SMALL_SHARE = 4
GROUPS = 256
#: Ranks of a length are counted in so many slots; with the capacity this bounds the table of offsets.
SLOTS = 64


# -- tokens --------------------------------------------------------------------------------------


#: Words kept for the next texts, in two generations of this size at most.
KEPT_WORDS = 60_000
#: Settings of tokenizer files whose words can be encoded apart.  The normaliser folds case and white
#: space, and the pre-tokenizer ends a run of letters at everything else.
_NORMALISER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
#: Texts of ASCII and Latin-1 letters, what such a tokenizer makes of them, and a place where it parts other words from
#: marks anyway.
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
_MARKS = re.compile(rb"(?<=[a-z])(?=[.,!%#&$*])")
_encoders: dict[str, WordIds] = {}


def words_apart(settings: dict) -> bool:
    """Whether a tokenizer file allows to put a text's ids together from those of its lower-cased words."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    plain = settings.get("normalizer") == _NORMALISER and steps[0] == _SPLIT
    level = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:]) if plain else False
    return level and not settings.get("truncation") and not settings.get("padding") and not (settings.get("model") or {}).get("dropout")


def word_parts(text: str) -> list[str]:
    """Lower-cased parts of a text that such a tokenizer encodes apart; words beyond Latin-1 stay whole but for marks."""
    if _PLAIN.fullmatch(text):
        return _PARTS.findall(text.lower())
    parts: list[str] = []
    for word in raw(text).lower().split():
        shown = word.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(shown):
            parts += _PARTS.findall(shown.lower())
        else:
            parts += (w.decode("utf-8", "surrogatepass") for w in _MARKS.sub(b" ", word).split())
    return parts


class WordIds:
    """Token ids of texts as little-endian bytes.

    Where the tokenizer ignores the case of A-Z, drops white space and joins no token across it, nor across the end
    of a run of letters (``words_apart``), they are put together from those of the parts of words (runs of letters, digits,
    runs of marks), which are far fewer than words, and parts not met lately are encoded many at a time.  Other tokenizers get whole texts, as do texts that hold an added token's content.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as file:
            settings = json.load(file)
        self.apart = words_apart(settings)
        self.added = [t["content"].lower() for t in settings.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = (settings.get("model") or {}).get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.last = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # ids that end a part
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def shared(cls, tokenizer_path: str) -> WordIds:
        """One per Python worker: its tasks share the tokenizer and the words met lately."""
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = cls(tokenizer_path)
        return _encoders[tokenizer_path]

    def _whole(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, some: list[str], plain: bool) -> None:
        """Remember some parts; of ``plain`` ones each ends with an id that ends a part."""
        found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = None
        if plain and len(self.last):
            cuts = np.r_[0, np.flatnonzero(self.last[ids]) + 1]
        if cuts is None or len(cuts) != len(some) + 1 or cuts[-1] != len(ids):
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            cuts = np.searchsorted(at, np.cumsum([0, *(len(w) + 1 for w in some)]))
        cuts, flat = (4 * cuts).tolist(), ids.tobytes()
        self.known.update(zip(some, (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts; the caller bounds how many it hands over."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        lower = (t.lower() if t else "" for t in texts)
        whole = {i for i, t in enumerate(lower) if any(a in t for a in self.added)}
        split = [[] if i in whole else word_parts(t or "") for i, t in enumerate(texts)]
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        fresh = set().union(*split).difference(self.known)
        again = [w for w in fresh if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        fresh = fresh.difference(again)
        single = {w for w in fresh if _PARTS.fullmatch(w)}
        for plain, words in ((True, list(single)), (False, list(fresh - single))):
            for i in range(0, len(words), 512):
                self._learn(words[i : i + 512], plain)
        return [self._whole(texts[i]) if i in whole else b"".join(map(self.known.__getitem__, w)) for i, w in enumerate(split)]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, and ids on request."""
    fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32")]
    fields.insert(1, pa.field("piece", pa.int32()))
    if with_ids:
        fields.append(pa.field("ids", pa.binary()))
    schema = pa.schema(fields)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = WordIds.shared(tokenizer_path), 4 * capacity
        for rows in batches:
            out = defaultdict(list)
            doc_ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            encoded = (x for i in range(0, len(texts), 256) for x in cache.of(texts[i : i + 256]))
            for doc_id, ids in zip(doc_ids, encoded, strict=True):
                ids += end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(at // width)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(part)
            if out:
                yield batch(schema, **out)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, kinds)


# -- plan ----------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Runs of equal places, sorted by length and first rank; ``sequences`` are used in all."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def _grouped(counts: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """Rounded size -> runs [length, first rank, count], longest first, of equally many pieces a group."""
    total, out = sum(counts.values()), defaultdict(list)
    share, left, size = -(-total // max(groups, 1)), 0, 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while count:
            if not left:
                left, size = share, length
            n = min(left, count)
            out[size].append([length, rank, n])
            rank, count, left = rank + n, count - n, left - n
    return out


def _configuration(sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest size left, and the bounded multiset of sizes that fills the rest best."""
    first = next(s for s in sizes if left[s])
    room = capacity - first
    reached, how = np.zeros(room + 1, bool), []
    reached[0] = True
    for size in sizes:
        usable = min(left[size] - (size == first), room // size)
        for _ in range(usable):
            new = reached.copy()
            new[size:] |= reached[: room + 1 - size]
            if (new == reached).all():
                break
            how.append((size, reached))
            reached = new
        if reached[room]:
            break
    fill, chosen = int(np.flatnonzero(reached)[-1]), defaultdict(int)
    chosen[first] += 1
    for size, before in reversed(how):
        if not before[fill]:
            chosen[size] += 1
            fill -= size
    return chosen


def plan_packing(
    counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE
) -> Plan:
    """Places for ``counts[length]`` pieces of each length, full-length pieces left out."""
    counts = {n: c for n, c in counts.items() if c and n < capacity}
    small = {n: c for n, c in counts.items() if n <= capacity // small_share}
    runs = _grouped({n: c for n, c in counts.items() if n not in small}, groups)
    entries: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = defaultdict(list)
    order: list[int] = []
    used = 0

    def open_run(room: int, first: int, count: int) -> None:
        if room not in rooms:
            bisect.insort(order, room)
        rooms[room].append([first, count])

    sizes = sorted(runs, reverse=True)
    left = {s: sum(n for _, _, n in runs[s]) for s in sizes}
    while any(left.values()):
        config = _configuration(sizes, left, capacity)
        times = min(left[s] // n for s, n in config.items())
        slots = [s for s, n in config.items() for _ in range(n)]
        taken = []
        for s in slots:  # the next ranks of the group, cut where the length changes
            need, mine = times, []
            while need:
                run = runs[s][0]
                n = min(run[2], need)
                mine.append((run[0], run[1], n))
                run[1], run[2], need = run[1] + n, run[2] - n, need - n
                if not run[2]:
                    runs[s].pop(0)
            taken.append(mine)
            left[s] -= times
        cuts = sorted({0, *(int(c) for mine in taken for c in np.cumsum([n for _, _, n in mine]))})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            offset = 0
            for mine in taken:
                at = 0
                for length, rank, n in mine:
                    if at <= a < at + n:
                        entries.append((length, rank + a - at, used + a, offset))
                        offset += length
                        break
                    at += n
            open_run(capacity - offset, used + a, b - a)
        used += times

    for length in sorted(small, reverse=True):
        rank, count = 0, small[length]
        while count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                fresh = -(-count // each)
                open_run(capacity, used, fresh)
                used += fresh
                continue
            room = order[at]
            run = rooms[room][-1]
            n = min(run[1], count)
            first = run[0]
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            entries.append((length, rank, first, capacity - room))
            if room > length:
                open_run(room - length, first, n)
            rank, count = rank + n, count - n
    table = np.array(sorted(entries), np.int64).reshape(-1, 4)
    return Plan(*table.T, sequences=used)


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Places of stored pieces: their columns with sequence_id and offset.

    ``cut`` must be a stored table (see ``stored``), since it is read three times.  Ranks of one length are
    counted in slots, so a length that most pieces have is ranked by many tasks; pieces that fill a
    sequence need no rank.
    """
    sc = cut.sparkSession.sparkContext
    part = cut.filter(F.col("length") < capacity).withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLOTS)).cast("int")
    )
    counted = stored(part.groupBy("length", "slot").agg(F.count("*").alias("n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = plan_packing({r["length"]: r["n"] for r in lengths}, capacity, groups)
    shared = sc.broadcast(plan)

    within = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        part.join(F.broadcast(base), ["length", "slot"])  # at most capacity x SLOTS rows
        .withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
        .select(*cut.columns, "rank")
    )

    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p.length << 40 | p.rank
        for rows in batches:
            length, rank = (rows.column(rows.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            columns = [rows.column(i) for i, n in enumerate(rows.schema.names) if n != "rank"]
            columns += [pa.array(p.sequence[at] + rank - p.rank[at]), pa.array(p.offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    full = cut.filter(F.col("length") == capacity).select(
        *cut.columns,
        (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(full)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    cut = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "packing-pieces")
    return pack(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, for pieces packed ``with_ids``; a group holds one sequence."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(
        F.aggregate(inside, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.sum("length").alias("n_tokens"),
    )
