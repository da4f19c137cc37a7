"""Long exact spans shared between documents, by difference-cover anchors.

A perfect difference set D modulo v has, for any two positions i and j, one shift d < v
with (i+d) mod v and (j+d) mod v both in D. So any two equal spans of v-1+w code points
hold an equal window of w code points that starts at a cover position in both documents:
hashing windows at cover positions alone (|D|/v of all) finds every such pair.

Stages, each a shuffle of packed hashes and never of all pairs:

1. anchors: every document's window hashes at cover positions, packed by hash bucket;
   a bucket keeps the (document, hash) entries whose hash stands in two documents. What a
   task sees in two documents it knows to be shared: of such a hash it sends two entries
   to the hash's bucket and deals the others by document, so that a passage of very many
   documents has no more entries in its bucket than there are tasks, twice.
2. extension: the few documents with a shared anchor meet their text again; every window
   of the wanted length that holds a shared anchor is hashed (96 bits).
3. windows of the wanted length that stand in two documents are grouped by the *set* of
   documents that has them; one window stands for all with the same set, so a passage of
   a thousand windows yields its pairs once.
4. pairs of a set are made in blocks of PAIR_BLOCK members, so that no task holds a large
   set; the number of rows is that of the result.

Null and short texts share nothing. Duplicate rows of one doc_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from docveil.llm.codepoints import flat, groups, ragged
from docveil.llm.window_hash import WindowHash, mixed
from docveil.plans.lineage import checkpointed

#: Perfect difference sets (order q, modulus q*q+q+1) that start 0, 1, 3.
COVERS = {
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    91: [0, 1, 3, 9, 27, 49, 56, 61, 77, 81],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
}
#: Bits of a hash below its bucket, and bytes of them; bytes of a second hash.
BITS, FIRST, SECOND = 40, 5, 7
LOW = np.uint64((1 << BITS) - 1)
CHUNK = 1 << 20
#: Entries that a task packs at once, and bytes that a bucket is to hold; the number of buckets follows from what was counted.
FLUSH, BUCKET = 1 << 21, 16 << 20
PAIR_BLOCK = 512
PACKED = pa.schema([("b", pa.int32()), ("base", pa.int64()), ("doc_bytes", pa.int8()), ("hashes", pa.binary()), ("docs", pa.binary())])
PACKED_DDL = "b int, base long, doc_bytes byte, hashes binary, docs binary"


def cover_for(min_chars: int) -> tuple[int, int, list[int]]:
    """Period, window width and positions of the sparsest cover whose window stays above half the span."""
    for period in sorted(COVERS, reverse=True):
        width = min_chars - period + 1
        if width * 2 >= min_chars:
            return period, width, COVERS[period]
    return 1, min_chars, [0]


def anchors(offsets: np.ndarray, hashed: WindowHash, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start (in the flat array) of every anchor window."""
    period, width, cover = cover_for(min_chars)
    length = np.diff(offsets)
    room = np.where(length >= min_chars, length - width + 1, 0)
    whole, rest = np.divmod(room, period)
    count = whole * len(cover) + np.searchsorted(np.array(cover), rest, "left")
    k = ragged(count)
    row = np.repeat(np.arange(len(length)), count)
    laps, place = np.divmod(k, len(cover))
    return row, offsets[:-1][row] + laps * period + np.array(cover)[place]


def key_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper 24 bits, 40 other bits of the hash below."""
    b = ((h >> np.uint64(BITS)) * np.uint64(buckets)) >> np.uint64(64 - BITS)
    return (b << np.uint64(BITS)) | (h & LOW)


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n]


def packed(keys: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None, dealt: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for each bucket: FIRST bytes a hash (SECOND others with `more`), and the doc_id's distance from the least in 2, 4 or 8 bytes.

    `dealt` names the bucket of each entry where that isn't the hash's own.
    """
    if not len(keys):
        return
    b = (keys >> np.uint64(BITS)).astype(np.int32) if dealt is None else dealt.astype(np.int32)
    order = np.argsort(keys if dealt is None else b, kind="stable")
    keys, docs, b = keys[order], docs[order], b[order]
    base = int(docs.min())
    span = int(docs.max()) - base
    width = 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    low = low_bytes(keys, FIRST if dealt is None else 8)
    if more is not None:
        low = np.concatenate([low, low_bytes(more[order], SECOND)], 1)
    near = (docs.astype(np.uint64) - np.uint64(base & (2**64 - 1))).astype(f"<u{width}")
    cut, n = runs(b)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(b[cut], pa.int32()),
            pa.array(np.full(len(cut), base), pa.int64()),
            pa.array(np.full(len(cut), width), pa.int8()),
            pa.array([low[i : i + m].tobytes() for i, m in zip(cut, n)], pa.binary()),
            pa.array([near[i : i + m].tobytes() for i, m in zip(cut, n)], pa.binary()),
        ],
        schema=PACKED,
    )


def words(raw: bytes, size: int, first: int, n: int) -> np.ndarray:
    """Bytes first..first+n of every `size` bytes, as 64-bit numbers."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, size)
    k = np.zeros((len(low), 8), np.uint8)
    k[:, :n] = low[:, first : first + n]
    return k.view("<u8").ravel()


def doc_ids(row: dict) -> np.ndarray:
    near = np.frombuffer(row["docs"], f"<u{row['doc_bytes']}").astype(np.uint64)
    return (near + np.uint64(row["base"] & (2**64 - 1))).view(np.int64)


def unpacked(rows: list[dict], second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's distinct entries the key, the group number and the doc_id, sorted by key, then doc_id."""
    size = FIRST + SECOND * second
    k = np.concatenate([words(r["hashes"], size, 0, FIRST) | (np.uint64(r["b"]) << np.uint64(BITS)) for r in rows])
    d = np.concatenate([doc_ids(r) for r in rows])
    m = np.concatenate([words(r["hashes"], size, FIRST, SECOND) for r in rows]) if second else None
    order = np.lexsort((d, m, k) if second else (d, k))
    k, d = k[order], d[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    if second:
        m = m[order]
        fresh[1:] |= m[1:] != m[:-1]
    new = fresh.copy()
    new[1:] |= d[1:] != d[:-1]
    return k[new], (np.cumsum(fresh) - 1)[new], d[new]


def by_bucket(batches, second: bool = False, passed: int | None = None):
    """Whole buckets out of batches sorted by b; rows of a bucket from `passed` on come as they are."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if passed is not None and r["b"] >= passed:
                k, d = words(r["hashes"], 8, 0, 8), doc_ids(r)
                yield k, None, d
                continue
            if held and held[0]["b"] != r["b"]:
                yield unpacked(held, second)
                held = []
            held.append(r)
    if held:
        yield unpacked(held, second)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return cut, np.diff(np.append(cut, len(keys)))


def buckets_for(df: DataFrame, entries: int, size: int) -> int:
    """So many that a bucket of `entries` in all, of so many bytes each, holds about BUCKET bytes; enough for all partitions."""
    return int(min(1 << 23, max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries * size // BUCKET))))


def by_bucket_number(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by bucket over the session's partitions, or more where these would hold more than four buckets each."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 4))
    return rows.repartition(n, "b").sortWithinPartitions("b")


def _texts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_chars)
    )


def shared_anchors(texts: DataFrame, min_chars: int, buckets: int) -> DataFrame:
    """(doc_id, keys): the anchor keys of a document that also stand in another one."""

    def pack(batches):
        hot = np.zeros(0, np.uint64)  # shared keys that this task has sent to their bucket

        def flush(keys: np.ndarray, docs: np.ndarray):
            nonlocal hot
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[new], docs[new]
            cut, n = runs(keys)
            sent = np.isin(keys[cut], hot)
            several = (n > 1) & ~sent
            known = np.repeat(several | sent, n)
            # the first two entries of a key that is new to this task go to its bucket as others do
            ordinary = ~known
            ordinary[np.concatenate([cut[several], cut[several] + 1])] = True
            hot = np.union1d(hot, keys[cut[several]])
            yield from packed(keys[ordinary], docs[ordinary])
            rest = known & ~ordinary
            yield from packed(keys[rest], docs[rest], dealt=buckets + (mixed(docs[rest].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))

        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cp, offsets = flat(batch.column(1))
            for i, j in groups(offsets, CHUNK):
                own = offsets[i : j + 1] - offsets[i]
                hashed = WindowHash(cp[offsets[i] : offsets[j]])
                row, at = anchors(own, hashed, min_chars)
                held.append((key_of(hashed.at(at, cover_for(min_chars)[1]), buckets), ids[i:j][row]))
                size += len(at)
                if size >= FLUSH:
                    yield from flush(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from flush(*map(np.concatenate, zip(*held)))

    def keep(batches):
        for k, g, d in by_bucket(batches, passed=buckets):
            if g is not None:
                cut, n = runs(g)
                many = np.repeat(n > 1, n)
                k, d = k[many], d[many]
            if len(k):
                order = np.argsort(d, kind="stable")
                k, d = k[order], d[order]
                cut, n = runs(d)
                yield pa.RecordBatch.from_arrays([pa.array(d[cut], pa.int64()), pa.array([k[c : c + m].tobytes() for c, m in zip(cut, n)], pa.binary())], names=["doc_id", "keys"])

    return by_bucket_number(texts.mapInArrow(pack, PACKED_DDL), buckets).mapInArrow(keep, "doc_id long, keys binary")


def _candidates(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, int, int]:
    """(doc_id, keys, text) of documents with a shared anchor, the number of buckets of anchors, and that of the windows to come."""
    texts = _texts(docs, id_col, text_col, min_chars)
    period, _, cover = cover_for(min_chars)
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = buckets_for(texts, chars * len(cover) // period, FIRST + 4)
    found = checkpointed(shared_anchors(texts, min_chars, buckets))
    shared = found.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    windows = buckets_for(texts, shared // 8 * period // len(cover), FIRST + SECOND + 4)
    own = found.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    return own.join(texts, "doc_id").select("doc_id", "keys", "text"), buckets, windows


def _windows(batch, min_chars: int, buckets: int):
    """Of each chunk of candidates: row, start in the text, flat start and hash of every window that holds a shared anchor."""
    width = cover_for(min_chars)[1]
    reach = min_chars - width
    cp, offsets = flat(batch.column(2))
    shared = batch.column(1)
    for i, j in groups(offsets, CHUNK):
        own = offsets[i : j + 1] - offsets[i]
        part = cp[offsets[i] : offsets[j]]
        hashed = WindowHash(part)
        row, at = anchors(own, hashed, min_chars)
        if not len(at):
            continue
        known = [np.frombuffer(b"".join(x), "<u8") for x in shared.slice(i, j - i).to_pylist()]
        lists = np.concatenate([mixed(k ^ mixed(np.full(len(k), r, np.uint64))) for r, k in enumerate(known)])
        mine = key_of(hashed.at(at, width), buckets)
        hit = np.isin(mixed(mine ^ mixed(row.astype(np.uint64))), lists)
        row, at = row[hit], at[hit]
        first = np.maximum(at - reach, own[:-1][row])
        last = np.minimum(at, own[1:][row] - min_chars)
        flag = np.zeros(len(part) + 1, np.int32)
        good = last >= first
        np.add.at(flag, first[good], 1)
        np.add.at(flag, last[good] + 1, -1)
        starts = np.flatnonzero(np.cumsum(flag[:-1]) > 0)
        if len(starts):
            where = np.searchsorted(own, starts, "right") - 1
            yield i + where, starts - own[:-1][where], part, hashed, starts


def shared_sets(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(s1, s2, doc_id): members of each distinct set of documents that shares a window of min_chars."""
    cand, buckets, more = _candidates(docs, id_col, text_col, min_chars)

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, part, hashed, starts in _windows(batch, min_chars, buckets):
                yield from packed(key_of(hashed.at(starts, min_chars), more), ids[row], WindowHash(part, 1).at(starts, min_chars))

    def sets(batches):
        for _, g, d in by_bucket(batches, second=True):
            cut, n = runs(g)
            many = np.repeat(n > 1, n)
            g, d = g[many], d[many]
            if not len(g):
                continue
            cut, n = runs(g)
            one, two = mixed(d.view(np.uint64) + np.uint64(1)), mixed(d.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            s1, s2 = np.add.reduceat(one, cut), np.add.reduceat(two, cut)
            _, first = np.unique(np.stack([s1, s2], 1), axis=0, return_index=True)
            at = np.repeat(cut[first], n[first]) + ragged(n[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(s1[first], n[first]).view(np.int64)), pa.array(np.repeat(s2[first], n[first]).view(np.int64)), pa.array(d[at])], names=["s1", "s2", "doc_id"]
            )

    rows = by_bucket_number(cand.mapInArrow(pack, PACKED_DDL), more)
    return rows.mapInArrow(sets, "s1 long, s2 long, doc_id long").dropDuplicates(["s1", "s2", "doc_id"])


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: documents that share a span of min_chars code points or more.

    Two windows count as equal when 96 bits of two independent hashes and their bucket agree.
    """
    members = shared_sets(docs, id_col, text_col, min_chars)
    size = members.groupBy("s1", "s2").agg(F.count("*").alias("n"))
    # members of a set are dealt into blocks by their hash; block x meets every block y >= x
    blocked = members.join(size, ["s1", "s2"]).withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int")).withColumn("x", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = blocked.select("s1", "s2", F.col("doc_id").alias("l"), "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    left = left.select("s1", "s2", "l", F.least("x", "y").alias("cx"), F.greatest("x", "y").alias("cy"), "x")
    right = left.withColumnRenamed("l", "r").withColumnRenamed("x", "rx")
    pairs = left.join(right, ["s1", "s2", "cx", "cy"]).where((F.col("l") < F.col("r")) & ((F.col("cx") == F.col("cy")) | (F.col("x") != F.col("rx"))))
    return pairs.select(F.col("l").alias("doc_id_a"), F.col("r").alias("doc_id_b")).distinct()


def shared_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """(representative, class_id, doc_id, n_members): one row for each member of each distinct set of documents that share a span.

    The representative is the least doc_id of the set. All pairs of a set's members share a
    span, so that this tells what shared_pairs() tells, in as many rows as there are
    members.
    """
    members = shared_sets(docs, id_col, text_col, min_chars)
    sets = members.groupBy("s1", "s2").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n_members"))
    class_id = F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0")).alias("class_id")
    return members.join(sets, ["s1", "s2"]).select("representative", class_id, "doc_id", "n_members")


def shared_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """(doc_id, start_pos, end_pos): the stretches of a document of which every window of min_chars stands in another one too.

    Overlapping windows are one stretch. A window's documents are only counted (least and
    greatest doc_id), so a window of very many documents needs no large group anywhere.
    """
    cand, buckets, _ = _candidates(docs, id_col, text_col, min_chars)

    def hashes(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, start, part, hashed, starts in _windows(batch, min_chars, buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.at(starts, min_chars).view(np.int64)), pa.array(WindowHash(part, 1).at(starts, min_chars).view(np.int64)), pa.array(ids[row]), pa.array(start.astype(np.int32))],
                    names=["k1", "k2", "doc_id", "start"],
                )

    rows = cand.mapInArrow(hashes, "k1 long, k2 long, doc_id long, start int")
    several = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("k1", "k2")
    own = W.partitionBy("doc_id").orderBy("start")
    marked = rows.join(several, ["k1", "k2"], "left_semi").select("doc_id", "start").distinct()
    marked = marked.withColumn("new", F.coalesce((F.col("start") - F.lag("start").over(own) > min_chars).cast("int"), F.lit(1)))
    marked = marked.withColumn("stretch", F.sum("new").over(own))
    return marked.groupBy("doc_id", "stretch").agg(F.min("start").alias("start_pos"), (F.max("start") + min_chars).cast("int").alias("end_pos")).drop("stretch")


def shared_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """One row a document: doc_id, n_chars, shared_chars, n_ranges and shared_part (0 for null and empty texts)."""
    ranges = shared_ranges(docs, id_col, text_col, min_chars)
    sums = ranges.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"), F.count("*").alias("n_ranges"))
    every = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.char_length(text_col)), F.lit(0)).cast("long").alias("n_chars"))
    out = every.join(sums, "doc_id", "left").fillna(0, ["shared_chars", "n_ranges"])
    return out.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
