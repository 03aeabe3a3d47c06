"""Operator 6: exact Jaccard similarity join of word-shingle sets by PartEnum signatures.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct 5-word shingles as 64-bit hashes (fewer words: the
whole sequence as one). Two sets link when 100 * intersection >= 75 * union. Equal sets are one class and travel once.

Signatures. Size bands have the ratio 3 : 4, so partners lie in the same or the next band; a set signs for its own band and, as the larger
partner, for the band below. In a band up to ``hi`` shingles, linked sets differ in at most k = hi / 3 of them. The domain is cut into
n > k partitions by hash (n is 45 % of hi); linked sets agree on at least n - k of them. A partition's signature is the hash of the
set's shingles in it; PartEnum's second level is one partition here (larger ones were more signatures for the same sets). Empty
partitions are not signed: a set with fewer than n - k of them shares a signature with every partner. A set with more of them
(a "sparse" one) also signs its rarest 25 % shingles one by one, and two linked sparse sets share one of these (prefix filter).
Shingles that many documents share form a partition of their own, which is not signed either; which shingles these are
changes the speed and not the result, so they may be the ``common_most`` most frequent ones only.

Reduction. Signatures go to buckets as packed blocks of 5 bytes each and are sorted there; sets that share one become a list.
Lists that are equal are kept once. A list links through stars: its members are verified against a pivot, the member that meets
most others (an original rather than one of its copies, so that all lists of a group have one pivot); the pivot leaves the list, components are
updated, and only lists with members of different components go on, with the next pivot; after ``star_rounds`` the remaining pairs of
different components are verified all. So a group of a thousand near copies costs a few thousand verifications, and no link that could
join two components is left out. Candidates whose parity sketches already differ in
more bits than linked sets can differ in shingles are dropped (a bound, not an estimate). Every other candidate is verified on whole sets. Components are found by alternating stars.

Rows: one per input row. Null or empty text, or text without words: no shingles, component_id is the row's own doc_id. Repeated rows are equal
sets. A null doc_id is above every other when the smallest is sought. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, tokens
from .wordhash import Words, ascii_fold, byte_table, mix, window_hashes

_WORD = byte_table(bytes(x for x in range(256) if x != 0x20 and not 0x09 <= x <= 0x0D))
SHINGLE = 5
#: Members of a list that may be broadcast as (8-byte) ids to fetch their texts; above it the fetch is a shuffled join.
BROADCAST_IDS = 500_000
#: Pairs, and pivots, that may be broadcast (two fingerprints each, or a fingerprint and a sketch); above it the join is shuffled.
BROADCAST_PAIRS, BROADCAST_PIVOTS = 300_000, 50_000
#: Characters of texts that are turned to shingles at once.
CHARS = 2_000_000
#: Signatures of one bucket, about: sizes what one task sorts.
BUCKET_SIGNATURES = 1_500_000
_U = np.uint64


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct shingles of text k are hashes[first[k]:first[k + 1]]."""
    words = Words(texts, _WORD, ascii_fold)
    first, counts = words.first, np.diff(words.first)
    got = window_hashes(words.hashes, size)
    owner = np.searchsorted(first, np.arange(len(got)), "right") - 1
    whole = np.arange(len(got)) + size <= first[owner + 1]
    keys, owners = [got[whole]], [owner[whole]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            keys.append(mix(window_hashes(words.hashes, n)[first[short]] + _U(n)))
            owners.append(short)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits per set, as rows of two uint64."""
    n = np.diff(first).astype(np.uint64)
    return np.stack([mix(_sums(mix(hashes ^ _U(0xA5A5)), first) + n), mix(_sums(mix(hashes ^ _U(0x5A5A5A5A)), first) ^ n)], axis=1)


def band_of(size: np.ndarray) -> np.ndarray:
    """Number of the band that holds a size: bands are (hi * 3 / 4, hi]."""
    return np.searchsorted(_HI, size)


def _bands() -> np.ndarray:
    hi, out = 1, []
    while hi < 1 << 40:
        out.append(hi)
        hi = (hi + 1) * 4 // 3
    return np.array(out, np.int64)


_HI = _bands()
_PARTS = np.maximum(_HI // 3 + 1, (_HI * 9 + 19) // 20)
_SLACK = _PARTS - _HI // 3 - 1


def signatures(hashes: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of all sets; ``frequent``: sorted common shingles."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.searchsorted(frequent, hashes)
    often = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == hashes) if len(frequent) else np.zeros(len(hashes), bool)
    rare, rare_owner = hashes[~often], owner[~often]
    value = mix(rare ^ _U(0x0123456789ABCDEF))
    own = band_of(np.maximum(size, 1))
    sigs, sets, sparse = [], [], np.zeros(len(size), bool)
    for role in (own, own - 1):
        use = (size > 0) & (role >= 0)
        if role is not own:
            use &= (3 * size + 3) // 4 <= _HI[np.maximum(role, 0)]
        band = np.maximum(role, 0)
        keep = use[rare_owner]
        o = rare_owner[keep]
        part = (mix(rare[keep] + _U(0x51ED270B) * (band[o].astype(np.uint64) + _U(1))) >> _U(20)).astype(np.int64) % _PARTS[band[o]]
        key = (o.astype(np.int64) << 40) + part
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(begin):
            projected = np.add.reduceat(value[keep][order], begin)
            head = key[begin]
            o, part = head >> 40, head & ((1 << 40) - 1)
            sigs.append(mix(projected + mix((part.astype(np.uint64) << _U(8)) + band[o].astype(np.uint64))))
            sets.append(o)
            signed = np.bincount(o, minlength=len(size))
        else:
            signed = np.zeros(len(size), np.int64)
        sparse |= use & (_PARTS[band] - signed > _SLACK[band])
    if sparse.any():
        pick = sparse[owner]
        o, h = owner[pick], hashes[pick]
        order = np.lexsort((h, often[pick], o))
        o, h = o[order], h[order]
        rank = np.arange(len(o)) - np.searchsorted(o, o)
        prefix = rank < size[o] - (3 * size[o] + 3) // 4 + 1
        sigs.append(mix(h[prefix] ^ _U(0xFEEDFACECAFEBEEF)))
        sets.append(o[prefix])
    return (np.concatenate(sigs), np.concatenate(sets)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _summary(docs: DataFrame, least_in_task: int, held_shingles: int) -> DataFrame:
    """Rows (doc_id, n, fp) per document and (shingle, docs) per shingle that a task meets often."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "fp": pa.binary(), "shingle": pa.int64(), "docs": pa.int64()}
        make = lambda size, **cols: pa.RecordBatch.from_arrays([cols.get(k, pa.nulls(size, t)) for k, t in kinds.items()], list(kinds))
        held, n_held = [], 0

        def often():
            shingle, docs_with = np.unique(np.concatenate(held), return_counts=True)
            pick = docs_with >= least_in_task
            return make(int(pick.sum()), shingle=pa.array(shingle[pick].view(np.int64)), docs=pa.array(docs_with[pick]))

        for ids, texts in tokens.gathered(batches, CHARS):
            hashes, first = shingle_sets(texts)
            fp = fingerprints(hashes, first)
            yield make(len(ids), doc_id=pa.array(ids, pa.int64()), n=pa.array(np.diff(first)), fp=pa.array([x.tobytes() for x in fp], pa.binary()))
            distinct = np.unique(fp, axis=0, return_index=True)[1]
            pick = np.zeros(len(fp), bool)
            pick[distinct] = True
            held.append(hashes[np.repeat(pick, np.diff(first))])
            n_held += len(held[-1])
            if n_held >= held_shingles:
                yield often()
                held, n_held = [], 0
        if n_held:
            yield often()

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n long, fp binary, shingle long, docs long")


#: Bytes of a signature and of a set's name within a bucket. The bucket number is part of the signature; a name that two sets share
#: makes both of them members, and the chance that it hides a link is 2^-48.
_SIG, _NAME = 5, 6


def _low_bytes(values: np.ndarray, n: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low_bytes(data: bytes, at: int, count: int, n: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :n] = np.frombuffer(data, np.uint8, count * n, at).reshape(-1, n)
    return wide.view("<u8").ravel()


def name_of(fp: np.ndarray) -> np.ndarray:
    return fp[:, 0] & _U((1 << 8 * _NAME) - 1)


def class_name(fp):
    """name_of as a column expression: the first _NAME bytes of a fingerprint, little-endian."""
    byte = lambda k: F.conv(F.hex(F.substring(fp, k + 1, 1)), 16, 10).cast("long")
    return sum((byte(k) * (1 << 8 * k) for k in range(1, _NAME)), byte(0))


def _blocks(docs: DataFrame, frequent, n_buckets: int, held_shingles: int) -> DataFrame:
    """(bucket, block): packed signatures. A block is sets (uint32), the name of each, its signatures there less one (uint8), then the signatures."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[bytes] = set()
        common_ones = frequent.value

        def packed(hashes, first, fp):
            sig, owner = signatures(hashes, first, common_ones)
            if not len(sig):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "block"])
            bucket = (sig % _U(n_buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            sig, owner, bucket = (sig >> _U(64 - 8 * _SIG))[order], owner[order], bucket[order]
            # entries (bucket, set); one with more than 256 signatures counts as several
            same = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (owner[1:] == owner[:-1])])
            begin = np.flatnonzero(~same)
            place = np.arange(len(sig)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(sig)]])))
            begin = np.flatnonzero(place % 256 == 0)
            counts = np.diff(np.concatenate([begin, [len(sig)]]))
            edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
            entry_edges = np.searchsorted(begin, edges)
            names = name_of(fp)[owner[begin]]
            filled = np.flatnonzero(np.diff(edges))
            out = []
            for k in filled:
                i, j = entry_edges[k], entry_edges[k + 1]
                out.append(b"".join([np.uint32(j - i).tobytes(), _low_bytes(names[i:j], _NAME), (counts[i:j] - 1).astype(np.uint8).tobytes(), _low_bytes(sig[edges[k]:edges[k + 1]], _SIG)]))
            return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "block"])

        for _, texts in tokens.gathered(batches, held_shingles * 3):
            hashes, first = shingle_sets(texts)
            fp = fingerprints(hashes, first)
            fresh = []
            for k, row in enumerate(fp):
                if first[k + 1] > first[k] and (name := row.tobytes()) not in seen:
                    seen.add(name)
                    fresh.append(k)
            if len(seen) > 200_000:
                seen.clear()
            if fresh:
                sizes = np.diff(first)[fresh]
                pick = np.zeros(len(fp), bool)
                pick[fresh] = True
                yield packed(hashes[np.repeat(pick, np.diff(first))], np.concatenate([[0], np.cumsum(sizes)]), fp[fresh])

    return common.map_arrow(docs.selectExpr("doc_id", "text"), run, "bucket int, block binary")


def _unpack(blocks) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, names) of all entries of some blocks."""
    sigs, names = [], []
    for data in blocks:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        counts = np.frombuffer(data, np.uint8, n, 4 + _NAME * n).astype(np.int64) + 1
        sigs.append(_from_low_bytes(data, 4 + (_NAME + 1) * n, int(counts.sum()), _SIG))
        names.append(np.repeat(_from_low_bytes(data, 4, n, _NAME), counts))
    return np.concatenate(sigs), np.concatenate(names)


def _lists(blocks: DataFrame) -> DataFrame:
    """(lid, members): distinct sets of names that share a signature, two or more."""

    def run(table):
        import pyarrow as pa

        sig, name = _unpack(x.as_buffer().to_pybytes() for x in table.column("block"))
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = np.concatenate([[False], sig[1:] == sig[:-1]])
        shared = same | np.concatenate([same[1:], [False]])
        sig, name = sig[shared], name[order[shared]]
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        if len(sig):
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])
            sig, name = sig[new], name[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        ends = np.concatenate([begin[1:], [len(sig)]]) if len(begin) else begin
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(name ^ _U(0x5EED)), dtype=np.uint64)])
        lid = mix(total[ends] - total[begin])
        pick = np.flatnonzero(ends - begin > 1)
        pick = pick[np.unique(lid[pick], return_index=True)[1]]
        sizes = (ends - begin)[pick]
        flat = np.concatenate([name[begin[k]:ends[k]] for k in pick]) if len(pick) else np.zeros(0, np.uint64)
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))
        common.tidy()
        return pa.table({"lid": pa.array(lid[pick].view(np.int64)), "members": members})

    return blocks.groupBy("bucket").applyInArrow(run, "lid long, members array<long>").dropDuplicates(["lid"])


#: 64-bit words of a parity sketch.
SKETCH = 16


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per set, for each of 64 * SKETCH cells the parity of its shingles there. Two sets differ in at least as many shingles as their sketches differ in bits."""
    n, bits = len(first) - 1, 64 * SKETCH
    cell = (mix(hashes ^ _U(0xC0FFEE)) % _U(bits)).astype(np.int64) + np.repeat(np.arange(n), np.diff(first)) * bits
    parity = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8").reshape(n, SKETCH)


def may_link(a: str, n: str, b: str, m: str):
    """Linked sets of n and m shingles differ in (n + m) / 7 of them at most, and their sizes in the ratio 3 : 4."""
    apart = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH)), F.lit(0))
    return (F.least(n, m) * 4 >= F.greatest(n, m) * 3) & (apart * 7 <= F.col(n) + F.col(m))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, n, sketch, text) of the wanted (fp, low) fingerprints, from the document of that id each."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = wanted.select(F.coalesce("low", F.lit(-(1 << 63))).alias("key")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(key.alias("key"), "text").join(F.broadcast(ids) if few else ids, "key", "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, texts in tokens.gathered(batches, CHARS):
            hashes, first = shingle_sets(texts)
            fp, sketch = fingerprints(hashes, first), sketches(hashes, first)
            cols = [pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(np.diff(first)), pa.array(sketch.tolist(), pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["fp", "n", "sketch", "text"])

    return common.map_arrow(texts, run, "fp binary, n long, sketch array<long>, text string")


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hint(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _sketched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the (u, v) pairs whose sketches and sizes may link. v is the pivot: few of them stand in most pairs."""
    of = lambda x: texts.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pivots = pairs.select("v").distinct()
    few = pivots.limit(BROADCAST_PIVOTS + 1).count() <= BROADCAST_PIVOTS
    pivot = of("v").join(_hint(pivots, few), "v", "left_semi")
    return pairs.join(_hint(pivot, few), "v").join(of("u"), "u").where(may_link("su", "nu", "sv", "nv")).select("u", "v")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (u, v) that link, by the whole sets of their texts. Only texts of pairs travel."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            u, v, left, right = (batch.column(k).to_pylist() for k in range(4))
            for a, b in tokens.slices([len(x) + len(y) for x, y in zip(left, right, strict=True)], CHARS):
                by_name = dict(zip(u[a:b], left[a:b], strict=True)) | dict(zip(v[a:b], right[a:b], strict=True))
                place = {name: k for k, name in enumerate(by_name)}
                hashes, first = shingle_sets(list(by_name.values()))
                of = lambda name: hashes[first[place[name]]:first[place[name] + 1]]  # noqa: B023, E731
                good = [linked(of(x), of(y)) for x, y in zip(u[a:b], v[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(u[a:b], pa.binary()), pa.array(v[a:b], pa.binary())], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    left = texts.select(F.col("fp").alias("u"), F.col("text").alias("left")).join(_hint(pairs, few), "u")
    right = texts.select(F.col("fp").alias("v"), F.col("text").alias("right")).join(_hint(pairs.select("v").distinct(), few), "v", "left_semi")
    return common.map_arrow(left.join(right, "v").select("u", "v", "left", "right"), run, "u binary, v binary")


#: Members of an open list that meet in one task at most, squared.
CELL = 1000


def _open_pairs(still_open: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of different components within a list that may link. A long list is dealt over cells of CELL members each way, so that no task meets all of it."""
    sketch = texts.select("fp", "sketch")
    parts = F.ceil(F.col("m") / CELL).cast("int")
    sized = still_open.join(still_open.groupBy("lid").agg(F.count(F.lit(1)).alias("m")), "lid").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    full = sized.join(sketch, "fp").select("lid", "fp", "comp", "n", "sketch", "part", F.sequence(F.lit(0), F.col("parts") - 1).alias("other"))
    one = full.select("lid", F.col("fp").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("sketch").alias("su"), F.col("part").alias("a"), F.explode("other").alias("b"))
    other = full.select("lid", F.col("fp").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("sketch").alias("sv"), F.col("part").alias("b"), F.explode("other").alias("a"))
    return one.join(other, ["lid", "a", "b"]).where(F.expr("u < v and cu <> cv") & may_link("su", "nu", "sv", "nv")).select("u", "v").distinct()


def jaccard_components(docs: DataFrame, *, common_docs: int = 64, common_most: int = 500_000, least_in_task: int = 3, star_rounds: int = 2, held_shingles: int = 1_000_000, n_buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size of every row."""
    spark = docs.sparkSession
    summary = common.materialize(_summary(docs, least_in_task, 4 * held_shingles), "shingles")
    rows = summary.where("fp is not null").select("doc_id", "n", "fp")
    often = summary.where("shingle is not null").groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= common_docs)
    top = [r.shingle for r in often.orderBy(F.desc("docs"), "shingle").limit(common_most).select("shingle").collect()]  # speed only; at most 8 bytes x common_most
    frequent = spark.sparkContext.broadcast(np.sort(np.array(top, np.int64).view(np.uint64)))

    classes = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.count(F.lit(1)).alias("class_size")).withColumn("name", class_name(F.col("fp")))
    if n_buckets is None:
        shingles = rows.agg(F.sum("n")).first()[0] or 0
        n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SIGNATURES))
    lists = common.materialize(_lists(_blocks(docs, frequent, n_buckets, held_shingles)), "lists")
    common.release(spark)
    frequent.unpersist()
    members = lists.select("lid", F.size("members").alias("m"), F.explode("members").alias("name"))
    known = members.groupBy("name").agg(F.sum("m").alias("weight")).join(classes.select("name", "fp", "n", "low"), "name")
    known = common.materialize(known, "members")
    left = common.materialize(members.select("lid", "name").join(known.select("name", "fp", "weight", "n"), "name").drop("name"), "lists")
    common.drop_table(lists)
    common.release(spark)
    texts = common.materialize(_texts_of(docs, known.select("fp", "low")), "texts")
    sizes = texts.agg(F.count(F.lit(1)), F.countDistinct("fp")).first()
    if sizes[0] != sizes[1]:  # rows that repeat a doc_id
        several, texts = texts, common.materialize(texts.dropDuplicates(["fp"]), "texts")
        common.drop_table(several)
    common.drop_table(known)

    links, comps, tested = None, None, None
    for step in range(star_rounds + 1):
        now = left.withColumn("comp", F.col("fp")) if comps is None else left.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        pivots = now.groupBy("lid").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.max(F.struct("weight", "fp", "n", "comp")).alias("pivot")).where("one <> other")
        still_open = common.materialize(now.join(pivots.select("lid", "pivot"), "lid"), "open-lists")
        common.drop_table(left)
        left = still_open
        if still_open.isEmpty():
            break
        if step < star_rounds:
            found = still_open.where(F.col("comp") != F.col("pivot.comp")).select(F.col("fp").alias("u"), F.col("pivot.fp").alias("v")).distinct()
            found = _sketched(found, texts)
        else:
            found = _open_pairs(still_open, texts)
        if tested is not None:
            flipped = tested.select(F.col("v").alias("u"), F.col("u").alias("v"))
            found = found.join(tested.unionByName(flipped), ["u", "v"], "left_anti")
        pairs = common.materialize(found, "pairs")
        if step < star_rounds:
            left = still_open.where(F.col("fp") != F.col("pivot.fp")).select("lid", "fp", "weight", "n")
        if pairs.isEmpty():
            continue
        got = common.materialize(_verify(pairs, texts), "links")
        common.release(spark)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not got.isEmpty():
            links = got if links is None else links.unionByName(got)
            stars = components.connected_components(links)
            before, comps = comps, common.materialize(stars.select(F.col("node").alias("fp"), F.col("component").alias("comp")), "comps")
            for spent in (stars, before):
                if spent is not None:
                    common.drop_table(spent)
    for spent in (left, texts, tested, links):
        if spent is not None:
            common.drop_table(spent)
    common.release(spark)
    if comps is None:
        named = classes.withColumn("component_id", F.col("low"))
    else:
        placed = classes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        lowest = placed.groupBy("comp").agg(F.min("low").alias("component_id"))
        named = placed.join(lowest, "comp").select("fp", "low", "class_size", "component_id")
    return rows.join(named.select("fp", "component_id", "class_size"), "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class_size")).otherwise(F.lit(1)).alias("class_size")
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: the one with the smallest doc_id; null ids come last, and of rows that share the id one stays."""
    row = common.fresh(docs, "row")
    counts = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    unique = counts[0] == counts[1]
    named = docs.withColumn(row, F.col("doc_id").cast("long")) if unique else common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_components(named.select(F.col(row).alias("doc_id"), "text"), **settings).select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
    if unique:
        gone = groups.where("row <> comp")
    else:
        groups = common.materialize(groups, "groups").join(named.select(F.col(row).alias("row"), "doc_id"), "row")
        stays = groups.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))["row"].alias("stays"))
        gone = groups.join(stays, "comp").where("row <> stays")
    gone = common.materialize(gone.select(F.col("row").alias(row)), "near-copies")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return named.join(_hint(gone, few), row, "left_anti").select(*docs.columns)
