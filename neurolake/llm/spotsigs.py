"""SpotSigs fingerprints: chains of content words after common-word anchors, compared by pruned Jaccard (operator 2)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, _links, _minhash, _text

CHAIN = 3
SIMILARITY = 0.8
#: bytes of text of a range of neighbours
RANGE_BYTES = 32 << 20
#: sets that are compared at once; a group of more is compared by pairs of pieces
PIECE = 2_048
#: bytes of hashes or classes that are broadcast at most; beyond, they are joined
BROADCAST_BYTES = 48 << 20

# Very common words of English, French, German and Spanish.
ANCHORS = """
the of and to in is that it was for on are as with be by this from
le la les de des du et en un une que qui dans pour par sur
der die das und ist von zu den mit ein eine nicht auf für
el los las y se su por con del para es lo
""".split()

_anchor_hashes = np.sort(np.array(sorted({_text.hash_one(w.encode()) for w in ANCHORS}), np.uint64))


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The set of 32-bit signatures of each text, sorted.

    A signature is an anchor with the next content words (words that aren't anchors), fewer at the end of the text. A text
    without anchors followed by content has one signature: that of all its words, so equal texts are equal and others apart.
    """
    out: list[np.ndarray] = []
    for _, _, buf, offsets in _text.chunks(texts):
        starts, ends, first = _text.words(buf, offsets, _text.ALNUM)
        rows = len(first) - 1
        m = len(starts)
        h = _text.word_hashes(_text.LOWER[buf], starts, ends) if m else np.zeros(0, np.uint64)
        near = np.minimum(np.searchsorted(_anchor_hashes, h), len(_anchor_hashes) - 1)
        anchor = _anchor_hashes[near] == h
        content = np.flatnonzero(~anchor)
        row = _text.rows_of(first)
        c_row, c_hash = row[content], h[content]
        at = np.flatnonzero(anchor)
        nxt = np.searchsorted(content, at)
        sig = h[at]
        linked = np.zeros(len(at), bool)
        for k in range(chain):
            j = nxt + k
            ok = j < len(content)
            ok[ok] = c_row[j[ok]] == row[at[ok]]
            add = np.zeros(len(at), np.uint64)
            add[ok] = c_hash[j[ok]]
            sig = _text.combine(sig, add)
            linked |= ok
        sig, s_row = sig[linked], row[at[linked]]
        key = np.unique((s_row.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
        cuts = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for r in range(rows):
            s = low[cuts[r] : cuts[r + 1]]
            if not len(s):
                words = b" ".join(_text.LOWER[buf[a:b]].tobytes() for a, b in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]]))
                whole = words or buf[offsets[r] : offsets[r + 1]].tobytes()
                s = np.array([int.from_bytes(hashlib.sha256(whole).digest()[:4], "big")], np.uint32)
            out.append(s)
    return out


def render(s: np.ndarray) -> str:
    """The set as text: eight hex digits for each signature, ascending."""
    return s.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as their sizes, or what is left of them, rule out the least."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    got = both / (len(a) + len(b) - both)
    return got if got >= least else 0.0


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each fingerprint, as XXH64 and CRC-32 of its text."""
    texts = [render(x).encode() for x in sets]
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    return _text.xxh64(np.frombuffer(b"".join(texts), np.uint8), ends - size, ends).view(np.int64), np.array([zlib.crc32(t) for t in texts], np.int64)


def _prefixes(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, set): the keys under which sets that are alike enough meet.

    Sets are partitioned by length into classes of a ratio of 2, and one that may be like a longer one of the next class is in both.
    Of two sets with a Jaccard likeness of at least so much, the first signatures, n - ceil(n * least) + 1 of n by a fixed hash order, share one.
    """
    n = np.array([len(x) for x in sets])
    take = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low, high = (np.floor(np.log2(v + 1e-9)).astype(np.int64) for v in (n, np.floor(n / least + 1e-9)))
    for i, x in enumerate(sets):
        h = _text.mix(x.astype(np.uint64) + np.uint64(0x5851F42D))
        first = np.partition(h, take[i] - 1)[: take[i]]
        for c in {int(low[i]), int(high[i])}:
            keys.append(_text.mix(first + np.uint64(c + 1)))
            at.append(np.full(len(first), i))
    return np.concatenate(keys), np.concatenate(at)


def likeness_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(s, crc, component_id): the fingerprints, by their two hashes, that several rows have or that are linked, with the smallest doc_id of their component.

    Fingerprints are linked at a Jaccard likeness of at least so much. Those that share a key of their length class form a group
    named by its least; a group is compared whole, a large one by pairs of pieces, each set with those not reached yet only.
    """
    spark = _frames.ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @_frames.trimmed
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, crc = _names(signatures(_frames.text_column(batch)))
            yield pa.RecordBatch.from_arrays([_frames.text_column(batch, "doc_id"), pa.array(s), pa.array(crc)], names=["doc_id", "s", "crc"])

    @_frames.trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signatures(_frames.text_column(batch))
            s, _ = _names(sets)
            fresh = np.unique(s, return_index=True)[1]
            key, at = _prefixes([sets[i] for i in fresh.tolist()], least)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s[fresh][at])], names=["key", "s"])

    @_frames.trimmed
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _frames.runs(batches, "key"):
            both = np.unique(np.stack([rows.column(c).to_numpy() for c in ("key", "s")]), axis=1)
            head = np.flatnonzero(np.concatenate([[True], both[0, 1:] != both[0, :-1]]))
            size = np.diff(np.append(head, both.shape[1]))
            kept = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(both[1, head], size)[kept]), pa.array(both[1, kept])], names=["least", "s"])

    marks = _frames.cut(docs.mapInArrow(mark, f"doc_id {kind}, s long, crc long"))
    texts = docs.select("text")
    member = _frames.cut(texts.mapInArrow(deal, "key long, s long").repartition("key").sortWithinPartitions("key").mapInArrow(walk, "least long, s long").distinct())
    wanted = member.select("s").distinct()
    n = wanted.count()
    known = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).combine_chunks().to_numpy()) if n else np.zeros(0, np.int64)) if 8 * n <= BROADCAST_BYTES else None

    @_frames.trimmed
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signatures(_frames.text_column(batch))
            s, crc = _names(sets)
            some = np.unique(s, return_index=True)[1]
            if known is not None:
                some = some[np.isin(s[some], known.value, assume_unique=False)]
            yield pa.RecordBatch.from_arrays([pa.array(s[some]), pa.array(crc[some]), pa.array([sets[i].tobytes() for i in some.tolist()], pa.binary())], names=["s", "crc", "load"])

    sets = texts.mapInArrow(load, "s long, crc long, load binary").groupBy("s", "crc").agg(F.first("load").alias("load"))
    dealt = _frames.in_pieces(member, ["least"], "s", F.lit(PIECE)).join(sets, "s").select("deal", "s", "crc", "load").repartition("deal").sortWithinPartitions("deal")

    @_frames.trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _frames.runs(batches, "deal"):
            run, s, crc = (rows.column(c).to_numpy() for c in ("deal", "s", "crc"))
            held = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in rows.column("load").to_pylist()]
            cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                root = i + _minhash.clusters(held[i:j], least)
                mine = np.arange(i, j)[root != np.arange(i, j)]
                a.append(mine)
                b.append(root[mine - i])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(s[k]), pa.array(crc[k])], names=["s", "crc"]) for k in (np.concatenate(a), np.concatenate(b))], names=["a", "b"])

    links = _frames.cut(dealt.mapInArrow(compare, "a struct<s:long,crc:long>, b struct<s:long,crc:long>"))
    each = marks.groupBy("s", "crc").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    comp = _links.components(links).select(F.col("node.s").alias("s"), F.col("node.crc").alias("crc"), "component")
    rooted = _frames.cut(each.join(comp, ["s", "crc"], "left").where("n > 1 or component is not null").withColumn("root", F.coalesce("component", F.struct("s", "crc"))).select("s", "crc", "least", "root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "crc", "component_id")


def with_component(rows: DataFrame, classes: DataFrame, text: str = "fingerprint") -> DataFrame:
    """rows (doc_id, fingerprint as text, ...) with component_id, of likeness_classes(); a fingerprint without a class has its own row only."""
    named = _frames.cut(classes).select(F.col("s").alias("_s"), F.col("crc").alias("_crc"), "component_id", F.lit(True).alias("_named"))
    if 64 * named.count() <= BROADCAST_BYTES:
        named = F.broadcast(named)
    j = rows.join(named, (F.xxhash64(text) == F.col("_s")) & (F.crc32(text) == F.col("_crc")), "left")
    return j.withColumn("component_id", F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("_s", "_crc", "_named")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): a row per row of docs; component_id is the smallest doc_id reachable over fingerprints of a Jaccard likeness of at least so much.

    Null is taken as the empty text. A row without doc_id belongs to its component; a component of none but such rows has a null id.
    """
    docs = docs.select("doc_id", "text")
    prints = _frames.add_columns(docs, [("fingerprint", "string")], lambda b: {"fingerprint": pa.array([render(x) for x in signatures(_frames.text_column(b))], pa.string())}, ["doc_id"])
    return with_component(prints, likeness_classes(docs, least)).select("doc_id", "component_id")


def _at_or_below(cuts: list[int], x: Column) -> Column:
    """How many of the sorted boundaries lie at or below x: a coarse step over every so many'th, then a fine one."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    pack = lambda some: F.array(*[F.lit(c).cast("long") for c in some])
    coarse = F.size(F.filter(pack(cuts[::step]), lambda c: c <= x))
    fine = F.size(F.filter(F.element_at(F.array(*[pack(cuts[i : i + step]) for i in range(0, len(cuts), step)]), F.greatest(coarse, F.lit(1))), lambda c: c <= x))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def edit_trial(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, in ascending (doc_id, text).

    Documents are dealt once, by ranges of doc_id of about so many bytes or less; the first of each range also goes to the end of the
    range before, the first of all to the end of the last. A lone document is its own next. Ids in a row of over range_bytes
    share one range. Null ids come first.
    """
    spark = _frames.ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, min(10_000, max(-(-size // range_bytes), 2 * _frames.partitions(spark))))
    cuts = sorted(set((rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).head()[0] if n > 1 else None) or []))
    bucket = _at_or_below(cuts, F.col("doc_id"))
    placed = rows.withColumn("k", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    heads = [(r["k"], r["at"]) for r in placed.groupBy("k").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("s"))).alias("at")).orderBy("k").collect()]
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {k: heads[i - 1][0] for i, (k, _) in enumerate(heads)}
    # the head of each range, again, at the end of the range before
    head_ids = spark.createDataFrame([(k, h["i"], h["s"], before[k], i == 0) for i, (k, h) in enumerate(heads)], "k int, i long, s long, p int, wraps boolean")
    joined = placed.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("sha", F.xxhash64("text"))
    heads_b = F.broadcast(head_ids.withColumnRenamed("k", "hk"))
    joined = joined.join(heads_b, (joined.k == heads_b.hk) & (joined["ord"] == heads_b.i) & (joined.sha == heads_b.s), "left")
    places = F.when(F.col("p").isNull(), F.array(F.struct(F.col("k").alias("k"), F.lit(0).alias("tail")))).otherwise(F.array(F.struct(F.col("k").alias("k"), F.lit(0).alias("tail")), F.struct(F.col("p").alias("k"), F.lit(1).alias("tail"))))
    dealt = joined.select("doc_id", "text", "sha", "ord", F.explode(places).alias("x")).select("doc_id", "text", "sha", "ord", "x.k", "x.tail")
    dealt = dealt.repartition(max(_frames.partitions(spark), 1), "k").sortWithinPartitions("k", "tail", "ord", "sha")
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    @_frames.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            """Rows whose next is known; the last waits for it."""
            nonlocal held, size
            texts = [t for _, t, _, _ in held]
            own = signatures(pa.array(texts, pa.string()))
            made, at = [], []
            for i, (_, t, k, tail) in enumerate(held):
                if tail or i + 1 == len(held) or held[i + 1][2] != k:
                    continue
                half = len(t) // 2
                made.append(t[: len(t) - half] + texts[i + 1][:half])
                at.append(i)
            other = signatures(pa.array(made, pa.string()))
            cols: list[list] = [[held[i][0] for i in at], [len(texts[i]) for i in at], [hashlib.sha256(e.encode()).hexdigest() for e in made], [render(own[i]) for i in at], [render(s) for s in other], [jaccard(own[i], s) for i, s in zip(at, other)], [jaccard(own[i], own[i + 1]) for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
            held, size = ([] if final else held[-1:]), 0

        for batch in batches:
            for d, t, k, tail in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "k", "tail"))):
                if held and held[-1][3] and tail and held[-1][2] == k:
                    continue  # equal heads
                held.append((d, t, k, tail))
                size += len(t)
                if size > 2 * _text.CHUNK_BYTES and len(held) > 1:
                    yield from flush(False)
        if held:
            yield from flush(True)

    got = dealt.select("doc_id", "text", "k", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses, and the component of near duplicates of each."""
    docs = _frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_component(edit_trial(docs), likeness_classes(docs))


QUERIES = {"op2_spotsigs": op2_spotsigs}
SQL: dict[str, str] = {}
